"""What several operators share: private column names, stored tables, joins of a checked size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from credence.session import fresh_path

BROADCAST_ROWS = 200_000


def column(name: str) -> Column:
    """The column of exactly this name, also if the name has dots."""
    return F.col(f"`{name}`")


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct `row`: no name of the input can clash with one made here."""
    return df.select(F.struct(*map(column, df.columns)).alias("row"))


def unpacked(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[F.col("row").getField(n).alias(n) for n in names])


ROWS_PER_FILE = 50_000
ROWS_AT_A_TIME = 512


def stored(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write `df` once below the shared folder and read it from there.

    Lost executors cannot change what is written, nothing is computed twice, and later plans know
    the size.  The files go when the session's JVM ends.  `rows` is an upper bound of the number
    of narrow rows, where one is known: a small table behind a shuffle then is a few files, not
    one for each shuffle partition.
    """
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_PER_FILE)
    spark = df.sparkSession
    path = fresh_path(spark, label)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "left",
                 most: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a stored table of narrow rows.

    It is broadcast if it has at most `most` rows.  Beyond that both sides are shuffled, and
    adaptive execution splits the partitions of hot keys.
    """
    small = right.count() <= most
    return left.join(F.broadcast(right) if small else right, on, how)


def records(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The rows of an Arrow batch, as tuples of the named columns.  Few of them are Python objects at
    a time, so a batch of long texts is not held twice."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for at in range(0, batch.num_rows, ROWS_AT_A_TIME):
        yield from zip(*(c.slice(at, ROWS_AT_A_TIME).to_pylist() for c in columns))


def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut, for steps that put out much for each row."""
    for part in parts:
        for at in range(0, part.num_rows, ROWS_AT_A_TIME):
            yield part.slice(at, ROWS_AT_A_TIME)


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096
            ) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of bounded size."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
