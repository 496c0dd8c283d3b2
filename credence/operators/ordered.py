"""Questions about a total order of all rows, without sending the rows through one task.

A window without partition keys, or with a key that holds a third of the rows, puts that group
in one task.  Here the rows are range-sorted instead: Spark samples the sort key, cuts it into
slices of similar size and sorts each.  Position and slice are written to the checkpoint folder
once, so lost executors cannot change them.  What follows is one narrow pass over each slice,
without another shuffle of the rows, and one row per slice to combine.

The checkpoint is written while the DataFrame is built.  Spark removes it together with the
DataFrame if the session has `spark.cleaner.referenceTracking.cleanCheckpoints` set, as local
sessions here have.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from credence.session import shared_folder

SLICE, PLACE = "_slice", "_place"
_BITS = 33      # monotonically_increasing_id keeps the row's place in the lower 33 bits


def sliced(df: DataFrame, *order: Column) -> DataFrame:
    """Rows in range-sorted slices, numbered within the slice from 0.

    The order should be total; rows that tie completely keep an arbitrary but fixed order.
    """
    shared_folder(df.sparkSession)
    placed = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    return (placed.checkpoint()
            .withColumn(SLICE, F.shiftright("_id", _BITS))
            .withColumn(PLACE, F.col("_id").bitwiseAND(F.lit((1 << _BITS) - 1)))
            .drop("_id"))


def _before(per_slice: DataFrame, amount: str) -> DataFrame:
    """Running total of `amount` over the slices before this one.  One row per slice."""
    earlier = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(SLICE, F.coalesce(F.sum(amount).over(earlier),
                                              F.lit(0).cast("bigint")).alias("_before"))


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Add the position of every row in the global order, counted from 1."""
    rows = sliced(df, *order)
    sizes = rows.groupBy(SLICE).agg(F.count("*").alias("n"))
    # One row per sort partition: its size is the number of shuffle partitions.
    offsets = F.broadcast(_before(sizes, "n"))
    return (rows.join(offsets, SLICE)
            .withColumn(name, F.col("_before") + F.col(PLACE) + 1)
            .drop(SLICE, PLACE, "_before"))


def _earlier_sums(amount: str, schema: pa.Schema):
    """Adds the sum of `amount` over the earlier rows of the partition, batch after batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            values = pc.fill_null(batch.column(batch.schema.get_field_index(amount)), 0)
            values = values.cast(schema.field("_local").type)
            upto = pc.add(pc.cumulative_sum(values), pa.scalar(total, values.type))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pc.subtract(upto, values)], schema=schema)
            if batch.num_rows:
                total = upto[-1].as_py()
    return run


def running_total(df: DataFrame, amount: str, *order: Column, name: str) -> DataFrame:
    """Add the sum of `amount` over all earlier rows of the global order.

    The rows are shuffled once, by the sort; sums within a slice are one narrow pass over it.
    """
    rows = sliced(df, *order)
    sums = rows.groupBy(SLICE).agg(F.sum(amount).alias("n"))
    offsets = F.broadcast(_before(sums, "n"))       # one row per slice
    kind = sums.schema["n"].dataType
    schema = T.StructType(rows.schema.fields + [T.StructField("_local", kind)])
    local = rows.mapInArrow(_earlier_sums(amount, to_arrow_schema(schema)), schema)
    return (local.join(offsets, SLICE)
            .withColumn(name, F.col("_before") + F.col("_local"))
            .drop(SLICE, PLACE, "_before", "_local"))


def _followers(take: list[str], schema: pa.Schema):
    """Adds the `take` columns of the following row of the partition, null after its last."""
    def joined(batch: pa.RecordBatch, after: pa.RecordBatch | None) -> pa.RecordBatch:
        shifted = []
        for c in take:
            column = batch.column(batch.schema.get_field_index(c))
            last = pa.nulls(1, column.type) if after is None else after.column(
                after.schema.get_field_index(c)).slice(0, 1)
            shifted.append(pa.concat_arrays([column.slice(1), last]))
        inside = [True] * (batch.num_rows - 1) + [after is not None]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, *shifted, pa.array(inside)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    yield joined(held, batch)
                held = batch
        if held is not None:
            yield joined(held, None)
    return run


def with_next(df: DataFrame, keys: list[str], order: list[Column], take: list[str],
              prefix: str = "next_") -> DataFrame:
    """Add the columns of the following row with equal keys; null after the last one.

    Same result as lead() over the keys, but a hot key is spread over many slices.  The rows are
    shuffled once, by the sort; within a slice the columns are shifted by a row, and the last row
    of a slice gets its follower from the first row of the next slice.
    """
    rows = sliced(df, *[F.col(k) for k in keys], *order)
    names = list(dict.fromkeys([*keys, *take]))
    heads = rows.filter(F.col(PLACE) == 0).select(SLICE, F.struct(*names).alias("_head"))
    # One row per slice.
    joints = F.broadcast(heads.select(SLICE, F.lead("_head").over(Window.orderBy(SLICE))
                                      .alias("_across")))
    fields = [T.StructField(f"_next_{n}", rows.schema[n].dataType) for n in names]
    schema = T.StructType(rows.schema.fields + fields + [
        T.StructField("_inside", T.BooleanType())])
    follower = rows.mapInArrow(_followers(names, to_arrow_schema(schema)), schema).join(
        joints, SLICE, "left")
    there = F.col("_inside") | F.col("_across").isNotNull()
    value = lambda n: F.when(F.col("_inside"), F.col(f"_next_{n}")).otherwise(
        F.col(f"_across.{n}"))
    same = there
    for k in keys:
        same = same & value(k).eqNullSafe(F.col(k))
    return follower.select(*df.columns, *[F.when(same, value(c)).alias(prefix + c)
                                          for c in take])
