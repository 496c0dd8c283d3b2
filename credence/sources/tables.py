"""Parquet tables of the driver's data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows of a task that does much for each: a task stays short however large the table is.
ROWS_PER_TASK = 100_000


def parts_for(df: DataFrame, rows: int = ROWS_PER_TASK) -> int:
    """Partitions for work on a stored table: one for each core, and one for `rows` rows."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def spread(df: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """Use all cores, in tasks of bounded size, for a narrow input that arrives in fewer splits.

    A table of many files already has more splits and is left as it is: no shuffle.
    """
    parts = parts_for(df, rows)
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df
