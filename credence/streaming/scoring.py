"""Ranking and quality of records that keep arriving.

Normalising, rules, features and scores are the batch functions: they hold no state, so they
run on a stream unchanged.  Only the top-k and the counts keep state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from credence.operators import normalize as N
from credence.operators.rules import anomaly_rules, rule_hits
from credence.operators.scoring import score_records
from credence.streaming.latest import SCORE_COLUMNS, LatestScores


def score_stream(records: DataFrame, target: str, checkpoint: str,
                 columns: tuple[str, ...] = SCORE_COLUMNS) -> StreamingQuery:
    """Append the scores of arriving records to a parquet folder; stops when none are left."""
    return (score_records(records).select(*columns).writeStream.format("parquet")
            .outputMode("append").option("path", target)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def topk_stream(records: DataFrame, state: str, checkpoint: str, **limits) -> StreamingQuery:
    """Keep the latest scores of everything seen; `limits` are those of `LatestScores`.

    A batch is scored and written once, whatever was seen before.  `current_topk` reads the list
    at any time.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        LatestScores(batch.sparkSession, state, **limits).add(score_records(batch), batch_id)

    return (records.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest_scores(spark: SparkSession, state: str, upto: int | None = None) -> DataFrame:
    """The latest arrival of every id, by batch and place within it."""
    return LatestScores(spark, state).latest(upto)


def current_topk(spark: SparkSession, state: str, k: int = 100, upto: int | None = None
                 ) -> DataFrame:
    """The exact top k of the latest scores, after the batch `upto` or after all."""
    return LatestScores(spark, state).top(k, upto)


def quality_counts(records: DataFrame) -> DataFrame:
    """Running number of flags per rule: the same aggregation in batch and streaming."""
    hits = rule_hits(N.derive(records), anomaly_rules())
    return hits.groupBy("code").agg(F.sum("n").alias("n_flags"), F.count("*").alias("n_records"))


def arrival_counts(parsed: DataFrame) -> DataFrame:
    """Running number of documents read, by the reason for which they were turned away."""
    reason = F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")
    return parsed.groupBy(reason).agg(F.count("*").alias("n"))


def quality_stream(records: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write the running flag counts after each batch (one row per rule)."""
    return _running(quality_counts(records), target, checkpoint)


def arrival_stream(parsed: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write the running totals of rows and rejects after each batch (one row per outcome)."""
    return _running(arrival_counts(parsed), target, checkpoint)


def _running(counts: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Each batch writes its table; the one before the last is then no longer needed."""
    def store(table: DataFrame, batch_id: int) -> None:
        table.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        spark = table.sparkSession
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/batch={batch_id - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return (counts.writeStream.outputMode("complete").foreachBatch(store)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def last_counts(spark: SparkSession, target: str) -> DataFrame:
    """The table of the last batch that was written."""
    rows = spark.read.option("basePath", target).parquet(target)
    last = rows.agg(F.max("batch").alias("batch"))      # two folders at most
    return rows.join(F.broadcast(last), "batch", "left_semi").drop("batch")
