"""The whole ranking job: documents in, ranked and explained list out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from credence.operators import explain
from credence.operators.checks import check_table
from credence.operators.ranking import top_ranked
from credence.operators.scoring import score_records
from credence.settings import JobSpec, RuleConfig, ScoreWeights, Taxonomy
from credence.sources import sinks
from credence.sources.documents import read_records


def select_top(records: DataFrame, k: int = 100, job: JobSpec = JobSpec(),
               weights: ScoreWeights = ScoreWeights(), taxonomy: Taxonomy = Taxonomy(),
               rules: RuleConfig = RuleConfig(), where: Column | str | None = None,
               keep: tuple[str, ...] = explain.KEEP, dedupe: str = "keep") -> DataFrame:
    """Top k by published score, with features, components and the columns in `keep`.

    `dedupe` says what happens to repeated ids: "keep" lists them, "best" lists the best scored
    row of each id, "fail" stops the job if one would be listed twice.

    One pass: what the explanation needs rides along through the top-k instead of being
    fetched again by id.
    """
    scored = score_records(records, job, weights, taxonomy, rules, where=where, keep=keep)
    return top_ranked(scored, k, dedupe=dedupe)


def ranked_list(records: DataFrame, k: int = 100, **options) -> DataFrame:
    """(candidate_id, rank, score, reasoning) of the top k."""
    return explain.explain(select_top(records, k, **options))


def run(spark: SparkSession, source: str, target: str, signals_keys: str | Sequence[str],
        k: int = 100, dedupe: str = "keep") -> DataFrame:
    """Read, rank, explain, write list, preview and audit; returns the violations (none if ok).

    Only the k selected rows are kept between the writes.
    """
    top = select_top(read_records(spark, source, signals_keys), k, dedupe=dedupe).persist()
    try:
        listed = explain.explain(top)
        sinks.write_ranked_csv(listed, f"{target}/ranked")
        sinks.write_preview_csv(listed, f"{target}/preview")
        sinks.write_table_csv(explain.audit_rows(top).orderBy("rank").coalesce(1),
                              f"{target}/audit")
        violations = check_table(listed, k)
        return spark.createDataFrame(violations.collect(), violations.schema)
    finally:
        top.unpersist()
