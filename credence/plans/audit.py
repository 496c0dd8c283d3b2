"""Audits of a ranking: tables per selected record, distributions, what trust removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from credence.operators import evidence, explain, profile
from credence.operators.ranking import fell_out, scenario_overlaps, top_by
from credence.operators.scoring import score_records
from credence.sources import sinks

KEEP = (*explain.KEEP, "career_history")


def top_by_score(records: DataFrame, k: int = 100) -> DataFrame:
    """Top k by unrounded final score with everything the audits read."""
    return top_by(score_records(records, keep=KEEP), "final_score", k)


def diagnostics(scored: DataFrame, top: DataFrame, k: int = 100) -> DataFrame:
    """All metrics as one long table (metric, key, value)."""
    def long(df: DataFrame, metric: str, key: str, value: str) -> DataFrame:
        return df.select(F.lit(metric).alias("metric"), F.col(key).cast("string").alias("key"),
                         F.col(value).cast("double").alias("value"))

    trust = profile.trust_bands(scored).unpivot(
        [], ["full", "reduced", "floor"], "key", "value")
    titles = profile.top_values(top.select(F.col("profile.current_title").alias("title")),
                                "title", 10)
    mean = top.agg(F.avg("domain_score").alias("value")).withColumn("key", F.lit("domain"))
    parts = [
        long(profile.score_bands(scored), "score_distribution", "band", "n"),
        long(trust, "trust_distribution", "key", "value"),
        long(titles, "top_titles", "value", "n"),
        long(top, "top_core_skills", "rank", "ai_skill_count"),
        long(top, "top_experience", "rank", "years_experience"),
        long(mean, "top_mean", "key", "value"),
        long(fell_out(scored, k), "removed_by_trust", "candidate_id", "raw_score"),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def run(records: DataFrame, target: str, k: int = 100) -> None:
    """Write the audit tables.

    Scores are computed and stored once.  The top k come from the stored scores, and only their
    records are scored again with everything the audits read.
    """
    spark = records.sparkSession
    narrow = ("candidate_id", "raw_score", "final_score", "trust_score", "domain_score",
              "skill_score", "experience_score", "behavioral_score", "verification_score",
              "education_score", "availability_score")
    sinks.write_features(score_records(records).select(*narrow), f"{target}/scores")
    scored = sinks.read_features(spark, f"{target}/scores")
    selected = top_by(scored.select("candidate_id", "final_score"), "final_score", k)
    top = top_by_score(records.join(F.broadcast(selected.select("candidate_id")),    # k rows
                                    "candidate_id", "left_semi"), k).persist()
    try:
        sinks.write_table_csv(explain.component_audit(top), f"{target}/component_audit")
        detail = top.filter(F.col("rank") <= 10).drop(*KEEP, "rank")
        sinks.write_table_csv(detail, f"{target}/detailed")
        sinks.write_table_csv(evidence.deep_audit(top), f"{target}/deep_audit")
        sinks.write_table_csv(evidence.evidence_audit(top), f"{target}/evidence_audit")
        sinks.write_table_csv(profile.archetype_summary(
            top, explain.archetype()), f"{target}/archetypes")
        sinks.write_table_csv(scenario_overlaps(scored), f"{target}/sensitivity")
        sinks.write_metrics(diagnostics(scored, top, k), f"{target}/diagnostics")
        sinks.write_metrics(profile.cohort_summary(top), f"{target}/cohort")
    finally:
        top.unpersist()
