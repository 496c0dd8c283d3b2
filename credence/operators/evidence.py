"""Where in the text the evidence is: keyword hits with their surroundings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from credence.functions import text as T
from credence.session import kept
from credence.settings import EVIDENCE_KEYWORDS

AUDITED_DOMAINS = ("retrieval", "ranking", "recommendation", "search", "evaluation",
                   "production_ml")


def record_texts() -> Column:
    """array<struct<source, text>>: profile texts, then title and description of each job."""
    profile = F.col("profile")
    part = lambda name, value: F.struct(F.lit(name).alias("source"), value.alias("text"))
    jobs = F.flatten(F.transform("career_history", lambda j: F.array(
        part("job_title", j["title"]), part("job_description", j["description"]))))
    head = F.array(*[part(n, profile[n]) for n in ("headline", "summary", "current_title")])
    return F.concat(head, jobs)


def keyword_hits(texts: DataFrame, text: str, groups: Mapping[str, tuple[str, ...]],
                 carry: list[str], window: int = 40) -> DataFrame:
    """One row per text and keyword it contains.

    The dictionary is a literal in the plan and is filtered inside each row, so only real hits
    become rows; texts and keywords are never multiplied out.
    """
    lowered = texts.withColumn("_low", F.lower(text))
    hits = F.filter(T.keyword_table(groups), lambda k: F.contains(F.col("_low"), k["keyword"]))
    return (lowered.select(*carry, text, F.explode(hits).alias("hit"))
            .select(*carry, F.col("hit.domain").alias("domain"),
                    F.col("hit.keyword").alias("matched_keyword"),
                    T.snippet(F.col(text), F.col("hit.keyword"), window)
                    .alias("source_text_snippet")))


def evidence_audit(ranked: DataFrame, top: int = 50,
                   domains: tuple[str, ...] = AUDITED_DOMAINS) -> DataFrame:
    """Keyword hits of the first `top` selected records, per text source."""
    texts = (ranked.filter(F.col("rank") <= top)
             .select("candidate_id", "rank", F.posexplode(record_texts()).alias("part", "t"))
             .select("candidate_id", "rank", "part", "t.source", "t.text"))
    groups = {d: EVIDENCE_KEYWORDS[d] for d in domains}
    return keyword_hits(texts, "text", groups, ["candidate_id", "rank", "part", "source"]).select(
        "candidate_id", "rank", "domain", "matched_keyword", "source", "source_text_snippet")


def deep_audit(ranked: DataFrame, top: int = 50, snippets: int = 5) -> DataFrame:
    """Selected records with scores, shortened summary and a few distinct snippets.

    Snippets are in text order; the number per record is bounded by its own text.
    """
    ranked = kept(ranked, "audited")        # read twice: made once
    found = (evidence_audit(ranked, top).groupBy("candidate_id")
             .agg(F.array_join(F.slice(F.array_sort(F.collect_set("source_text_snippet")), 1,
                                       snippets), " || ").alias("top_career_snippets")))
    profile = F.col("profile")
    rows = ranked.select(
        "rank", "candidate_id", profile["current_title"].alias("title"),
        profile["headline"].alias("headline"), "years_experience", "ai_skill_count",
        "domain_score", "skill_score", "experience_score", "final_score",
        profile["headline"].alias("headline_text"),
        T.truncated(profile["summary"], 200).alias("summary_text"))
    return (rows.join(found, "candidate_id", "left")
            .withColumn("top_career_snippets", F.coalesce("top_career_snippets", F.lit("")))
            .select("rank", "candidate_id", *rows.columns[2:], "top_career_snippets"))
