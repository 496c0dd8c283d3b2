"""One-line explanations and audit rows for selected records.  All plain expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from credence.functions import text as T
from credence.functions.numeric import fixed, round_exact
from credence.settings import ARCHETYPE_DEFAULT, ARCHETYPES, Taxonomy

# Columns an explanation needs besides features and scores.
KEEP = ("career_text", "skill_names_lower", "groups", "profile")


def matched_tools(taxonomy: Taxonomy = Taxonomy(), limit: int = 3) -> Column:
    """Display names of the first tools found as a skill name or in the text."""
    found = ", ".join(
        f"if(contains(career_text, {T.sql_text(key)}) OR "
        f"array_contains(skill_names_lower, {T.sql_text(key)}), {T.sql_text(shown)}, null)"
        for key, shown in taxonomy.tools.items())
    return F.slice(F.expr(f"array_compact(array({found}))"), 1, limit)


def primary_capability(tools: Column) -> Column:
    """What the record is mainly about; the first area with evidence decides."""
    any_of = lambda *names: reduce(or_, [F.array_contains(tools, n) for n in names])
    seen = lambda name: F.col(f"evidence_{name}") > 0
    searching = (F.when(any_of("FAISS", "Pinecone", "Weaviate"), "dense retrieval")
                 .when(any_of("BM25", "Elasticsearch"), "hybrid retrieval")
                 .otherwise("retrieval systems"))
    return (F.when(seen("retrieval") | seen("search"), searching)
            .when(seen("ranking"), "LTR ranking")
            .when(seen("recommendation"), "recommendation systems")
            .when(seen("nlp"), "NLP & LLM engineering")
            .otherwise("applied ML engineering"))


def production_phrase(score: Column) -> Column:
    return (F.when(score >= 0.75, "prod scaling & MLOps").when(score >= 0.5, "model deployment")
            .when(score >= 0.25, "production ownership").otherwise("applied ML"))


def concern() -> Column:
    """At most one remark: trust first, then a long notice period, then few verified signs."""
    return (F.when(F.col("trust_score") < 1.0, " Additional verification recommended.")
            .when(F.col("notice_period_days") >= 60,
                  F.concat(F.lit(" "), F.col("notice_period_days").cast("string"),
                           F.lit("-day notice period.")))
            .when(F.col("verification_score") < 0.4, " Limited verification signals.")
            .otherwise(""))


def reasoning(tools: Column, limit: int = 180) -> Column:
    years = round_exact(F.col("implied_experience_years"), 1).cast("string")
    used = F.when(F.size(tools) > 0, F.concat(F.lit(" using "), F.array_join(tools, ", "))) \
        .otherwise("")
    line = F.concat(F.lit("Designed "), primary_capability(tools), used, F.lit(". "), years,
                    F.lit(" yrs YOE, "), production_phrase(F.col("production_score")),
                    F.lit(". "), F.col("confidence_category"), F.lit("."), concern())
    return T.truncated(line, limit, limit - 3)


def matched_groups(taxonomy: Taxonomy = Taxonomy()) -> Column:
    groups = F.col("groups")
    return F.array_compact(F.array(*[F.when(groups[g], F.lit(T.title_case(g)))
                                     for g in taxonomy.capability]))


def strengths(matched: Column, limit: int = 3) -> Column:
    return F.when(F.size(matched) > 0, F.array_join(F.slice(matched, 1, limit), ", ")) \
        .otherwise("General ML")


def _listed(separator: str, default: str, *parts: Column) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(separator, *parts), F.lit("")), F.lit(default))


def weaknesses() -> Column:
    return _listed(
        ", ", "None",
        F.when(F.col("trust_score") < 1.0, "Trust audit recommended"),
        F.when(F.col("notice_period_days") > 60,
               F.concat(F.col("notice_period_days").cast("string"), F.lit("d notice"))),
        F.when(F.col("verification_score") < 0.5, "Few verifications"))


def why_ranked() -> Column:
    return _listed(
        " & ", "Balanced score profile",
        F.when(F.col("domain_score") >= 0.5, "High domain alignment"),
        F.when(F.col("capability_score") >= 0.6, "Broad skill coverage"),
        F.when(F.col("production_score") >= 0.5, "Production ML maturity"))


def archetype(title: str = "profile.current_title") -> Column:
    """Kind of role by the words of a title column."""
    chain = F
    for words, name in ARCHETYPES:
        chain = chain.when(T.contains_any(f"lower({title})", words), F.lit(name))
    return chain.otherwise(F.lit(ARCHETYPE_DEFAULT))


def explain(ranked: DataFrame, taxonomy: Taxonomy = Taxonomy()) -> DataFrame:
    """The published row: id, rank, rounded score, reasoning."""
    return (ranked.withColumn("_tools", matched_tools(taxonomy))
            .select("candidate_id", "rank", "score", reasoning(F.col("_tools"))
                    .alias("reasoning")))


def audit_rows(ranked: DataFrame, taxonomy: Taxonomy = Taxonomy()) -> DataFrame:
    """Published row plus strengths, weaknesses, coverage and the reason for the rank."""
    prepared = (ranked.withColumn("_tools", matched_tools(taxonomy))
                .withColumn("_groups", matched_groups(taxonomy)))
    coverage = F.concat(F.size("_groups").cast("string"), F.lit(f"/{len(taxonomy.capability)}"))
    return prepared.select(
        "rank", "candidate_id", F.col("profile.current_title").alias("title"),
        F.col("final_score").alias("score"), "trust_score",
        F.col("implied_experience_years").alias("experience"),
        F.col("ai_skill_count").alias("ai_skills"),
        reasoning(F.col("_tools")).alias("reasoning"),
        strengths(F.col("_groups")).alias("technical_strengths"),
        weaknesses().alias("weaknesses"), why_ranked().alias("why_ranked"),
        round_exact(F.col("domain_score") * F.lit(100.0), 1).alias("jd_match_pct"),
        coverage.alias("capability_coverage"), F.col("confidence_category").alias("confidence"))


def audit_table(audit: DataFrame) -> DataFrame:
    """The audit as printed: scores and percentages as fixed-width text."""
    return audit.select(
        "rank", "candidate_id", fixed(F.col("score"), 4).alias("score"), "confidence",
        fixed(F.col("trust_score"), 2).alias("trust"),
        F.concat(F.col("jd_match_pct").cast("string"), F.lit("%")).alias("jd_match"),
        "capability_coverage", "technical_strengths", "weaknesses", "why_ranked")


def component_audit(ranked: DataFrame) -> DataFrame:
    """Components, trust and final score of each selected record."""
    return ranked.select(
        "candidate_id", F.col("profile.current_title").alias("current_title"),
        "years_experience", "ai_skill_count", "domain_score", "skill_score", "experience_score",
        "behavioral_score", "verification_score", "education_score", "availability_score",
        "trust_score", "final_score")


def example_lines(ranked: DataFrame, taxonomy: Taxonomy = Taxonomy()) -> DataFrame:
    """Explanations with title, score text and length."""
    lines = ranked.withColumn("_tools", matched_tools(taxonomy)).select(
        "rank", F.col("profile.current_title").alias("title"), "candidate_id",
        fixed(F.col("final_score"), 3).alias("score"),
        reasoning(F.col("_tools")).alias("reasoning"))
    return lines.withColumn("n_chars", F.length("reasoning"))
