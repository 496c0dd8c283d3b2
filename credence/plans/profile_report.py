"""The dataset profile as a set of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from credence import schema as S, settings
from credence.operators import normalize as N
from credence.operators import profile as P
from credence.operators.intervals import education_overlaps
from credence.operators.rules import forensic_rules, rule_hits, total_count
from credence.sources import documents as D


def forensic_counts(records: DataFrame) -> DataFrame:
    """(candidate_id, n_flags) under the forensic rule set."""
    return N.derive(records).select("candidate_id",
                                    total_count(forensic_rules()).alias("n_flags"))


HISTOGRAMS = {"experience": ("years_of_experience", 20), "skills": ("n_skills", 20),
              "response": ("recruiter_response_rate", 20), "salary": ("salary_max", 30),
              "completeness": ("profile_completeness", 20), "connections": ("connection_count", 30)}


def tables(records: DataFrame, flat: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    """All sections.  `records` and `flat` (`normalize.flatten(records)`) should be stored, for
    every section reads one of them; exact quantiles run a job while their section is built."""
    jobs, education = P.entries(records, "career_history"), P.entries(records, "education")
    skills = P.entries(records, "skills")
    flags = forensic_counts(records)
    hits = rule_hits(N.derive(records), forensic_rules())
    return {
        "missing": P.missing_values(flat),
        "duplicate_ids": P.duplicate_keys(flat, "candidate_id"),
        "malformed_ids": P.malformed_ids(flat, "candidate_id", settings.ID_PATTERN),
        "near_duplicates": P.near_duplicates(
            flat, ["current_title", "current_company", "years_of_experience", "n_skills"]),
        "id_sequence": P.id_sequence(flat, "candidate_id"),
        "experience": P.describe(flat, ["years_of_experience", "implied_exp_years",
                                        "exp_discrepancy"]),
        "countries": P.top_values(flat, "country", 15),
        "locations": P.top_values(flat, "location", 20),
        "titles": P.top_values(flat, "current_title", 15),
        "skills": P.top_values(skills, "name", 30),
        "proficiency": P.value_counts(skills, "proficiency"),
        "ai_skills": P.skill_frequency(records, settings.PROFILE_CORE_SKILLS, 25),
        "ai_skill_counts": P.value_counts(flat, "n_ai_skills"),
        "education": P.education_summary(education),
        "education_overlaps": education_overlaps(education).agg(
            F.sum("n_overlaps").alias("n_overlaps")),
        "tiers": P.domain_counts(education, "tier", settings.EDUCATION_TIERS),
        "degrees": P.top_values(education, "degree", 15),
        "fields": P.top_values(education, "field_of_study", 20),
        "institutions": P.top_values(education, "institution", 20),
        "jobs": P.job_summary(jobs),
        "companies": P.top_values(jobs, "company", 20),
        "company_sizes": P.domain_counts(jobs, "company_size", settings.COMPANY_SIZES),
        "industries": P.top_values(jobs, "industry", 20),
        "signals": P.describe(flat, [
            "profile_completeness", "recruiter_response_rate", "interview_completion_rate",
            "github_activity_score", "connection_count", "avg_response_time_hours",
            "saved_by_recruiters_30d", "search_appearance_30d"]),
        "salary": P.describe(flat, ["salary_min", "salary_max"]),
        "work_modes": P.value_counts(flat, "preferred_work_mode"),
        "verification": P.rates(flat, {c: F.col(c) for c in (
            "verified_email", "verified_phone", "linkedin_connected", "willing_to_relocate",
            "open_to_work")}),
        "offers": P.conditional_means(flat, ["offer_acceptance_rate"]),
        "flag_totals": P.flag_totals(flags),
        "flag_types": P.flag_breakdown(hits),
        "flag_histogram": P.flag_histogram(flags),
        "worst": P.worst_records(flags, k),
        "correlation": P.correlation(flat, list(P.CORRELATED)),
        "connections_p99": P.quantiles(flat, ["connection_count"], [0.99]),
        "outliers": P.outliers(flat),
        "dashboard": P.dashboard(flat),
        **{f"histogram_{name}": P.histogram(flat, column, bins)
           for name, (column, bins) in HISTOGRAMS.items()},
    }


def document_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """Sections about the documents themselves: top-level keys, and what was turned away."""
    return {"key_presence": D.key_presence(parsed, S.RECORD_KEYS),
            "load_stats": D.load_stats(parsed)}


def run(records: DataFrame, target: str, parsed: DataFrame | None = None) -> None:
    """Write every section below `target`.

    The typed records and the flat table are stored first, so the documents are parsed once
    whatever the number of sections.  `parsed` adds the sections about the documents.
    """
    spark = records.sparkSession
    records.write.mode("overwrite").parquet(f"{target}/records")
    stored = spark.read.schema(records.schema).parquet(f"{target}/records")
    N.flatten(stored).write.mode("overwrite").parquet(f"{target}/flat")
    flat = spark.read.parquet(f"{target}/flat")
    sections = tables(stored, flat)
    if parsed is not None:
        sections |= document_tables(parsed)
    for name, table in sections.items():
        table.write.mode("overwrite").json(f"{target}/{name}")
