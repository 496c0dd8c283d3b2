"""From text leaves to the typed record, and the properties derived from it."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from credence import schema as S
from credence import settings
from credence.functions import arrays, coerce, numeric

_EMPTY_MAP = "cast(map() as map<string, double>)"


def _each(array: Column, element, ddl: str) -> Column:
    """Typed array; a missing or wrongly typed list becomes an empty one."""
    return F.coalesce(F.transform(array, element), F.from_json(F.lit("[]"), ddl))


def normalize(parsed: DataFrame, signals_key: str = "signals", defaults: bool = True) -> DataFrame:
    """One projection from the raw record to the typed record.

    With `defaults=False` missing values stay null and text keeps its case, which is what the
    dataset profile counts.
    """
    if defaults:
        text, number, integer, flag = coerce.text, coerce.number, coerce.integer, coerce.boolean
        lowered, sentinel = coerce.lower_text, lambda c: coerce.number(c, -1)
        notice = lambda c: coerce.integer_or_default_if_zero(c, 60)
    else:
        text = lowered = lambda c, default="": c
        number = sentinel = coerce.number_or_null
        integer = notice = coerce.integer_or_null
        flag = lambda c: c.try_cast("boolean")
    year = coerce.integer_or_null
    profile, signals = F.col("profile"), F.col(f"`{signals_key}`")
    salary = signals[S.SALARY_KEY]

    def strings(source: Column, names) -> list[Column]:
        return [text(source[n]).alias(n) for n in names]

    def job(e: Column) -> Column:
        return F.struct(
            text(e["company"]).alias("company"), text(e["title"]).alias("title"),
            e["start_date"].alias("start_date"), e["end_date"].alias("end_date"),
            integer(e["duration_months"]).alias("duration_months"),
            flag(e["is_current"]).alias("is_current"),
            *strings(e, ("industry", "company_size", "description")))

    def school(e: Column) -> Column:
        return F.struct(
            *strings(e, S.EDUCATION_TEXT), year(e["start_year"]).alias("start_year"),
            year(e["end_year"]).alias("end_year"), e["grade"].alias("grade"),
            text(e["tier"], "unknown").alias("tier"))

    def skill(e: Column) -> Column:
        return F.struct(
            text(e["name"]).alias("name"), lowered(e["proficiency"], "beginner").alias("proficiency"),
            integer(e["endorsements"]).alias("endorsements"),
            integer(e["duration_months"]).alias("duration_months"))

    def certificate(e: Column) -> Column:
        return F.struct(*strings(e, ("name", "issuer")), year(e["year"]).alias("year"))

    def language(e: Column) -> Column:
        return F.struct(text(e["language"]).alias("language"),
                        lowered(e["proficiency"], "basic").alias("proficiency"))

    scores = F.transform_values(signals["skill_assessment_scores"],
                                lambda _, v: v.try_cast("double"))
    signal_fields = {
        **{n: number(signals[n]) for n in S.SIGNAL_NUMBERS},
        **{n: sentinel(signals[n]) for n in S.SIGNAL_SENTINELS},
        **{n: integer(signals[n]) for n in S.SIGNAL_COUNTS},
        **{n: flag(signals[n]) for n in S.SIGNAL_FLAGS},
        **{n: signals[n] for n in S.SIGNAL_DATES},
        "skill_assessment_scores": F.coalesce(scores, F.expr(_EMPTY_MAP)),
        "notice_period_days": notice(signals["notice_period_days"]),
        "expected_salary": F.struct(coerce.number_or_null(salary["min"]).alias("min_lpa"),
                                    coerce.number_or_null(salary["max"]).alias("max_lpa")),
        "preferred_work_mode": text(signals["preferred_work_mode"], "flexible"),
    }
    ddl = dict(_array_types())
    order = _signal_order()
    return parsed.select(
        "candidate_id",
        F.struct(*[(number if n == "years_of_experience" else text)(profile[n]).alias(n)
                   for n in _profile_order()]).alias("profile"),
        _each(F.col("career_history"), job, ddl["career_history"]).alias("career_history"),
        _each(F.col("education"), school, ddl["education"]).alias("education"),
        _each(F.col("skills"), skill, ddl["skills"]).alias("skills"),
        _each(F.col("certifications"), certificate, ddl["certifications"]).alias("certifications"),
        _each(F.col("languages"), language, ddl["languages"]).alias("languages"),
        F.struct(*[signal_fields[n].alias(n) for n in order]).alias("signals"))


def _record_type():
    from pyspark.sql.types import StructType
    return StructType.fromDDL(S.RECORD_DDL)


def _array_types():
    for f in _record_type().fields:
        if f.dataType.typeName() == "array":
            yield f.name, f.dataType.simpleString()


def _profile_order() -> list[str]:
    return _record_type()["profile"].dataType.fieldNames()


def _signal_order() -> list[str]:
    return _record_type()["signals"].dataType.fieldNames()


def untypable(signals_key: str = "signals") -> Column:
    """True when a number the record cannot do without is not a number."""
    profile, signals = F.col("profile"), F.col(f"`{signals_key}`")
    scalars = [profile["years_of_experience"], signals["notice_period_days"],
               *[signals[n] for n in (*S.SIGNAL_NUMBERS, *S.SIGNAL_SENTINELS, *S.SIGNAL_COUNTS)]]

    def any_entry(name: str, *fields: str) -> Column:
        bad = lambda e: reduce(or_, [coerce.unusable_number(e[f]) for f in fields])
        return F.coalesce(F.exists(F.col(name), bad), F.lit(False))

    return reduce(or_, [*[coerce.unusable_number(c) for c in scalars],
                        any_entry("career_history", "duration_months"),
                        any_entry("skills", "endorsements", "duration_months")])


# --- derived properties ----------------------------------------------------------------------

def tier_rank(tier: Column) -> Column:
    """1 for tier_1 up to 4; 5 for unknown and for anything else."""
    at = F.array_position(F.array(*[F.lit(t) for t in settings.EDUCATION_TIERS]), tier)
    return F.when(F.coalesce(at, F.lit(0)) == 0, F.lit(5)).otherwise(at).cast("int")


def highest_tier(education: Column, missing: str | None = None) -> Column:
    """Tier of the best entry, the first one among equals; 'none' without education."""
    tier = lambda e: F.coalesce(e["tier"], F.lit(missing)) if missing else e["tier"]
    ranked = F.transform(education, lambda e, i: F.struct(
        tier_rank(tier(e)).alias("rank"), i.alias("at"), tier(e).alias("tier")))
    return F.coalesce(F.array_min(ranked)["tier"], F.lit("none"))


def duration_years(entry: Column) -> Column:
    """Years between start and end; null unless both are known and not zero."""
    start, end = entry["start_year"], entry["end_year"]
    return F.when((start != 0) & (end != 0), end - start)


def salary_inverted(salary: Column) -> Column:
    return F.coalesce(salary["max_lpa"] < salary["min_lpa"], F.lit(False))


def salary_midpoint(salary: Column) -> Column:
    return F.when(salary["max_lpa"] >= salary["min_lpa"],
                  (salary["min_lpa"] + salary["max_lpa"]) / 2.0).otherwise(salary["min_lpa"])


def career_months(jobs: Column) -> Column:
    return arrays.total(jobs, lambda j: F.coalesce(j["duration_months"], F.lit(0)))


def implied_years(months: Column) -> Column:
    return numeric.round_exact(months / F.lit(12.0), 2)


def mean_assessment(scores: Column) -> Column:
    values = F.map_values(scores)
    return F.when(F.size(values) > 0, F.try_divide(
        arrays.total(values, lambda v: v, "double"), F.size(values).cast("double")))


def career_text(profile: Column, jobs: Column) -> Column:
    """Headline, summary, title, then title and description of each job; lowered."""
    present = lambda c: F.nullif(c, F.lit(""))
    return F.lower(F.concat_ws(
        " ", present(profile["headline"]), present(profile["summary"]),
        present(profile["current_title"]),
        F.flatten(F.transform(jobs, lambda j: F.array(present(j["title"]),
                                                      present(j["description"]))))))


def derive(records: DataFrame) -> DataFrame:
    """Add the derived properties to typed records."""
    signals, jobs = F.col("signals"), F.col("career_history")
    scores = signals["skill_assessment_scores"]
    months = records.withColumn("total_career_months", career_months(jobs))
    years = months.withColumn("implied_experience_years",
                              implied_years(F.col("total_career_months")))
    return years.withColumns({
        "experience_discrepancy": numeric.round_exact(
            F.col("profile.years_of_experience") - F.col("implied_experience_years"), 2),
        "skill_names": F.col("skills.name"),
        "n_skills": F.size("skills"),
        "n_jobs": F.size(jobs),
        "current_job": arrays.first_where(jobs, lambda j: j["is_current"]),
        "highest_education_tier": highest_tier(F.col("education")),
        "education_years": F.transform("education", duration_years),
        "salary_inverted": salary_inverted(signals["expected_salary"]),
        "salary_midpoint": salary_midpoint(signals["expected_salary"]),
        "has_github": signals["github_activity_score"] >= 0,
        "has_offer_history": signals["offer_acceptance_rate"] >= 0,
        "n_assessments": F.size(scores),
        "avg_assessment_score": mean_assessment(scores),
    })


def flatten(records: DataFrame, reference_date: str = settings.REFERENCE_DATE) -> DataFrame:
    """The wide table of the dataset profile: 46 columns, two dates, three derived columns.

    Takes records from `normalize(..., defaults=False)`, so that nulls show up as missing.
    """
    profile, signals, jobs = F.col("profile"), F.col("signals"), F.col("career_history")
    skills, scores = F.col("skills"), F.col("signals.skill_assessment_scores")
    months = career_months(jobs)
    company = F.transform(jobs, lambda j: F.coalesce(j["company"], F.lit("")))
    copies = {
        "profile_completeness": "profile_completeness_score", "open_to_work": "open_to_work_flag",
        "profile_views_30d": "profile_views_received_30d",
        "applications_30d": "applications_submitted_30d",
        "search_appearance_30d": "search_appearance_30d",
        "saved_by_recruiters_30d": "saved_by_recruiters_30d",
    }
    same = ("recruiter_response_rate", "avg_response_time_hours", "connection_count",
            "endorsements_received", "notice_period_days", "preferred_work_mode",
            "willing_to_relocate", "github_activity_score", "interview_completion_rate",
            "offer_acceptance_rate", "verified_email", "verified_phone", "linkedin_connected")
    flat = records.select(
        "candidate_id",
        *[profile[n].alias(n) for n in ("location", "country", "years_of_experience",
                                        "current_title", "current_company",
                                        "current_company_size", "current_industry")],
        F.size(jobs).alias("n_jobs"),
        months.alias("total_career_months"),
        implied_years(months).alias("implied_exp_years"),
        F.concat_ws("|", company).alias("companies_str"),
        F.size(F.array_distinct(company)).alias("unique_companies"),
        F.size("education").alias("n_edu"),
        highest_tier(F.col("education"), "tier_4").alias("highest_tier"),
        F.size(skills).alias("n_skills"),
        arrays.count_where(skills, lambda s: s["proficiency"] == "expert").alias("n_expert_skills"),
        arrays.count_where(skills, lambda s: s["proficiency"] == "advanced")
        .alias("n_advanced_skills"),
        F.concat_ws("|", F.col("skills.name")).alias("skills_str"),
        F.size("certifications").alias("n_certs"),
        F.size("languages").alias("n_langs"),
        *[signals[s].alias(n) for n, s in copies.items()],
        *[signals[n].alias(n) for n in same],
        signals["expected_salary"]["min_lpa"].alias("salary_min"),
        signals["expected_salary"]["max_lpa"].alias("salary_max"),
        F.size(scores).alias("n_assessments"),
        mean_assessment(scores).alias("avg_assessment_score"),
        coerce.iso_date(signals["signup_date"]).alias("signup_date"),
        coerce.iso_date(signals["last_active_date"]).alias("last_active_date"),
        F.size(F.array_intersect(F.col("skills.name"), F.array(
            *[F.lit(s) for s in settings.PROFILE_CORE_SKILLS]))).alias("n_ai_skills"))
    day = F.lit(reference_date).cast("date")
    return flat.withColumns({
        "days_since_active": F.datediff(day, F.col("last_active_date")),
        "days_since_signup": F.datediff(day, F.col("signup_date")),
        "exp_discrepancy": F.col("years_of_experience") - F.col("implied_exp_years"),
    })
