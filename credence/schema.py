"""Schemas of the nested record.

`raw_schema` reads every leaf as text, so one wrongly typed leaf cannot void its neighbours; the
typed columns come from the projection in `operators.normalize`.  The name of the top-level
object that holds the platform signals differs between producers, so it is a parameter.
"""

from __future__ import annotations

from pyspark.sql import types as T

PROFILE_TEXT = ("anonymized_name", "headline", "summary", "location", "country", "current_title",
                "current_company", "current_company_size", "current_industry")
JOB_TEXT = ("company", "title", "industry", "company_size", "description")
EDUCATION_TEXT = ("institution", "degree", "field_of_study")

SIGNAL_NUMBERS = ("profile_completeness_score", "recruiter_response_rate",
                  "avg_response_time_hours", "interview_completion_rate")
SIGNAL_SENTINELS = ("github_activity_score", "offer_acceptance_rate")
SIGNAL_COUNTS = ("profile_views_received_30d", "applications_submitted_30d", "connection_count",
                 "endorsements_received", "search_appearance_30d", "saved_by_recruiters_30d")
SIGNAL_FLAGS = ("open_to_work_flag", "willing_to_relocate", "verified_email", "verified_phone",
                "linkedin_connected")
SIGNAL_DATES = ("signup_date", "last_active_date")

SALARY_KEY = "expected_salary_range_inr_lpa"
CORRUPT = "_corrupt"


def _texts(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def raw_schema(*signals_keys: str) -> T.StructType:
    """JSON shape with text leaves, plus the slot that receives an unparsable document."""
    array = lambda *names: T.ArrayType(T.StructType(_texts(*names)))
    signals = T.StructType(
        _texts(*SIGNAL_NUMBERS, *SIGNAL_SENTINELS, *SIGNAL_COUNTS, *SIGNAL_FLAGS, *SIGNAL_DATES,
               "notice_period_days", "preferred_work_mode")
        + [T.StructField("skill_assessment_scores", T.MapType(T.StringType(), T.StringType())),
           T.StructField(SALARY_KEY, T.StructType(_texts("min", "max")))])
    return T.StructType([
        T.StructField("candidate_id", T.StringType()),
        T.StructField("profile", T.StructType(_texts(*PROFILE_TEXT, "years_of_experience"))),
        T.StructField("career_history", array(*JOB_TEXT, "start_date", "end_date",
                                              "duration_months", "is_current")),
        T.StructField("education", array(*EDUCATION_TEXT, "start_year", "end_year", "grade",
                                         "tier")),
        T.StructField("skills", array("name", "proficiency", "endorsements", "duration_months")),
        T.StructField("certifications", array("name", "issuer", "year")),
        T.StructField("languages", array("language", "proficiency")),
        *[T.StructField(key, signals) for key in signals_keys or ("signals",)],
        T.StructField(CORRUPT, T.StringType()),
    ])


RECORD_KEYS = ("candidate_id", "profile", "career_history", "education", "skills",
               "certifications", "languages")

# Typed record, as produced by operators.normalize.
RECORD_DDL = """
candidate_id string,
profile struct<anonymized_name: string, headline: string, summary: string, location: string,
  country: string, years_of_experience: double, current_title: string, current_company: string,
  current_company_size: string, current_industry: string>,
career_history array<struct<company: string, title: string, start_date: string, end_date: string,
  duration_months: bigint, is_current: boolean, industry: string, company_size: string,
  description: string>>,
education array<struct<institution: string, degree: string, field_of_study: string,
  start_year: bigint, end_year: bigint, grade: string, tier: string>>,
skills array<struct<name: string, proficiency: string, endorsements: bigint,
  duration_months: bigint>>,
certifications array<struct<name: string, issuer: string, year: bigint>>,
languages array<struct<language: string, proficiency: string>>,
signals struct<profile_completeness_score: double, signup_date: string,
  last_active_date: string, open_to_work_flag: boolean, profile_views_received_30d: bigint,
  applications_submitted_30d: bigint, recruiter_response_rate: double,
  avg_response_time_hours: double, skill_assessment_scores: map<string, double>,
  connection_count: bigint, endorsements_received: bigint, notice_period_days: bigint,
  expected_salary: struct<min_lpa: double, max_lpa: double>, preferred_work_mode: string,
  willing_to_relocate: boolean, github_activity_score: double, search_appearance_30d: bigint,
  saved_by_recruiters_30d: bigint, interview_completion_rate: double,
  offer_acceptance_rate: double, verified_email: boolean, verified_phone: boolean,
  linkedin_connected: boolean>
"""
