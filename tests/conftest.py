import copy
import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from credence.operators.normalize import normalize  # noqa: E402
from credence.session import local_session  # noqa: E402
from credence.sources import documents as D  # noqa: E402

CLEAN = {
    "candidate_id": "CAND_0000001",
    "profile": {
        "anonymized_name": "A", "headline": "Senior NLP Engineer",
        "summary": "Building search engine and retrieval systems.", "location": "Pune",
        "country": "India", "years_of_experience": 6.0, "current_title": "ML Engineer",
        "current_company": "Acme", "current_company_size": "51-200", "current_industry": "IT"},
    "career_history": [
        {"company": "Acme", "title": "ML Engineer", "start_date": "2021-01-01", "end_date": None,
         "duration_months": 48, "is_current": True, "industry": "IT", "company_size": "51-200",
         "description": "Deployed ranking in production"},
        {"company": "Old", "title": "Engineer", "start_date": "2018-12-01",
         "end_date": "2020-12-01", "duration_months": 24, "is_current": False, "industry": "IT",
         "company_size": "1-10", "description": "Backend"}],
    "education": [{"institution": "U", "degree": "B.Tech", "field_of_study": "Computer Science",
                   "start_year": 2012, "end_year": 2016, "grade": None, "tier": "tier_1"}],
    "skills": [
        {"name": "Python", "proficiency": "expert", "endorsements": 30, "duration_months": 60},
        {"name": "NLP", "proficiency": "advanced", "endorsements": 60, "duration_months": 40},
        {"name": "Excel", "proficiency": "beginner", "endorsements": 1, "duration_months": 5}],
    "certifications": [{"name": "C", "issuer": "I", "year": 2020}],
    "languages": [{"language": "English", "proficiency": "Native"}],
    "signals": {
        "profile_completeness_score": 80, "signup_date": "2024-01-01",
        "last_active_date": "2025-06-01", "open_to_work_flag": True,
        "profile_views_received_30d": 10, "applications_submitted_30d": 2,
        "recruiter_response_rate": 0.8, "avg_response_time_hours": 5.5,
        "skill_assessment_scores": {"Python": 90.0}, "connection_count": 100,
        "endorsements_received": 50, "notice_period_days": 30,
        "expected_salary_range_inr_lpa": {"min": 20.0, "max": 30.0},
        "preferred_work_mode": "remote", "willing_to_relocate": False,
        "github_activity_score": 50.0, "search_appearance_30d": 20,
        "saved_by_recruiters_30d": 3, "interview_completion_rate": 0.9,
        "offer_acceptance_rate": 0.5, "verified_email": True, "verified_phone": True,
        "linkedin_connected": False},
}


def changed(**paths):
    """The clean document with some values replaced: `a__b__0__c=value`; DROP removes a key."""
    doc = copy.deepcopy(CLEAN)
    for path, value in paths.items():
        *parents, last = [int(p) if p.isdigit() else p for p in path.split("__")]
        target = doc
        for p in parents:
            target = target[p]
        if value is DROP:
            del target[last]
        else:
            target[last] = value
    return doc


DROP = object()


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def lines(spark):
    def make(*documents):
        texts = [d if isinstance(d, str) else json.dumps(d) for d in documents]
        return spark.createDataFrame([(t,) for t in texts], "value string")
    return make


@pytest.fixture(scope="session")
def records(lines):
    def make(*documents, defaults=True):
        return normalize(D.accepted(D.parse_lines(lines(*documents))), defaults=defaults)
    return make
