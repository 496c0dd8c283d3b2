import math

import pytest
from pyspark.sql import functions as F

from conftest import CLEAN, changed
from credence import settings
from credence.functions import numeric, text as T
from credence.operators import explain, features as X, normalize as N, scoring as C
from credence.operators.ranking import top_ranked
from credence.plans import rank_records


def test_features_of_a_record(records):
    row = X.features(records(CLEAN)).head().asDict()
    assert len(row) == 67
    assert (row["total_skill_count"], row["ai_skill_count"], row["expert_skill_count"]) == (3, 2, 1)
    assert row["proficiency_weighted_skill_score"] == 7.0
    assert row["endorsement_weighted_skill_score"] == 4 * 30 + 3 * 50
    assert (row["tier1_count"], row["cs_degree_flag"], row["ai_degree_flag"]) == (1, 1, 0)
    assert row["evidence_retrieval"] == pytest.approx(math.log1p(2))
    assert row["evidence_ranking"] == pytest.approx(math.log1p(2))
    assert row["evidence_production_ml"] == pytest.approx(math.log1p(1))
    assert row["engagement_score"] == 0.4 * 0.8 + 0.4 * 0.9 + 0.2 * 0.8
    assert row["verification_score"] == pytest.approx(0.2 * 3 + 0.2 / 3)
    assert row["availability_score"] == 1.0
    assert row["production_score"] == 0.25 and row["confidence_category"] == "Medium Confidence"


def test_no_history_at_all(records):
    row = C.score_records(records({"candidate_id": "CAND_0000009"})).head()
    assert (row.total_jobs, row.avg_job_duration_months, row.min_job_duration_months) == (0, 0, 0)
    assert row.highest_education_tier == "none" and row.education_score == 0
    assert row.experience_score == row.skill_score == row.domain_score == 0


# Published feature values and scores of two records.
PUBLISHED = [
    (dict(implied_experience_years=8.83, proficiency_weighted_skill_score=37.0,
          endorsement_weighted_skill_score=1589.0,
          evidence=[2.5649493574615367, 3.091042453358316, 1.0986122886681098, 0.0, 0.0, 0.0,
                    2.3978952727983707, 1.6094379124341003, 1.791759469228055,
                    1.9459101490553132],
          education_count=2, tier1_count=2, cs_degree_flag=0, ai_degree_flag=1,
          engagement_score=0.7826000000000002, verification_score=0.8666666666666667,
          availability_score=1.0, trust_score=1.0, capability_score=1.0, pipeline_score=1.0,
          production_score=0.75, experience_quality_score=0.5), 0.7790123111631216),
    (dict(implied_experience_years=7.17, proficiency_weighted_skill_score=38.0,
          endorsement_weighted_skill_score=1010.0,
          evidence=[2.70805020110221, 3.1780538303479458, 0.0, 0.0, 0.0, 0.0,
                    2.5649493574615367, 2.0794415416798357, 1.3862943611198906,
                    2.1972245773362196],
          education_count=2, tier1_count=2, cs_degree_flag=0, ai_degree_flag=1,
          engagement_score=0.76, verification_score=0.9333333333333333,
          availability_score=1.0, trust_score=1.0, capability_score=0.9, pipeline_score=1.0,
          production_score=0.75, experience_quality_score=0.75), 0.7701929337203305),
]


def feature_rows(spark, *rows):
    names = list(settings.EVIDENCE_KEYWORDS)
    flat = []
    for row in rows:
        values = {k: v for k, v in row.items() if k != "evidence"}
        values |= {f"evidence_{n}": v for n, v in zip(names, row["evidence"])}
        flat.append({**values, "tier2_count": 0, "tier3_count": 0, "tier4_count": 0})
    return spark.createDataFrame(flat)


def test_published_scores(spark):
    rows = C.score_features(feature_rows(spark, *[r for r, _ in PUBLISHED])).collect()
    got = {r.implied_experience_years: r.final_score for r in rows}
    for row, score in PUBLISHED:
        assert got[row["implied_experience_years"]] == pytest.approx(score, abs=1e-15)


def test_strong_and_weak_vectors(spark):
    strong = dict(PUBLISHED[0][0], evidence=[3.5] * 10, implied_experience_years=8.0,
                  capability_score=0.0, pipeline_score=0.0, production_score=0.0,
                  experience_quality_score=0.0, engagement_score=1.0, verification_score=1.0)
    weak = dict(strong, evidence=[0.0] * 10, implied_experience_years=1.0, education_count=0,
                proficiency_weighted_skill_score=0.0, endorsement_weighted_skill_score=0.0,
                engagement_score=0.1, verification_score=0.0, availability_score=0.0,
                trust_score=0.25)
    rows = {r.trust_score: r for r in C.score_features(feature_rows(spark, strong, weak)).collect()}
    assert rows[1.0].final_score > 0.9 and rows[1.0].domain_score == 1.0
    assert rows[0.25].final_score < 0.1


@pytest.mark.parametrize("years,score", [(2.99, 0), (3, .6), (4.5, .9), (5, 1), (12, 1),
                                         (14, .9), (40, .5)])
def test_experience_curve(spark, years, score):
    row = spark.range(1).select(F.lit(float(years)).alias("implied_experience_years"))
    assert row.select(C.base_experience().alias("s")).head().s == pytest.approx(score)


def test_rounding_follows_the_stored_value(spark):
    values = [8.35, 7.25, 2.675, 0.77905, 0.5, 1.5, 2.5, -0.5, 0.00005, 1e-12, 123456.78905]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 4):
        got = rows.select("v", numeric.round_exact(F.col("v"), digits).alias("r")).collect()
        assert all(r.r == round(r.v, digits) for r in got), digits


@pytest.mark.parametrize("text,word,window,expected", [
    ("Vector SEARCH engines", "search", 3, "...or SEARCH en..."),
    ("search", "search", 40, "search"), ("nothing", "search", 40, ""),
    ("a\nsearch\nb", "search", 2, "a search b")])
def test_snippet(spark, text, word, window, expected):
    row = spark.createDataFrame([(text, word)], "t string, w string")
    assert row.select(T.snippet(F.col("t"), F.col("w"), window).alias("s")).head().s == expected


def test_reasoning(records):
    listed = rank_records.ranked_list(records(
        CLEAN, changed(candidate_id="CAND_0000002", signals__notice_period_days=0),
        changed(candidate_id="CAND_0000003", signals__last_active_date="2020-01-01")))
    lines = {r.candidate_id: r.reasoning for r in listed.collect()}
    assert lines["CAND_0000001"] == ("Designed retrieval systems. 6.0 yrs YOE, production "
                                     "ownership. Medium Confidence.")
    assert lines["CAND_0000002"].endswith(" 60-day notice period.")
    assert lines["CAND_0000003"].endswith(" Additional verification recommended.")


def test_reasoning_length_limit(spark):
    for length, cut in ((180, False), (181, True)):
        row = spark.range(1).select(T.truncated(F.lit("x" * length), 180, 177).alias("s")).head()
        assert len(row.s) == 180 and row.s.endswith("...") == cut


def test_audit_row(records):
    row = explain.audit_rows(rank_records.select_top(records(CLEAN))).head()
    assert (row.weaknesses, row.why_ranked) == ("None", "Balanced score profile")
    assert row.capability_coverage == "1/10" and row.technical_strengths == "Retrieval"
    late = explain.audit_rows(rank_records.select_top(records(changed(
        signals__notice_period_days=90, signals__verified_email=False,
        signals__verified_phone=False)))).head()
    assert late.weaknesses == "90d notice, Few verifications"


@pytest.mark.parametrize("title,name", [
    ("Lead Search Scientist", "Search Engineer"), ("LLM Dev", "NLP Engineer"),
    ("CV Lead", "Computer Vision Engineer"), ("CV", "ML Engineer / General AI"),
    ("Applied Data", "Applied ML Engineer"), ("Data Analyst", "Data Scientist")])
def test_archetypes(spark, title, name):
    row = spark.range(1).select(F.lit(title).alias("title"))
    assert row.select(explain.archetype("title").alias("a")).head().a == name


def test_equal_rounded_scores_rank_by_id(spark):
    rows = spark.createDataFrame(
        [("b", 0.50001), ("a", 0.50004), ("d", 0.50002), ("c", 0.9)], "candidate_id string, "
        "final_score double")
    got = [(r.candidate_id, r.rank) for r in top_ranked(rows, 3).collect()]
    assert got == [("c", 1), ("a", 2), ("b", 3)]


def test_batch_and_alternative_formulas(records):
    row = C.alternative_scores(N.derive(records(CLEAN))).head()
    assert row.boosted_skill_score == pytest.approx(4 + 3)
    assert row.fractional_trust == 1.0
    assert row.relocation_availability == pytest.approx(.5 + .5 * (1 - 30 / 180))
