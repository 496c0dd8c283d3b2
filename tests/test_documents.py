import json

import pytest
from pyspark.sql import Observation, functions as F

from conftest import CLEAN, DROP, changed
from credence import settings
from credence.functions.coerce import number_or_null
from credence.operators import normalize as N
from credence.sources import documents as D, sinks


def test_types_and_defaults(records):
    rows = records(
        {"candidate_id": "CAND_0000009"},
        changed(candidate_id="B", signals__notice_period_days=0),
        changed(candidate_id="C", signals__notice_period_days="45", profile=None),
        changed(candidate_id="D", signals__github_activity_score=None, skills="oops"),
        changed(candidate_id="E", skills__0__endorsements=3.7, skills__0__name=" \tPython\n",
                skills__0__proficiency=" EXPERT ", education__0__tier=DROP)).collect()
    by_id = {r.candidate_id: r for r in rows}
    empty = by_id["CAND_0000009"]
    assert (empty.skills, empty.career_history, empty.profile.headline) == ([], [], "")
    assert empty.signals.notice_period_days == 60
    assert empty.signals.github_activity_score == empty.signals.offer_acceptance_rate == -1
    assert empty.signals.expected_salary.min_lpa is None
    assert empty.signals.preferred_work_mode == "flexible"
    assert by_id["B"].signals.notice_period_days == 60
    assert by_id["C"].signals.notice_period_days == 45
    assert by_id["C"].profile.years_of_experience == 0
    assert by_id["D"].skills == [] and by_id["D"].signals.github_activity_score == -1
    skill = by_id["E"].skills[0]
    assert (skill.name, skill.proficiency, skill.endorsements) == ("Python", "expert", 3)
    assert by_id["E"].education[0].tier == "unknown"
    assert by_id["E"].languages[0].proficiency == "native"


def test_rejected_documents(spark, lines):
    whole = json.dumps(CLEAN)
    parsed = D.parse_lines(lines(CLEAN, "{bad json", whole[:300], changed(candidate_id=DROP),
                                 changed(skills__0__endorsements="many"), "[1]", "5"))
    reasons = sorted(r.reject_reason for r in D.quarantine(parsed).collect())
    assert reasons == ["bad_json"] * 4 + ["bad_value", "missing_id"]
    stats = D.load_stats(parsed).head()
    assert (stats.total_lines, stats.parsed_ok, stats.parse_errors) == (7, 1, 4)
    seen = Observation("documents")
    assert D.accepted(D.observed_stats(parsed, seen)).count() == 1
    assert seen.get == {"total_lines": 7, "parsed_ok": 1, "rejected": 6}
    with pytest.raises(Exception, match="unusable document"):
        D.accepted(parsed, "fail").collect()


def test_text_is_parsed_once(lines):
    table = N.normalize(D.accepted(D.parse_lines(lines(CLEAN))))
    assert table._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_derived_properties(records):
    row = N.derive(records(CLEAN)).head()
    assert (row.total_career_months, row.implied_experience_years) == (72, 6.0)
    assert (row.n_skills, row.n_jobs, row.current_job.company) == (3, 2, "Acme")
    assert row.skill_names == ["Python", "NLP", "Excel"]
    assert (row.highest_education_tier, row.education_years) == ("tier_1", [4])
    assert row.has_github and row.has_offer_history and not row.salary_inverted
    assert (row.salary_midpoint, row.n_assessments, row.avg_assessment_score) == (25.0, 1, 90.0)


def test_files(spark, tmp_path):
    source = tmp_path / "in.jsonl"
    renamed = changed(x_signals=CLEAN["signals"], signals=DROP)
    source.write_text("\n".join([json.dumps(renamed), "", "   ", "{oops"]))
    keys = ("signals", "x_signals")
    assert D.read_records(spark, str(source), keys).head().signals.connection_count == 100
    assert D.read_records(spark, str(source), keys, limit=1).count() == 1
    unread = D.parse_lines(D.read_lines(spark, str(source)), "signals")
    assert sorted(r.reject_reason for r in D.quarantine(unread).collect()) == [
        "bad_json", "missing_signals"]
    (tmp_path / "list.json").write_text(json.dumps([CLEAN, changed(candidate_id="B")], indent=1))
    assert D.read_json_array(spark, str(tmp_path / "list.json")).count() == 2


def test_mixed_layouts_keep_their_signals(spark, lines):
    other = changed(candidate_id="B", x_signals={**CLEAN["signals"], "connection_count": 7},
                    signals=DROP)
    bare = {"candidate_id": "C"}
    parsed = D.parse_lines(lines(CLEAN, other, bare), ("x_signals", "signals"))
    rows = {r.candidate_id: r.signals.connection_count
            for r in N.normalize(D.accepted(parsed)).collect()}
    assert rows == {"CAND_0000001": 100, "B": 7, "C": 0}


def test_json_lists(spark, tmp_path):
    renamed = changed(candidate_id="D", x_signals=CLEAN["signals"], signals=DROP)
    elements = [CLEAN, changed(candidate_id="B"), "oops", None, changed(candidate_id=DROP),
                changed(candidate_id="C", skills__0__endorsements="many"), renamed]
    (tmp_path / "list.json").write_text(json.dumps(elements, indent=1))
    (tmp_path / "one.json").write_text(json.dumps(CLEAN))
    (tmp_path / "cut.json").write_text(json.dumps([CLEAN])[:-5])
    (tmp_path / "none.json").write_text("[]")
    parsed = D.parse_lines(D.array_lines(spark, str(tmp_path)), ("signals", "x_signals"))
    assert {r.candidate_id for r in D.accepted(parsed).collect()} == {"CAND_0000001", "B", "D"}
    assert sorted(r.reject_reason for r in D.quarantine(parsed).collect()) == [
        "bad_json"] * 4 + ["bad_value", "missing_id"]
    assert D.read_json_array(spark, str(tmp_path / "list.json"),
                             ("signals", "x_signals")).count() == 3
    with pytest.raises(Exception, match="unusable document"):
        D.read_json_array(spark, str(tmp_path / "one.json"), on_error="fail").collect()


def test_number_text(spark):
    texts = ["1", "-2.5", ".5", "1e3", " 7 ", "1d", "30f", "0x10", "1_0", "", "abc", "5.", "inf"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.n for r in df.withColumn("n", number_or_null(F.col("t"))).collect()}
    assert [t for t in texts if got[t] is None] == ["1d", "30f", "0x10", "1_0", "", "abc"]
    assert (got[" 7 "], got["5."], got["1e3"]) == (7, 5, 1000)


def test_job_and_table_round_trip(spark, records, tmp_path):
    job = settings.JobSpec(role_title="Other", minimum_years=1.5,
                           domains={"nlp": True, "search": False})
    sinks.write_jobs(spark, [job], str(tmp_path / "jobs"))
    assert sinks.read_jobs(spark, str(tmp_path / "jobs")) == [job]
    sinks.write_features(records(CLEAN), str(tmp_path / "features"))
    assert sinks.read_features(spark, str(tmp_path / "features")).head().candidate_id == \
        "CAND_0000001"


def test_chunks(spark):
    rows = D.in_chunks(spark.range(0, 1003, 1, 7), 100, F.asc("id")).groupBy("chunk").count()
    assert {r.chunk: r["count"] for r in rows.collect()} == {**{i: 100 for i in range(10)}, 10: 3}


def test_key_presence(lines):
    rows = D.key_presence(lines(CLEAN, {"candidate_id": None}), ("candidate_id", "skills"))
    assert {r.field: r.n_present for r in rows.collect()} == {"candidate_id": 2, "skills": 1}


def test_flat_profile_keeps_nulls(records):
    row = N.flatten(records({"candidate_id": "A"}, defaults=False)).head()
    assert row.years_of_experience is None and row.highest_tier == "none"
    assert len(N.flatten(records(CLEAN, defaults=False)).columns) == 50
