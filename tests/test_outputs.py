import json

import pytest
from pyspark.sql import functions as F

from conftest import CLEAN, changed
from credence import settings
from credence.operators import checks, normalize as N
from credence.operators.scoring import score_records
from credence.plans import audit, profile_report, rank_records
from credence.sources import documents as D, sinks
from credence.sources.csv_cells import read_csv_cells
from credence.streaming import scoring as stream


@pytest.fixture(scope="module")
def many(records):
    titles = ["Search Engineer", "Data Analyst", "ML Engineer"]
    return records(*[changed(
        candidate_id=f"CAND_{i:07d}", profile__current_title=titles[i % 3],
        profile__years_of_experience=float(i % 15), signals__recruiter_response_rate=i / 130,
        signals__last_active_date="2025-06-01" if i % 4 else "2020-01-01")
        for i in range(120)]).persist()


def codes(df):
    return sorted((r.check, r.place) for r in df.collect())


def test_good_and_bad_tables(many):
    listed = rank_records.ranked_list(many)
    assert listed.count() == 100 and checks.is_valid(checks.check_table(listed))
    assert codes(checks.check_table(listed.drop("rank"))) == [("columns", None)]
    short = rank_records.ranked_list(many.limit(7))
    assert {c for c, _ in codes(checks.check_table(short))} == {"row_count", "ranks"}


def write(path, rows, header="candidate_id,rank,score,reasoning"):
    path.write_text("\n".join([header, *rows]) + "\n")
    return str(path)


def test_file_checks(spark, tmp_path):
    good = [f"CAND_{i:07d},{i},{1 - i / 200:.4f},\"a, b\"" for i in range(1, 101)]
    assert codes(checks.check_file(spark, write(tmp_path / "ok.csv", [*good, " , , , "]))) == []
    bad = list(good)
    bad[0] = "CAND_0000001,01,0.9,x"          # not canonical
    bad[1] = "CAND_0000002,101,0.9,x"         # out of range
    bad[2] = "CAND_0000004,3,abc,x"           # no number; takes the id of the next row
    bad[4] = "CAND_0000005,5"                 # two cells
    bad[6] = "CAND_07,7,0.965,x"              # bad id
    bad[8] = ",9,0.955,x"                     # no id
    bad[10] = "CAND_0000011,12,0.945,x"       # repeats a rank
    bad[19] = "CAND_0000020,20,0.99,x"        # score rises
    bad[30] = "CAND_0000099,31,0.84,x"        # tie with the next in the wrong order; repeats later
    got = set(codes(checks.check_file(spark, write(tmp_path / "bad.txt", bad, "id,rank"))))
    assert {("suffix", None), ("header", 1), ("rank_integer", 2), ("rank_range", 3),
            ("score_number", 4), ("id_duplicate", 5), ("cells", 6), ("id_format", 8),
            ("id_required", 10), ("rank_duplicate", 13), ("score_order", 19),
            ("tie_order", 31), ("id_duplicate", 100)} <= got
    assert {p for c, p in got if c == "rank_missing"} == {1, 2, 5, 11}
    short = codes(checks.check_file(spark, write(tmp_path / "short.csv", good[:99])))
    assert short == [("rank_missing", 100), ("row_count", None)]


def test_file_as_a_whole(spark, tmp_path):
    good = [f"CAND_{i:07d},{i},{1 - i / 200:.4f},\"a,\n {'x' * 6000}\"\"b\"" for i in range(1, 101)]
    assert codes(checks.check_file(spark, write(tmp_path / "ok.csv", good))) == []
    (tmp_path / "latin.csv").write_bytes("candidate_id,rank,score,reasoning\n".encode()
                                         + "CAND_0000001,1,0.5,\xe9\n".encode("latin-1"))
    assert ("encoding", None) in codes(checks.check_file(spark, str(tmp_path / "latin.csv")))
    (tmp_path / "empty.csv").write_text("")
    assert {("encoding", None), ("header", 1)} <= set(
        codes(checks.check_file(spark, str(tmp_path / "empty.csv"))))
    (tmp_path / "open.csv").write_text("candidate_id,rank,score,reasoning\nCAND_0000001,1,1d,\"x")
    assert {("encoding", 2)} <= set(codes(checks.check_file(spark, str(tmp_path / "open.csv"))))
    suffix = ["CAND_0000001,1,1d,x"]
    assert ("score_number", 2) in codes(checks.check_file(spark, write(tmp_path / "s.csv", suffix)))
    quoted = "CAND_0000001,1,0.5,\"" + '""' * 3000 + '"'
    assert "cells" not in {c for c, _ in codes(checks.check_file(
        spark, write(tmp_path / "q.csv", [quoted])))}


def test_file_is_parsed_once(spark, tmp_path):
    """The checks read the parsed rows; the plan that joins them holds no CSV parser."""
    checked = checks.check_file(spark, write(tmp_path / "once.csv", ["CAND_0000001,1,0.5,x"]))
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "_noted(" not in plan and "_parsed(" not in plan
    assert ("row_count", None) in codes(checked)


def test_repeated_ids_in_the_list(many):
    twice = many.unionByName(many.filter("candidate_id = 'CAND_0000119'"))
    ids = lambda df: [r.candidate_id for r in df.collect()]
    kept = ids(rank_records.ranked_list(twice))
    best = ids(rank_records.ranked_list(twice, dedupe="best"))
    assert len(set(kept)) == 99 and len(set(best)) == 100
    with pytest.raises(Exception, match="repeated id"):
        rank_records.ranked_list(twice, dedupe="fail").collect()
    assert ids(rank_records.ranked_list(many, dedupe="fail")) == best


def test_scores_are_written_with_plain_digits(spark, tmp_path):
    df = spark.createDataFrame([("A", 1, 0.0005, "x, \"y\"\nz")],
                               "candidate_id string, rank int, score double, reasoning string")
    sinks.write_ranked_csv(df, str(tmp_path / "list"))
    rows = read_csv_cells(spark, str(tmp_path / "list")).filter("not is_header").head()
    assert rows.cells == ["A", "1", "0.0005", "x, \"y\"\nz"]


def test_whole_job(spark, tmp_path):
    source = tmp_path / "in.jsonl"
    source.write_text("\n".join(json.dumps(changed(
        candidate_id=f"CAND_{i:07d}", signals__recruiter_response_rate=i / 200))
        for i in range(130)) + "\n{broken\n")
    violations = rank_records.run(spark, str(source), str(tmp_path / "out"), "signals")
    assert violations.count() == 0
    listed = spark.read.option("header", True).csv(str(tmp_path / "out/ranked"))
    assert listed.count() == 100 and listed.columns == list(settings.RANKED_COLUMNS)
    assert listed.filter("rank = 1").head().candidate_id == "CAND_0000129"
    preview = spark.read.option("header", True).csv(str(tmp_path / "out/preview"))
    assert preview.count() == 25


def test_audits(spark, many, tmp_path):
    audit.run(many, str(tmp_path))
    read = lambda name: spark.read.option("header", True).csv(str(tmp_path / name))
    assert read("component_audit").count() == 100
    assert read("detailed").count() == 10 and len(read("detailed").columns) > 67
    assert sum(int(r.n) for r in read("archetypes").collect()) == 100
    evidence = read("evidence_audit")
    assert evidence.filter("domain = 'search' and matched_keyword = 'search engine'").count() > 0
    metrics = spark.read.json(str(tmp_path / "diagnostics"))
    assert metrics.filter("metric = 'score_distribution'").agg(F.sum("value")).head()[0] == 120
    assert metrics.filter("metric = 'trust_distribution' and key = 'reduced'").head().value == 60
    assert spark.read.json(str(tmp_path / "cohort")).head().n == 100


def test_profile_tables(spark, records, lines, tmp_path):
    table = records(CLEAN, changed(candidate_id="CAND_0000005"), changed(candidate_id="X",
                    signals__expected_salary_range_inr_lpa=None), defaults=False)
    profile_report.run(table, str(tmp_path), D.parse_lines(lines(
        CLEAN, changed(candidate_id="CAND_0000005"), changed(candidate_id="X"))))
    read = lambda name: spark.read.json(str(tmp_path / name))
    assert read("dashboard").head().n_records == 3
    assert {r.field for r in read("missing").collect()} == {"salary_min", "salary_max"}
    assert read("malformed_ids").head().candidate_id == "X"
    assert read("jobs").head().n_jobs == 6
    assert read("tiers").filter("value = 'tier_1'").head().n == 3
    assert read("histogram_experience").agg(F.sum("n")).head()[0] == 3
    assert read("key_presence").filter("field = 'skills'").head().n_present == 3


def test_profile_parses_each_document_once(spark, lines, tmp_path):
    """However many sections there are, the text is read by one job."""
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(part.num_rows)
            yield part
    source = lines(CLEAN, changed(candidate_id="B"))
    counted = source.mapInArrow(count, source.schema)
    profile_report.run(N.normalize(D.accepted(D.parse_lines(counted)), defaults=False),
                       str(tmp_path))
    assert seen.value == 2


def test_audit_scores_all_records_once(spark, many, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(part.num_rows)
            yield part
    audit.run(many.mapInArrow(count, many.schema), str(tmp_path))
    # Once for the scores, and once to pick out the records of the top k.
    assert seen.value == 240


def arriving(tmp_path, batches):
    folder = tmp_path / "arriving"
    folder.mkdir(exist_ok=True)
    for name, documents in batches.items():
        (folder / name).write_text("\n".join(json.dumps(d) for d in documents) + "\n{cut")
    return str(folder)


def test_streams_equal_batch(spark, records, tmp_path):
    make = lambda i, **more: changed(candidate_id=f"CAND_{i:07d}",
                                     signals__recruiter_response_rate=i / 100, **more)
    first, second = [make(i) for i in range(0, 30)], [make(i) for i in range(30, 60)]
    third = [make(59, signals__last_active_date="2020-01-01")]
    folder = arriving(tmp_path, {"a.jsonl": first, "b.jsonl": second})
    run = lambda name, start: start(
        D.read_record_stream(spark, folder, files_per_batch=1),
        str(tmp_path / name), str(tmp_path / f"{name}-state"))
    run("scores", stream.score_stream).awaitTermination()
    batch = score_records(records(*first, *second)).select(*stream.SCORE_COLUMNS)
    scores = spark.read.parquet(str(tmp_path / "scores"))
    assert scores.exceptAll(batch).count() == batch.exceptAll(scores).count() == 0

    lists = str(tmp_path / "lists")
    run("lists", stream.topk_stream).awaitTermination()
    ids = lambda **o: [r.candidate_id for r in stream.current_topk(spark, lists, **o).collect()]
    assert ids(k=5) == [f"CAND_{i:07d}" for i in range(59, 54, -1)]
    assert ids(k=5, upto=0) == [f"CAND_{i:07d}" for i in range(29, 24, -1)]
    # The best one arrives again with less trust: it falls out, and the next moves up.
    arriving(tmp_path, {"c.jsonl": third})
    run("lists", stream.topk_stream).awaitTermination()
    assert ids(k=5) == [f"CAND_{i:07d}" for i in range(58, 53, -1)]
    latest = stream.latest_scores(spark, lists)
    assert latest.count() == 60
    assert latest.filter("candidate_id = 'CAND_0000059'").head().trust_score < 1

    run("counts", stream.quality_stream).awaitTermination()
    counts = stream.last_counts(spark, str(tmp_path / "counts"))
    want = stream.quality_counts(records(*first, *second, *third))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.collect()))

    stream.arrival_stream(D.parse_lines(D.read_line_stream(spark, folder, 1)),
                          str(tmp_path / "arrivals"), str(tmp_path / "arrivals-state")
                          ).awaitTermination()
    totals = {r.outcome: r.n for r in stream.last_counts(spark, str(tmp_path / "arrivals")
                                                         ).collect()}
    assert totals == {"accepted": 61, "bad_json": 3}
