"""A fast part of the comparison with SQL; `oracle_check.py` runs all of it."""

import glob
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog import queries, view
from credence.sources.tables import spread
from oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    """The training-data operators are tested on their own where SQL cannot express them."""
    others = {q for q in entry.queries() if q not in entry.LLM_QUERIES}
    assert others <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [
    "quarantine_counts", "rules_anomaly", "rules_forensic", "weighted_score", "reasoning",
    "interval_overlap_window", "gap_to_next", "describe", "output_checks", "weight_sensitivity"])
def test_equals_sql(spark, name):
    problems = compare(spark, connect(FOLDER), entry.queries()[name], entry.oracle_sql()[name],
                       FOLDER)
    assert problems == []


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["candidate_id", "rank", "score", "reasoning"]
    assert rows.count() == 100


@pytest.mark.parametrize("name", ["lookup_default", "anti_membership"])
def test_exploded_entries_are_not_broadcast(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def _sizes(folder, pattern):
    return sorted(os.path.getsize(p) for p in glob.glob(f"{folder}/{pattern}", recursive=True))


def test_documents_are_written_compressed_and_not_shuffled(spark, tmp_path, monkeypatch):
    """Lists and lines of a run take less than half of their bytes as plain text."""
    folders = {}
    monkeypatch.setattr(queries, "fresh_path", lambda _, label: folders.setdefault(
        label, str(tmp_path / label)))
    plain = view.as_json(view.load(spark, FOLDER, raw=True)).agg(
        F.sum(F.octet_length("value"))).first()[0]
    for name, label in (("json_array_records", "lists"), ("stream_arrivals", "arriving"),
                        ("read_limit", "lines")):
        assert entry.queries()[name](spark, FOLDER).count() > 0
        assert 0 < sum(_sizes(folders[label], "**/part-*")) < plain / 2, name


def test_a_micro_batch_is_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "fresh_path", lambda _, label: str(tmp_path / label))
    for name in ("stream_quality", "stream_topk_updates"):
        folder = tmp_path / name
        monkeypatch.setattr(queries, "fresh_path", lambda _, label: str(folder / label))
        entry.queries()[name](spark, FOLDER)
        parts = 5
        files = _sizes(folder / "arriving", "part-*")
        assert len(files) == parts * spark.sparkContext.defaultParallelism


def test_tasks_stay_short_on_larger_tables(spark):
    assert spread(spark.range(1000), rows=100).rdd.getNumPartitions() == 10
    assert spread(spark.range(10), rows=100).rdd.getNumPartitions() == 4


@pytest.mark.parametrize("name", [
    "json_array_records", "stream_arrivals", "stream_topk_updates", "stream_score", "stream_topk",
    "stream_quality", "read_limit", "load_stats"])
def test_rewritten_input_equals_sql(spark, name):
    assert compare(spark, connect(FOLDER), entry.queries()[name], entry.oracle_sql()[name],
                   FOLDER) == []


@pytest.mark.parametrize("name,steps", [("ranked_deduplicated", 1), ("trust_fell_out", 0),
                                        ("deep_audit", 0), ("output_check_table", 0)])
def test_scores_are_made_once(spark, name, steps):
    """None is left in a plan that reads what was kept."""
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == steps


def test_all_ranks_read_their_scores_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(i):
        seen.add(1)
        return float(i)

    monkeypatch.setattr(queries, "scores", lambda *_: spark.range(50, numPartitions=3).select(
        F.col("id").cast("string").alias("candidate_id"), counted("id").alias("final_score")))
    assert queries.rank_all_scored(spark, FOLDER).count() == 50
    assert seen.value == 50


@pytest.mark.parametrize("name", ["ranked_deduplicated", "trust_fell_out", "deep_audit",
                                  "output_check_table", "rank_all_scored"])
def test_scored_once_equals_sql(spark, name):
    assert compare(spark, connect(FOLDER), entry.queries()[name], entry.oracle_sql()[name],
                   FOLDER) == []


def test_entries_are_made_by_the_batch(spark):
    """No entry of a record is made by an interpreted lambda, and only the wanted arrays are made."""
    records = view.load(spark, FOLDER)
    plan = lambda *names: records.select(*names)._jdf.queryExecution().executedPlan().toString()
    made = plan("career_history", "skills", "education")
    assert "lambdafunction" not in made and "jobs(" in made
    assert "jobs(" not in plan("skills") and "Python" not in plan("candidate_id")


def test_entries_of_one_order(spark):
    """The first skill of this order has no name; an order without number has no entries."""
    orders = spark.sql("SELECT * FROM VALUES (2407L, 24L, 1.5D, TIMESTAMP '1995-02-27 00:00:00'), "
                       "(CAST(NULL AS BIGINT), 24L, 1.5D, TIMESTAMP '1995-02-27 00:00:00') "
                       "AS t(o_orderkey, o_custkey, o_totalprice, o_orderdate)")
    rows = {r.candidate_id: r for r in view.records(orders).collect()}
    row = rows["CAND_0002407"]
    job = row.career_history[3]
    assert [j.company for j in row.career_history] == ["Co24", "Co25", "Co26", "Co27"]
    assert (job.title, job.start_date, job.end_date, job.duration_months, job.is_current) == (
        "Product Manager", "1994-01-16", None, 25, True)
    assert job.description == ("owned end-to-end deployment on Kubernetes and RAG with LangChain, "
                               "later production serving at scale")
    assert [s.name for s in row.skills] == ["", "RAG", "BM25", "Statistics", "Excel", "PEFT",
                                            "FAISS"]
    assert tuple(row.skills[4]) == ("Excel", "expert", 52, 51)
    assert [tuple(e) for e in row.education] == [
        ("Univ2", "PhD", "Economics", 2002, 2006, None, "tier_2")]
    assert rows[None].career_history is None and rows[None].education is None
