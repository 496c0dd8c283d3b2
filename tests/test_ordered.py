import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from credence.operators import intervals, ordered, profile as P, ranking as R


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, many values are equal."""
    rng = random.Random(5)
    rows = [(i, 0 if i % 3 == 0 else rng.randint(1, 60), rng.randint(0, 40), rng.random())
            for i in range(4000)]
    # Small data would be coalesced into one slice, which would test nothing.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield rows, spark.createDataFrame(rows, "id long, k long, t long, v double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_rank_of_every_row(skewed):
    rows, df = skewed
    want = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), start=1)}
    got = ordered.ranked(df, F.desc("t"), F.asc("id"))
    assert {r.id: r["rank"] for r in got.collect()} == want


def test_running_total(skewed):
    rows, df = skewed
    want, total = {}, 0
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        want[r[0]] = total
        total += r[1]
    got = ordered.running_total(df, "k", F.asc("t"), F.asc("id"), name="before")
    assert {r.id: r.before for r in got.collect()} == want


def test_next_row_of_the_same_key(skewed):
    rows, df = skewed
    ordered_rows = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    want = {a[0]: (b[0] if a[1] == b[1] else None)
            for a, b in zip(ordered_rows, ordered_rows[1:])}
    want[ordered_rows[-1][0]] = None
    got = ordered.with_next(df, ["k"], [F.asc("t"), F.asc("id")], ["id"])
    assert {r.id: r.next_id for r in got.collect()} == want
    # The hot key really is spread over several slices.
    slices = ordered.sliced(df, F.asc("k"), F.asc("t"), F.asc("id")).filter("k = 0")
    assert slices.select(ordered.SLICE).distinct().count() > 1


def test_rows_are_shuffled_once(skewed):
    """After the range sort nothing but one row per slice is exchanged."""
    _, df = skewed
    plans = [ordered.with_next(df, ["k"], [F.asc("t"), F.asc("id")], ["id"]),
             ordered.running_total(df, "k", F.asc("t"), F.asc("id"), name="before")]
    for plan in plans:
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in text and "SortMergeJoin" not in text
        rows = [line for line in text.split("\n") if "Exchange hashpartitioning" in line
                or "Exchange rangepartitioning" in line]
        assert all("_slice" in line for line in rows) and len(rows) <= 1


def test_next_row_keeps_types_and_nulls(spark):
    rows = [(1, None, "a"), (1, None, None), (None, 2.5, "c"), (None, 1.5, "b"), (2, 1.0, "d")]
    df = spark.createDataFrame(rows, "k long, v double, s string").repartition(3)
    got = ordered.with_next(df, ["k"], [F.asc("v"), F.asc("s")], ["s", "v"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        (1, None, None, "a", None), (1, None, "a", None, None), (None, 1.5, "b", "c", 2.5),
        (None, 2.5, "c", None, None), (2, 1.0, "d", None, None)], key=str)
    assert ordered.with_next(df.limit(0), ["k"], [F.asc("v")], ["s"]).count() == 0


def test_top_k_per_group(skewed):
    rows, df = skewed
    frame = pd.DataFrame(rows, columns=["id", "k", "t", "v"]).sort_values(
        ["k", "t", "id"], ascending=[True, False, True])
    want = set(frame.groupby("k").head(3).id)
    got = R.top_k_per_group(df, ["k"], 3, F.desc("t"), F.asc("id"))
    assert {r.id for r in got.collect()} == want


def test_deduplicated(skewed):
    rows, df = skewed
    first = R.deduplicated(df, "k", "first", [F.asc("id")])
    assert first.count() == len({r[1] for r in rows})
    assert R.deduplicated(df, "k").count() == len(rows)
    assert R.deduplicated(df, "id", "fail").count() == len(rows)
    with pytest.raises(Exception, match="repeated id"):
        R.deduplicated(df, "k", "fail").count()


@pytest.mark.parametrize("exact", [True, False])
def test_quantiles(skewed, exact):
    rows, df = skewed
    frame = pd.DataFrame(rows, columns=["id", "k", "t", "v"])
    got = P.quantiles(df, ["k", "t", "v"], [0.0, 0.25, 0.5, 0.99, 1.0], exact)
    for r in got.collect():
        # A sketch answers with a value that occurs, next to the interpolated one.
        assert r.value == pytest.approx(frame[r.field].quantile(r.probability),
                                        abs=1e-12 if exact else 1.0)


def test_quantiles_select_any_doubles(spark):
    """Signs, zeros, infinities, numbers that differ in the last bit, columns with few values."""
    rng = np.random.default_rng(8)
    n = 3000
    near = np.full(n, 1.5).view(np.int64) + rng.integers(0, 400, n)
    frame = pd.DataFrame({
        "wide": rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n),
        "near": near.view(np.float64), "zero": rng.choice([0.0, -0.0, -1e-320, 1e-320], n),
        "ends": rng.choice([-np.inf, -1.0, 2.0], n), "one": np.where(np.arange(n) == 5, 7.25, np.nan),
        "none": np.full(n, np.nan), "same": np.full(n, -3.0)})
    df = spark.createDataFrame(frame).withColumn(
        "one", F.when(~F.isnan("one"), F.col("one"))).repartition(5)
    chances = [0.0, 0.1, 0.333, 0.5, 0.999, 1.0]
    got = {(r.field, r.probability): r.value
           for r in P.quantiles(df, list(frame.columns), chances).collect()}
    assert {f for f, _ in got} == set(frame.columns) - {"none"}
    for (field, p), value in got.items():
        values = np.sort(frame[field].dropna().to_numpy())
        at = p * (len(values) - 1)
        a, b = values[int(np.floor(at))], values[int(np.ceil(at))]
        with np.errstate(invalid="ignore"):
            want = a + (b - a) * (at - np.floor(at))
        assert value == want or np.isnan(value) and np.isnan(want), (field, p)


def test_quantiles_sort_no_rows(spark, monkeypatch):
    """The rows are read and counted; only bucket counts are shuffled, and no row is multiplied."""
    plans = []
    kept = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: (
        plans.append(self._jdf.queryExecution().executedPlan().toString()), kept(self))[1])
    df = spark.range(50_000).selectExpr("cast(id % 997 as double) as a", "id * 0.37 as b")
    rows = P.quantiles(df, ["a", "b"], [0.5, 0.99])
    assert 1 <= len(plans) <= 4
    for plan in plans:
        assert "rangepartitioning" not in plan and plan.count("MapInArrow") == 1
        # What is broadcast is one row per wanted bucket.
        below = plan[plan.index("MapInArrow"):].replace("BroadcastExchange", "")
        assert "Exchange" not in below and "Generate" not in below
    assert {(r.field, r.probability): r.value for r in kept(rows)}["a", 0.5] == np.quantile(
        np.arange(50_000) % 997, 0.5)
    empty = P.quantiles(df.limit(0), ["a"], [0.5])
    assert kept(empty) == []


def test_describe_ignores_nulls(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (100.0,)], "x double")
    row = P.describe(df, ["x"]).head()
    want = pd.Series([1.0, 2.0, 100.0]).describe()
    assert row["count"] == 3
    for mine, theirs in (("mean", "mean"), ("std", "std"), ("q25", "25%"), ("q50", "50%"),
                         ("q75", "75%"), ("max", "max")):
        assert row[mine] == pytest.approx(want[theirs])


@pytest.mark.parametrize("n_columns", [4, 13])
def test_correlation(spark, n_columns):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(500, n_columns)).round(2) + 1e3
    data[:, 1] = data[:, 0] * 2 + rng.normal(size=500)
    data[rng.random(data.shape) < 0.1] = -1
    data[::7, 2] = np.nan
    data[:, 3] = 5.0
    names = [f"c{i}" for i in range(n_columns)]
    frame = pd.DataFrame(data, columns=names)
    want = frame.replace(-1, np.nan).corr()
    got = P.correlation(spark.createDataFrame(frame).repartition(5), names)
    rows = {(r.field_a, r.field_b): r["corr"] for r in got.collect()}
    assert len(rows) == n_columns ** 2
    for (a, b), value in rows.items():
        if a != b and "c3" in (a, b):
            assert value is None
        elif a != b:
            assert value == pytest.approx(want.loc[a, b], abs=1e-9)
    assert P.correlation(spark.createDataFrame(frame), names, part="lower").count() == \
        n_columns * (n_columns - 1) // 2


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0, 1, 5, 9, 10, 10]] + [(None,)],
                               "x double")
    want, _ = np.histogram([0, 0, 1, 5, 9, 10, 10], bins=5)
    assert [r.n for r in P.histogram(df, "x", 5).orderBy("bin").collect()] == list(want)
    same = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert sum(r.n for r in P.histogram(same, "x", 4).collect()) == 2
    assert P.histogram(df.filter("x > 99"), "x", 4).count() == 0


def test_education_overlap_null_rules(spark):
    rows = [("a", 0, 2010, 2014), ("a", 1, 2013, 2015), ("a", 2, None, 2020),
            ("b", 0, 2010, None), ("b", 1, 2011, 2012)]
    df = spark.createDataFrame(rows, "candidate_id string, pos int, start_year long, "
                                     "end_year long")
    got = {r.candidate_id: r.n_overlaps for r in intervals.education_overlaps(df).collect()}
    assert got == {"a": 1, "b": 0}


def test_ndcg(spark):
    rows = [("x", i, g) for i, g in enumerate([0, 1, 0, 1])] + [("y", 0, 0)]
    df = spark.createDataFrame(rows, "q string, pos int, gain int")
    got = {r.q: r.ndcg for r in R.ndcg_at_k(df, "q", [F.asc("pos")], "gain", 3).collect()}
    assert got["x"] == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3)))
    assert got["y"] == 0.0


def test_pair_moments_equal_those_of_each_pair():
    rng = np.random.default_rng(8)
    n = 400
    x = np.column_stack([
        rng.normal(size=n), rng.normal(size=n) * 1e-3 + 1e9, np.full(n, 7.0),
        np.where(np.arange(n) < 200, 1e6, 1.0) + rng.normal(size=n) * 1e-3,
        np.where(np.arange(n) < 5, 2.0, 3.0), rng.integers(0, 3, n).astype(float),
        np.full(n, np.nan), np.where(np.arange(n) == 9, np.inf, rng.normal(size=n))])
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:5, 0] = np.nan                       # column 4 is 3 in all rows of column 0
    x[200:, 5] = np.nan
    places = [(a, b) for a in range(8) for b in range(8) if a < b]
    got = P._batch_moments(x, places)
    for (i, j), row in zip(places, got):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert row[0] == both.sum()
        if not both.any():
            assert (row[1:6] == 0).all() and np.isnan(row[6:]).all()
            continue
        a, b = x[both, i], x[both, j]
        for low, high, v in ((row[6], row[7], a), (row[8], row[9], b)):
            assert (low < high) == (v.min() < v.max())
        if np.isinf(a).any() or np.isinf(b).any():
            continue
        da, db = a - a.mean(), b - b.mean()
        assert row[1] == pytest.approx(a.mean(), rel=1e-12, abs=1e-12)
        # A mean is rounded to the digits a double has at its size.
        ra, rb = (10 * len(v) * np.spacing(abs(v.mean())) ** 2 for v in (a, b))
        assert row[3] == pytest.approx(da @ da, rel=1e-9, abs=1e-12 + ra)
        assert row[4] == pytest.approx(db @ db, rel=1e-9, abs=1e-12 + rb)
        scale = np.sqrt((da @ da) * (db @ db))
        assert abs(row[5] - da @ db) <= 1e-9 * scale + 1e-12
    assert P._batch_moments(x[:0], places).shape == (28, 10)
