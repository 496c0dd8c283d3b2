import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.operators import objectives as O, ranking as R
from credence.settings import SCENARIOS

COLUMNS = ["a_score", "b_score", "c_score"]
OBJECTIVES = {"even": [1.0, 1.0, 1.0], "a": [1.0, 0.0, 0.0], "odd": [0.1, 0.7, -0.3],
              "zero": [0.0, 0.0, 0.0]}


def table(spark, n=3000, seed=1, kind="string"):
    rng = random.Random(seed)
    value = lambda: rng.choice([rng.random(), round(rng.random(), 1), 0.0])
    rows = [((f"k{i:05d}é"[:rng.randint(4, 7)] if kind == "string" else rng.randint(0, n)),
             value(), value(), value(), rng.choice([0.25, 0.5, 1.0])) for i in range(n)]
    rows += [(None, 1.0, 1.0, 1.0, 1.0), (rows[0][0], math.nan, 0.0, 0.0, 1.0),
             (rows[1][0], None, 1.0, 1.0, 1.0), (rows[2][0], 1.0, 1.0, 1.0, None),
             (rows[3][0], math.inf, 1.0, 1.0, 1.0), rows[5], rows[5]]
    rng.shuffle(rows)
    return spark.createDataFrame(
        rows, f"key {kind}, a_score double, b_score double, c_score double, trust double")


def expression(weights):
    total = F.lit(0.0)
    for c, w in zip(COLUMNS, weights):
        total = total + F.col(c) * F.lit(w)
    return total * F.col("trust")


@pytest.mark.parametrize("kind,k", [("string", 1), ("string", 50), ("bigint", 10),
                                    ("string", 5000)])
def test_equals_one_sort_per_objective(spark, kind, k):
    df = table(spark, kind=kind).repartition(7).cache()
    got = O.top_k_by_weights(df, COLUMNS, OBJECTIVES, "trust", k, "key").collect()
    for name, weights in OBJECTIVES.items():
        want = df.select("key", expression(weights).alias("s")).orderBy(
            F.desc("s"), F.asc("key")).limit(k).collect()
        mine = sorted((r for r in got if r.objective == name), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(want) + 1))
        same = lambda a, b: a == b or (a != a and b != b)
        assert all(same(m.score, w.s) and m.key == w.key for m, w in zip(mine, want)), name


def test_nothing_and_wrong_weights(spark):
    df = table(spark, 10)
    assert O.top_k_by_weights(df.limit(0), COLUMNS, OBJECTIVES, "trust", 5, "key").count() == 0
    with pytest.raises(ValueError):
        O.top_k_by_weights(df, COLUMNS, {"short": [1.0]}, "trust", 5, "key")


def test_sums_keep_their_order():
    rng = np.random.default_rng(0)
    values, factor = [rng.random(100) for _ in range(7)], rng.random(100)
    weights = rng.random((7, 3))
    got = O.weighted_scores(values, weights, factor)
    for i in range(100):
        for j in range(3):
            total = 0.0
            for v, w in zip(values, weights[:, j]):
                total = total + v[i] * w
            assert got[i, j] == total * factor[i]


def test_scenarios_read_the_rows_once(spark):
    df = spark.range(100).select(
        F.col("id").cast("string").alias("candidate_id"), F.rand(1).alias("trust_score"),
        *[F.rand(i).alias(f"{c}_score") for i, c in enumerate(R.COMPONENTS)])
    plan = R.scenario_overlaps(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1 and len(SCENARIOS) > 2
