import math
import random

import numpy as np
import pytest

from credence.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, key string, x int, white double, copies long"


def table(dim=6, n=300, seed=3):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dim, dim))
    vectors = (rng.normal(size=(n, dim)) @ mix).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000 + i, rows[7][1]) for i in range(400)]            # a third and more of all rows
    rows += [rows[9], rows[9], (None, rows[3][1]), (2000, None), (2001, []),
             (2002, [None] + [1.0] * (dim - 1)), (2003, [math.nan] * dim),
             (2004, [math.inf] + [0.0] * (dim - 1)), (2005, [1.0] * (dim - 1)),
             (2006, [1e30] * dim), (2007, [-0.001] + [0.0] * (dim - 1))]
    random.Random(1).shuffle(rows)
    return [(*r, "k", 5, 0.5, 3) for r in rows]


def expected(rows, dim, counted):
    usable = [(i, v) for i, v, *_ in rows
              if v and len(v) == dim and all(c is not None and math.isfinite(c) and abs(c) < 1e9
                                             for c in v)]
    grid = [tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for _, v in usable]
    fit = grid if counted else list(dict.fromkeys(grid))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for (i, _), x in zip(usable, grid):
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        white = np.array([(n * a - s) / n for a, s in zip(x, sums)]) @ vectors / np.sqrt(values)
        out.setdefault(i, []).append((n, deviation, white))
    return out, values / values.sum(), len(usable)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_equals_plain_arithmetic(spark, weights):
    rows = table()
    want, explained, usable = expected(rows, 6, weights == "count")
    got = W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5), weights).collect()
    assert len(got) == usable * 6
    ids = {}
    for r in got:
        ids.setdefault(r.vec_id, []).append(r)
    assert set(ids) == set(want)
    signs = {}
    for i, held in ids.items():
        assert len(held) == 6 * len(want[i])
        for r in held:
            n, deviation, white = want[i][0]
            assert (r.n, r.deviation) == (n, deviation)
            value = white[r.component - 1]
            if abs(value) > 1e-6:
                signs.setdefault(r.component, set()).add(round(r.whitened / value, 6))
            assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9)
            assert r.identity_error < 1e-9
    assert all(s in ({1.0}, {-1.0}) for s in signs.values()) and len(signs) == 6


def test_at_most_sixteen_components_and_no_empty_ones(spark):
    rng = np.random.default_rng(5)
    flat = rng.normal(size=(200, 20))
    flat[:, 4:] = 0.25                                              # sixteen without variance
    rows = [(i, v.tolist()) for i, v in enumerate(flat)]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r.component for r in got.collect()} == {1, 2, 3, 4}
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 20)))]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == set(range(1, 17)) and len(got) == 3200
    assert got[0].identity_error < 1e-6


def test_nothing_to_whiten(spark):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA)
    for some in (df.limit(0), df.where("vec_id = 2000"), df.where("vec_id between 1000 and 1010")):
        got = W.whiten(some)
        assert got.count() == 0
        assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "double",
                                              "double", "double"]
    with pytest.raises(ValueError):
        W.whiten(df, weights="two")


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(i * 10 ** 11), float((i * 7919) % 13)]) for i in range(50)]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    grid = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*grid)]
    for r in got:
        exact = sum((50 * a - s) ** 2 for a, s in zip(grid[r.vec_id], sums))
        assert r.deviation == (exact if exact < 1 << 63 else None)
    assert got[0].identity_error < 1e-6
