import os
import random

import pyarrow.parquet as pq
import pytest

from credence.streaming.latest import LatestScores

COLUMNS = "candidate_id string, raw_score double, trust_score double, final_score double"


def scores(spark, rows):
    return spark.createDataFrame([(i, s, 1.0, s) for i, s in rows], COLUMNS).repartition(1)


def expected(batches, k):
    latest = {}
    for rows in batches:
        latest.update(rows)
    return sorted(latest.items(), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))[:k]


def arriving(n, rng, ids=300):
    out = {}
    for _ in range(n):
        out[f"id{rng.randrange(ids):04d}"] = rng.choice([round(rng.random(), 2), rng.random()])
    return list(out.items())


def held(path):
    """Rows in all folders of the state."""
    return sum(pq.read_metadata(f"{folder}/{f}").num_rows
               for kind in ("batch", "generation") for folder, _, files in os.walk(path / kind)
               for f in files if f.endswith(".parquet"))


def listed(df):
    return [(r.candidate_id, r.final_score) for r in df.collect()]


def test_twenty_batches_with_repeated_ids(spark, tmp_path):
    rng = random.Random(5)
    state = LatestScores(spark, str(tmp_path), least_rows=60, share=0.5, band_rows=40)
    batches, rows = [], []
    for b in range(20):
        batches.append(arriving(40, rng, ids=60))
        state.add(scores(spark, batches[-1]), b)
        rows.append(held(tmp_path))
        if b % 4 == 3:
            assert listed(state.top(25)) == expected(batches, 25)
    assert sorted(listed(state.latest())) == sorted(expected(batches, 1000))
    # Two generations of 60 ids and the batches of two rounds, however many rows have arrived.
    assert max(rows) <= 2 * 60 + 2 * (60 + 40) < sum(map(len, batches)) / 1.5
    kept = state._numbers("generation")
    assert len(kept) == 2 and min(state._numbers("batch")) > kept[0]
    with pytest.raises(ValueError):
        state.top(5, upto=0)


def test_a_list_reads_the_changed_ids_and_the_first_bands(spark, tmp_path):
    rows = [(f"id{i:04d}", i / 1000) for i in range(1000)]
    state = LatestScores(spark, str(tmp_path), least_rows=1000, band_rows=100)
    state.add(scores(spark, rows), 0)
    state.add(scores(spark, [("id0999", 0.0), ("id0998", 0.0005), ("new", 2.0)]), 1)
    top = state.top(5)
    assert listed(top) == [("new", 2.0), ("id0997", 0.997), ("id0996", 0.996),
                           ("id0995", 0.995), ("id0994", 0.994)]
    read = [f for f in top.inputFiles() if "generation=" in f]
    assert len(read) == 1 and len(state._generation(0).inputFiles()) > 8


def test_run_again_after_a_failure(spark, tmp_path):
    rng = random.Random(6)
    state = LatestScores(spark, str(tmp_path), least_rows=60, band_rows=50)
    batches = [arriving(30, rng) for _ in range(6)]
    for b, rows in enumerate(batches):
        state.add(scores(spark, rows), b)
        if b in state._numbers("band"):
            # As if the job had ended before the table of bands was whole.
            os.remove(f"{tmp_path}/band/band={b}/_SUCCESS")
            assert listed(state.top(10)) == expected(batches[:b + 1], 10)
        state.add(scores(spark, rows), b)
        assert listed(state.top(10)) == expected(batches[:b + 1], 10)
    assert state._numbers("band")


def test_nothing_and_null_scores(spark, tmp_path):
    state = LatestScores(spark, str(tmp_path), least_rows=2)
    assert state.top(3).collect() == [] and state.latest().collect() == []
    state.add(scores(spark, []), 0)
    assert state.top(3).collect() == []
    state.add(scores(spark, [("a", None), ("b", 0.5), ("c", 0.5)]), 1)
    assert listed(state.top(3)) == [("b", 0.5), ("c", 0.5), ("a", None)]
