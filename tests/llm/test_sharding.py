import random
import zlib
from collections import defaultdict

import pytest

from credence.llm import sharding as S

SCHEMA = "doc_id long, text string, size int, shard string, key string"


def table(seed=1):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice("ab é日") for _ in range(rng.choice([0, 5, 80, 200]))), 1, "x",
             "k") for i in range(2000)]
    hot = "copied text " * 6
    rows += [(i, hot, 1, "x", "k") for i in range(2000, 3000)]
    rows += [(3000, None, None, None, None), (None, "no id", 1, "", ""), rows[7], rows[7],
             (3001, "y" * 6000, 0, "", "")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("min_ranges", [16, 1024])
def test_law_of_bytes(spark, min_ranges):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = S.shard(df, min_ranges=min_ranges).collect()
    expected = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
                      for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == expected
    total = sum(e[1] for e in expected)
    sizes, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[r.text_crc32].add(r.shard)
    assert sorted(sizes) == list(range(8))
    assert max(sizes.values()) - min(sizes.values()) <= 6001 + 4 * total / min_ranges
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    hot = zlib.crc32(("copied text " * 6).encode())
    assert [len(s) for c, s in homes.items() if c != hot and len(s) > 1] == []
    assert len(homes[hot]) > 1


def test_equal_runs_and_small_tables(spark):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA)
    again = df.repartition(2, "text")
    key = lambda d: sorted((str(r.doc_id), r.shard) for r in S.shard(d).collect())
    assert key(df) == key(again)
    assert S.shard(df.limit(0)).count() == 0
    one = S.shard(spark.createDataFrame(rows[:1], SCHEMA)).collect()
    assert len(one) == 1 and one[0].slot == 0
    same = S.shard(spark.createDataFrame([(i, "same") for i in range(800)],
                                         "doc_id long, text string")).groupBy("shard").count()
    assert {r["count"] for r in same.collect()} == {100}


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame(table()[:50], SCHEMA)
    plan = S.shard(df)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
