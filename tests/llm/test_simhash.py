import random

import numpy as np
import pytest
import xxhash

from credence.llm import simhash
from credence.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, root int"


def plain_print(text, words=3):
    found = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(found[i:i + words]) for i in range(len(found) - words + 1)] \
        or ([b" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    value = 0
    for bit in range(64):
        if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes):
            value |= 1 << bit
    return value


def plain_groups(prints, radius=3):
    """prints: (id, fingerprint) pairs -> sorted (id, print, smallest id of the component)."""
    label = list(range(len(prints)))
    changed = True
    values = np.array([p for _, p in prints], np.uint64)
    near = [np.flatnonzero(np.bitwise_count(values ^ v) <= radius) for v in values]
    while changed:
        changed = False
        for i, n in enumerate(near):
            least = min(label[j] for j in n)
            if least < label[i]:
                label[i], changed = least, True
    smallest = {}
    for (i, _), g in zip(prints, label):
        if i is not None:
            smallest[g] = min(smallest.get(g, i), i)
    return sorted(((i, p, smallest.get(g)) for (i, p), g in zip(prints, label)), key=str)


def result(df, **options):
    return sorted(((r.doc_id, r.fp % 2 ** 64, r.component_id)
                   for r in simhash.near_duplicates(df, **options).collect()), key=str)


def test_fingerprint_equals_the_definition():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 4, 50, 70_000):
        text = " ".join(rng.choice(["A", "bé", "Über", "c,", "日本"]) for _ in range(n))
        if n <= 50:
            assert simhash.fingerprint(text.encode()) % 2 ** 64 == plain_print(text)
        else:
            assert simhash.fingerprint(text.encode()) == simhash.fingerprint(
                text.replace(" ", "\n\t").encode())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    out, n = [], 0
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 5, 400, 900]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append((n, " ".join(copy), "x", 1))
            n += 1
    out += [(n, None, None, None), (n + 1, "", "x", 2), (n + 1, "", "x", 2),
            (None, "w1 w2", None, 3), (None, "only null ids here", "y", 4),
            (n + 2, "Ä " * 30_000, "z", 5)]
    return out


@pytest.mark.parametrize("shard_rows", [4096, 2])
def test_groups_equal_brute_force(spark, rows, shard_rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    expected = plain_groups([(i, plain_print(t)) for i, t, *_ in rows])
    assert result(df, shard_rows=shard_rows) == expected
    assert any(i is not None and c != i for i, _, c in expected)


@pytest.mark.parametrize("chunk,shard_rows", [(8, 2), (64, 8), (65536, 4096)])
def test_dense_ball_across_cut_buckets(spark, monkeypatch, chunk, shard_rows):
    """All fingerprints in few buckets: links found over shard borders are the same."""
    rng = random.Random(2)
    prints = sorted({rng.getrandbits(64) & 0xFFFF | sum(1 << rng.randrange(16, 64)
                     for _ in range(2)) for _ in range(300)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    monkeypatch.setattr(simhash, "_CHUNK", chunk)
    df = spark.createDataFrame([(p, p, None) for p in signed],
                               "node long, fp long, sketch array<long>")
    root = {r.node: r.root for r in
            connected_components(simhash.links(df, shard_rows=shard_rows)).collect()}
    got = {}
    for p in signed:
        got.setdefault(root.get(p, p), set()).add(p % 2 ** 64)
    expected = {}
    for i, _, c in plain_groups([(p, p) for p in prints]):
        expected.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_bk_search_visits_only_edges_within_the_radius():
    rng = np.random.default_rng(3)
    prints = np.unique(rng.integers(0, 1 << 20, 500, dtype=np.uint64))
    edges, children = simhash.bk_tree(prints, np.zeros(len(prints), np.int64))
    for edge, child in zip(edges, children):
        assert bin(int(prints[edge // 65] ^ prints[child])).count("1") == edge % 65
    q, node = simhash.bk_search(prints, np.zeros(len(prints), np.int64), prints, edges,
                                children, 3)
    expected = {(i, j) for i in range(len(prints)) for j in np.flatnonzero(
        np.bitwise_count(prints ^ prints[i]) <= 3).tolist()}
    assert set(zip(q.tolist(), node.tolist())) == expected


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(200, x) for x in range(201, 280)]
    pairs += [(1, 2), (2, 1), (3, 3), (5, 4)]
    rng.shuffle(pairs)
    df = spark.createDataFrame(pairs + [(None, 7)], "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    expected = {i: 100 for i in range(101, 161)} | {i: 200 for i in range(201, 280)}
    assert got == expected | {2: 1, 5: 4}
    assert connected_components(df.limit(0)).count() == 0


def jaccard(a, b, words=5):
    sets = [{tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))}
            for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited(rng, base, share, vocabulary):
    return [rng.choice(vocabulary) if rng.random() < share else w for w in base]


@pytest.mark.parametrize("shard_rows", [4096, 8])
def test_similar_texts_are_found_and_others_left(spark, shard_rows):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, n, of = [], 0, {}
    for group in range(60):
        base = [rng.choice(vocabulary[:200] if rng.random() < 0.4 else vocabulary)
                for _ in range(rng.randint(60, 700))]
        for k in range(rng.randint(1, 5)):
            rows.append((n, " ".join(edited(rng, base, 0.012 if k else 0, vocabulary)), "x", 1))
            of[n] = group
            n += 1
    group_of = {}
    for r in simhash.similar_groups(spark.createDataFrame(rows, SCHEMA).repartition(3),
                                    shard_rows=shard_rows).collect():
        group_of.setdefault(r.component_id, set()).add(r.doc_id)
    texts = {r[0]: r[1] for r in rows}
    for members in group_of.values():
        assert len({of[m] for m in members}) == 1
    together = {m: c for c, ms in group_of.items() for m in ms}
    close = [(a, b) for a in texts for b in texts if a < b and of[a] == of[b]
             and jaccard(texts[a], texts[b]) >= 0.85]
    hit = sum(together[a] == together[b] for a, b in close)
    assert len(close) > 100 and hit / len(close) > 0.95


def test_sketches_estimate_the_similarity():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    errors = []
    for share in [0.0, 0.01, 0.02, 0.05, 0.2] * 20:
        base = [rng.choice(vocabulary) for _ in range(300)]
        other = edited(rng, base, share, vocabulary)
        a, b = (np.array(simhash.sketch(" ".join(t).encode()), np.int64).astype(np.uint64)
                for t in (base, other))
        differ = int(np.bitwise_count(a ^ b).sum())
        errors.append(1 - differ / 128 - jaccard(" ".join(base), " ".join(other)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_keep_one_keeps_columns_and_one_row_of_each_group(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    groups = simhash.similar_groups(df).collect()
    out = kept.collect()
    assert len(out) == len({r.root for r in groups})
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == sorted(
        {r.component_id for r in groups if r.component_id is not None})
    for repeated in {r[1] for r in rows}:      # of equal texts one stays at most
        assert sum(r.text == repeated for r in out) <= 1


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_one(df).count() == 0


def blocks_and_edits(rng, kind, base, vocabulary, similarity):
    """A copy of `base` that comes near a five-word Jaccard similarity."""
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    n, lost = len(base), 1 - similarity
    if kind == "appended":
        return base + fresh(int(n * lost / similarity) - 4)
    if kind == "prepended":
        return fresh(int(n * lost / similarity) - 4) + base
    if kind == "removed":
        at = rng.randrange(n // 2)
        return base[:at] + base[at + int(n * lost) - 4:]
    out = list(base)
    for _ in range(int(n * lost / 10)):
        at = rng.randrange(len(out))
        if kind == "inserted":
            out.insert(at, rng.choice(vocabulary))
        elif kind == "deleted":
            del out[at]
        else:
            out[at] = rng.choice(vocabulary)
    return out


@pytest.mark.parametrize("shard_rows", [1024, 8])
def test_pairs_are_found_by_every_kind_of_edit(spark, shard_rows):
    """Of all pairs at 0.8 or more, by brute force, nearly all are grouped, whatever the edit."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    kinds = ["appended", "prepended", "removed", "inserted", "deleted", "replaced"]
    texts, pairs = {}, []
    for kind in kinds:
        for i in range(60):
            base = [rng.choice(vocabulary[:200] if rng.random() < 0.4 else vocabulary)
                    for _ in range(rng.randint(120, 700))]
            copy = blocks_and_edits(rng, kind, base, vocabulary, 0.82 + i % 3 * 0.05)
            n = len(texts)
            pairs.append((kind, n, n + 1))
            texts |= {n: " ".join(base), n + 1: " ".join(copy)}
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], SCHEMA).repartition(3)
    of = {r.doc_id: r.component_id for r in
          simhash.similar_groups(df, shard_rows=shard_rows).collect()}
    for kind in kinds:
        close = [(a, b) for k, a, b in pairs if k == kind and jaccard(texts[a], texts[b]) >= 0.8]
        assert len(close) >= 30
        assert sum(of[a] == of[b] for a, b in close) >= len(close) - 1


def test_groups_are_those_of_the_exact_similarity(spark):
    """Pairs just below 0.8 stay apart, pairs at or just above it do not."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts, expected = {}, {}
    for i in range(200):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(150, 400))]
        copy = blocks_and_edits(rng, "appended", base, vocabulary, 0.73 + i % 14 * 0.01)
        n = len(texts)
        texts |= {n: " ".join(base), n + 1: " ".join(copy)}
        expected |= {n: n, n + 1: n if jaccard(texts[n], texts[n + 1]) >= 0.8 else n + 1}
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], SCHEMA).repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df, bands=40).collect()}
    assert got == expected
    assert 60 < sum(i != c for i, c in expected.items()) < 140


def test_spanning_links_equal_brute_force():
    rng = np.random.default_rng(13)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 62, 60)
        for _ in range(5):
            own = np.where(rng.random(60) < 0.07, rng.integers(0, 1 << 62, 60), base)
            sets.append(np.unique(own.astype(np.uint64)))
    sketches = np.array([simhash._bits(simhash._least(s)) for s in sets]).astype(np.uint64)
    a, b = simhash.similar_links(np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets]),
                                 sketches, 0.8, 256)
    share = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    assert all(share(sets[x], sets[y]) >= 0.8 for x, y in zip(a, b))
    pairs = [(x, y) for x in range(len(sets)) for y in range(x)
             if share(sets[x], sets[y]) >= 0.8]
    label = simhash._spanning(len(sets), *np.array(pairs).T)
    assert np.array_equal(simhash._spanning(len(sets), a, b), label)
    assert 0 < len(a) < len(sets) - 40


def test_candidates_are_the_fingerprints_that_the_trees_find(spark, monkeypatch):
    """Texts meet by their SimHash fingerprints in a BK-tree; the exact check comes behind it."""
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(words[:150] + ["x"] + words[150:]), " ".join(words[::-1])]
    prints = [simhash.fingerprint(t.encode(), 5, distinct=True) for t in texts]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    got = simhash.signatures(df, "doc_id", "text", 5, 20, 5).collect()
    assert {r.doc_id: r.fp for r in got} == dict(enumerate(prints))
    far = bin((prints[0] ^ prints[1]) % 2 ** 64).count("1")
    assert 0 < far <= 24
    for radius, groups in ((far, [0, 0, 2]), (far - 1, [0, 1, 2])):
        found = simhash.similar_groups(df, radius=radius).collect()
        assert [r.component_id for r in sorted(found, key=lambda r: r.doc_id)] == groups
    sets = [np.unique(np.array(simhash._hashes(t.encode(), 5), np.uint64)) for t in texts]
    searches, search = [], simhash.bk_search
    monkeypatch.setattr(simhash, "bk_search", lambda *a: searches.append(a[5]) or search(*a))
    a, b = simhash.similar_links(np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets]),
                                 np.array(prints, np.int64).astype(np.uint64)[:, None], 0.8, 24)
    assert (a.tolist(), b.tolist()) == ([1], [0]) and set(searches) == {24}
