import math
import random
import zlib

import numpy as np
import pytest

from credence.llm import toxicity as T

DOCS = "doc_id long, text string, toxic string, score double, terms string, share int"
RUDE = ["grumblefink", "snotwort", "ünhold", "barfling", "mudbrain"]


def corpus(n=1500, seed=4):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8)))
             for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(RUDE).upper()
        docs.append((i, ", ".join(words)))
        if rng.random() < 0.5:
            labels.append((i, int(toxic)))
    docs += [(n, None), (n + 1, ""), (None, "grumblefink snotwort"), (n + 2, "!? 12 _"),
             (n + 3, "la " * 100_000 + "snotwort mudbrain"), docs[3], docs[3]]
    labels += [(None, 1), (2, None), (n + 50, 1), labels[0], (7, 0), (7, 1), (7, 1)]
    return [(*d, "t", 0.1, "x", 1) for d in docs], labels


def truth(text):
    return any(r.upper() in (text or "") for r in RUDE)


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    got = T.toxicity(spark.createDataFrame(docs, DOCS).repartition(4),
                     spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs)
    texts = {d[0]: d[1] for d in docs}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None
                              and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert list(r.cosines) == sorted(r.cosines, reverse=True)
        assert len(r.neighbours) == len(r.cosines) <= T.NEIGHBOURS
    judged = [(truth(texts[r.doc_id]), r.predicted) for r in got
              if r.held_out and r.doc_id < 1500]
    hits = sum(t and p for t, p in judged)
    assert hits >= 0.95 * sum(t for t, _ in judged) and hits >= 0.95 * sum(p for _, p in judged)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1500].score == by_id[1501].score < 0.1            # without words
    assert by_id[1503].predicted == 1 and by_id[None].predicted == 1
    near = by_id[1503].neighbours
    assert near and not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in near)


def test_index_equals_all_cosines():
    rng = np.random.default_rng(1)
    idf = rng.uniform(1, 6, 50)
    rows = []
    for i in range(700):
        t = np.sort(rng.choice(50, rng.integers(1, 6), replace=False, p=np.arange(50, 0, -1) / 1275))
        rows.append((int(i), bool(rng.random() < 0.4), t.tolist(),
                     rng.integers(1, 4, len(t)).tolist()))
    rows += [(5000 + i, False, rows[i][2], rows[i][3]) for i in range(100)] + [(9000, True, [], [])]
    index = T.BlockMaxIndex(rows, idf)

    def vector(t, c):
        v = np.zeros(50)
        v[t] = (1 + np.log(c)) * idf[t]
        return v / np.linalg.norm(v)

    ids = np.array([r[0] for r in rows if r[2]])
    matrix = np.array([vector(r[2], r[3]) for r in rows if r[2]])
    for q in range(0, 300, 7):
        _, _, t, c = rows[q]
        for k, without in ((1, None), (15, q), (100, None), (2000, None)):
            cosine = np.round(matrix @ vector(t, c) / T._STEP)
            if without is not None:
                cosine[ids == without] = 0
            order = [j for j in np.lexsort((ids, -cosine)) if cosine[j] > 1][:k]
            at, got = index.nearest(t, c, k, without)
            assert index.ids[at].tolist() == ids[order].tolist()
            assert np.allclose(got, np.minimum(cosine[order] * T._STEP, 1))


def test_curve_never_falls_and_fits_rates():
    rng = np.random.default_rng(2)
    shares = np.round(rng.uniform(0, 1, 4000), 2)
    toxic = (rng.uniform(0, 1, 4000) < shares ** 2).astype(float)
    at, rate = T._monotone(shares, toxic)
    assert (np.diff(rate) >= 0).all() and (np.diff(at) > 0).all()
    for s in (0.2, 0.5, 0.9):
        assert abs(np.interp(s, at, rate) - s ** 2) < 0.1


@pytest.mark.parametrize("kind", ["empty", "no labels", "one class"])
def test_little_to_learn(spark, kind):
    docs, labels = corpus(60)
    df = spark.createDataFrame(docs, DOCS)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    if kind == "empty":
        assert T.toxicity(df.limit(0), known).collect() == []
    elif kind == "no labels":
        got = T.toxicity(df, known.limit(0)).collect()
        assert len(got) == len(docs) and {r.score for r in got} == {0.0}
    else:
        got = T.toxicity(df, known.where("toxic = 0")).collect()
        assert len(got) == len(docs) and len({r.score for r in got}) == 1
        assert {r.predicted for r in got} == {0}


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels = corpus(300)
    df = spark.createDataFrame(docs, DOCS)
    turned = [(i, 1 - y if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5 == 0
               else y) for i, y in labels]
    scores = [sorted((str(r.doc_id), r.score) for r in T.toxicity(
        df, spark.createDataFrame(some, "doc_id long, toxic int")).collect())
        for some in (labels, turned)]
    assert scores[0] == scores[1] and not any(math.isnan(s) for _, s in scores[0])


def test_words_are_counted_inside_the_tasks(spark):
    """One row of counts leaves a task, whatever the number of words of a text."""
    rng = random.Random(9)
    rows = [(i, sorted(rng.sample(range(40), rng.randint(0, 40)))) for i in range(300)]
    rows = [(i, t, [1] * len(t)) for i, t in rows]
    df = spark.createDataFrame(rows, T._VECTORS_SQL).repartition(6)
    expected = [sum(t in terms for _, terms, _ in rows) for t in range(41)]
    assert T.document_counts(df, 41).tolist() == expected
    assert T.document_counts(df.limit(0), 3).tolist() == [0, 0, 0]
    assert T.document_counts(df, 0).tolist() == []
