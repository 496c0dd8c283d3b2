import hashlib
import random
import re

import pytest

from credence.llm import decontaminate as D

SCHEMA = "doc_id long, text string, hits string, items int, row int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return [(m[0], m.start(), m.end()) for m in WORD.finditer(lowered)]


def plain_row(doc, text, items):
    found = plain_words(text or "")
    words = [w for w, *_ in found]
    hit, owners = set(), set()
    for item, body in items:
        ws = [w for w, *_ in plain_words(body or "")]
        for i in range(max(len(ws) - 9, min(len(ws), 1))):
            window = ws[i:i + 10]
            for k in range(len(words) - len(window) + 1):
                if words[k:k + len(window)] == window:
                    hit |= set(range(k, k + len(window)))
                    owners.add(item)
    listed = sorted(str(i) for i in owners if i is not None)
    spans = []
    for k in sorted(hit):
        if spans and k - 1 == spans[-1][2]:
            spans[-1] = (spans[-1][0], found[k][2], k)
        else:
            spans.append((found[k][1], found[k][2], k))
    return (doc, len(words), len(hit), len(listed),
            hashlib.sha256(",".join(listed).encode()).hexdigest(), [s[:2] for s in spans])


def table():
    rng = random.Random(7)
    word = lambda: rng.choice(["Über", "a1", "B", "日本語", "x", "y"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 10, 25]))))
             for i in range(12)] + [(3, "one more text of item three only here a b c d e"),
                                    (None, "nobody owns these words here at all is it so then"),
                                    (99, None)]
    items = [(i, t) for i, t in items if t is None or len(t.split()) not in (1, 3)] + [
        (50, "Short-Item answer"), (51, "10")]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 20)))]
        for _ in range(rng.randint(0, 2)):
            body = rng.choice([t for _, t in items if t])
            parts.append(rng.choice([body, body.upper(), body.replace(" ", "--\n"),
                                     " ".join(body.split()[1:])]))
            parts.append(word())
        docs.append((i, "é " + "; ".join(parts), "clash", 1, 2))
    docs += [(60, None, None, None, None), (61, "", "c", 1, 2), (None, docs[5][1], "c", 1, 2),
             docs[5], docs[5], (62, "filler ü " * 30_000 + "short ITEM answer", "c", 0, 0)]
    return docs, items


@pytest.mark.parametrize("automaton_words", [200_000, 20])
def test_equals_brute_force(spark, automaton_words):
    docs, items = table()
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.row.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256,
            [(s.start, s.end) for s in r.spans])
           for r in D.contamination(df, bench, automaton_words=automaton_words).collect()]
    short = [d for d in docs if d[0] != 62]
    expected = [plain_row(d[0], d[1], items) for d in short]
    assert sorted((g for g in got if g[0] != 62), key=str) == sorted(expected, key=str)
    (long,) = [g for g in got if g[0] == 62]
    assert long[1:3] == (60_003, 3)
    assert any(e[2] for e in expected) and any(not e[2] for e in expected)
    clean = D.decontaminated(df, bench)
    assert clean.columns == df.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted(
        (e[0] for e in expected if not e[2]), key=str)


def test_empty_tables(spark):
    docs, items = table()
    df = spark.createDataFrame(docs, SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.contamination(df.limit(0), bench).count() == 0
    none = D.contamination(df, bench.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.n_hit for r in none)
