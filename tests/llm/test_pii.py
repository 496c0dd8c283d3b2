import hashlib
import random
import re

import pytest

from credence.llm import pii as P

SCHEMA = "doc_id long, text string, spans string, n_chars int, row int"


def card(rng, n=16):
    digits = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return digits + next(c for c in "0123456789" if P.luhn(digits + c))


def sentence(rng):
    return " ".join(rng.choice(["thané", "of", "ther,", "in.", "Über"]) for _ in range(6))


def person(rng):
    kind = rng.randrange(4)
    if kind == 0:
        return f"{rng.choice('abc')}{rng.randrange(99)}.x@mail{rng.randrange(9)}.example.com"
    if kind == 1:
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == 2:
        return card(rng)
    return f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"


def corpus(n=250, seed=1):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        parts = [sentence(rng)]
        for _ in range(rng.randrange(4)):
            parts += [person(rng), sentence(rng)]
        if i % 9 == 0:
            parts.append("token = \"%040x\" v2.0 AKIA%d" % (rng.getrandbits(160), i))
        docs.append((i, " ".join(parts), "clash", 0, 1))
    return docs + [(n, None, None, None, None), (n + 1, "", "", 0, 0), docs[1], docs[1],
                   (None, "call +1 (222) 555-1234 4111111111111111", "", 0, 0),
                   (n + 2, "w0rd " * 30_000 + "a@b.co " + "1" * 60_000, "", 0, 0)]


def plain_spans(text):
    """The patterns as they are stated."""
    out = []
    for kind, pattern in enumerate((
            r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
            r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and P.luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "1", "23", "@", ".", "-", " ", "+", "(", ")", "é", "255",
                                   "a@b.c", "4111111111111111", "\n"])
                       for _ in range(rng.randrange(25)))
        assert P.base_spans(text) == plain_spans(text), text
    for _, text, *_ in corpus(60):
        if text and len(text) < 10_000:
            assert P.base_spans(text) == plain_spans(text)


@pytest.fixture(scope="module")
def labelled():
    sample = sorted({t[a:b] for _, t, *_ in corpus(600, 5) if t and len(t) < 10_000
                     for a, b in P.passages(t)})
    random.Random(1).shuffle(sample)
    return [(s, P._disjoint(P.base_spans(s))) for s in sample]


def test_held_out_accuracy(labelled):
    half = len(labelled) // 2
    model = P.fit(labelled[:half])
    right = found = gold = 0
    for text, spans in labelled[half:]:
        for new, labels in P.variants(text, spans):
            got = set(model.decode(new))
            right, found, gold = right + len(got & set(labels)), found + len(got), \
                gold + len(labels)
    assert right / found > 0.97 and right / gold > 0.97


def test_model_splits_what_the_patterns_run_together(labelled):
    model = P.fit(labelled[:300])
    text = "call +1 (222) 555-1234 4111111111111111 now"
    assert P.base_spans(text) == []
    assert [(text[a:b], P.KINDS[k]) for a, b, k, _ in P.all_spans(text, model)] == [
        ("+1 (222) 555-1234", "phone"), ("4111111111111111", "card")]
    assert P.all_spans("version 2.0 of 2024-01-31, AKIA99 and 12", model) == []


def test_made_passages_alone_teach_the_kinds():
    model = P.fit(P.made_passages())
    held = P.made_passages(200, seed=1)
    right = sum(set(model.decode(t)) == set(spans) for t, spans in held)
    assert right >= 0.97 * len(held)


def test_best_segmentation_equals_brute_force(labelled):
    model = P.fit(labelled[:100])
    for text, _ in labelled[100:140]:
        n, offsets, segments = P.candidates(text)
        if n > 14:
            continue
        scores = model.scores(segments).max(1)

        def best(at):
            options = [0.0] if at >= n else [best(at + 1)]
            options += [s + best(j) for (i, j, _), s in zip(segments, scores) if i == at]
            return max(options)
        chosen = model.decode(text)
        total = sum(s for (i, j, _), s, k in zip(segments, scores, model.scores(
            segments).argmax(1)) if (offsets[i], offsets[j], k) in chosen)
        assert abs(total - best(0)) < 1e-9


def test_rows_and_redaction(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    model = P.train(df)
    assert len(model.index) > 50
    rows = P.personal_data(df, model, carry=["doc_id"]).withColumn(
        "listed", P.listed(P.F.col("spans"))).withColumn(
        "ips", P.counted(P.F.col("spans"), "ip")).collect()
    assert len(rows) == len(docs)
    expected = sorted((str(d[0]), [(s[0], s[1], P.KINDS[s[2]]) for s in P.base_spans(d[1] or "")])
                      for d in docs)
    assert sorted((str(r.row.doc_id), [(s.start, s.end, s.kind) for s in r.spans if s.base])
                  for r in rows) == expected
    for r in rows:
        assert r.listed == ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans)
        assert r.ips == sum(s.kind == "ip" for s in r.spans)
        taken = [s for s in r.spans if s.base]
        for s in r.spans:
            assert s.base or not any(s.start < b.end and b.start < s.end for b in taken)
    clean = P.redacted(df, model)
    assert clean.schema.simpleString() == df.schema.simpleString()
    out = clean.collect()
    assert len(out) == len(docs)
    for r in out:
        if r.text is not None:
            assert not P.all_spans(r.text, model) and r.n_chars == len(r.text)


def test_redacted_text_and_empty_tables(spark):
    assert P.redact_text("ab3456789012x!", [(2, 9, 1, True), (5, 12, 2, True),
                                            (12, 13, 3, False)]) == "ab[IP][PHONE]!"
    assert P.redact_text("abc", []) == "abc" and P.redact_text("1", [(0, 1, 0)]) == "[EMAIL]"
    df = spark.createDataFrame([], SCHEMA)
    model = P.train(df)
    assert P.personal_data(df, model).count() == 0
    assert P.all_spans("1.2.3.4 " + hashlib.sha1(b"").hexdigest(), model) == [(0, 7, 1, True)]


@pytest.mark.parametrize("gap", [" ", "  ", "\n", " \r\n"])
def test_held_out_accuracy_in_running_text(labelled, gap):
    """Variants inside sentences, their spaces replaced by other white space."""
    half = len(labelled) // 2
    model = P.fit(labelled[:half] + P.made_passages())
    right = found = gold = 0
    for text, spans in labelled[half:]:
        for new, labels in P.variants(text, spans):
            moved = lambda at: 10 + at + new.count(" ", 0, at) * (len(gap) - 1)
            wanted = {(moved(a), moved(b), k) for a, b, k in labels}
            running = f"Über x to {new.replace(' ', gap)} then, of."
            got = {s[:3] for s in P.all_spans(running, model)}
            right, found, gold = right + len(got & wanted), found + len(got), gold + len(wanted)
    assert right / found > 0.95 and right / gold > 0.95


def test_spaced_and_broken_data_is_found(labelled):
    model = P.fit(labelled[:300] + P.made_passages())
    for text, kind in [("john.smith @ mail.example.com", "email"),
                       ("john @ mail.example.com", "email"), ("(555)\n123-4567", "phone"),
                       ("4111 1111  1111 1111", "card"), ("4111 1111\n1111 1111", "card")]:
        got = P.all_spans(f"write to {text} now", model)
        assert [(a, b, P.KINDS[k]) for a, b, k, _ in got] == [(9, 9 + len(text), kind)], text
    for text in ("meet @ noon", "one @", "@ two", "lines 12\n34 and 5\n\n67"):
        assert P.all_spans(text, model) == []
    assert [t[a:b] for t in ["4111\n\n1111", "a @\n\nb"] for a, b in P.passages(t)] == [
        "4111", "1111", "a @"]
