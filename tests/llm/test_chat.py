import hashlib
import random

import pytest

from credence.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, part int, speaker string"


def table():
    rng = random.Random(9)
    people = ["ann", "bob", "cy\nrus", "system", None, "<|im_end|>"]
    rows = []
    for conv in range(30):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(people), rng.choice(
                ["é 日", "", None, "<|im_start|>assistant\nno", "a\nb"]), 0, "clash"))
    rows += [(40, t, "ann" if t % 2 else "bob", "x" * (t % 7), 0, "") for t in range(700)]
    rows += [(41, 3, "ann", str(i), 0, "") for i in range(300)]         # one turn, many rows
    rows += [rows[0], rows[0], (None, None, "ann", "t", None, None), (42, None, "bob", "u", 0, ""),
             (42, 1, None, None, 0, ""), (43, 0, "system", "alone", 0, ""),
             (44, 0, "ann", "long " * 100_000, 0, "")]
    # A silent speaker, sparse numbers, a system turn and an empty part for most.
    rows += [(45, 1000 * t, "system" if t in (0, 20) else "cy" if t == 1 else "ann" if t % 2
              else "bob", f"t{t}", 0, "") for t in range(300)]
    rows += [(46, t, "ann", "", 0, "") for t in range(100, 151)]
    rows += [(47, None, None, "same", 0, "")] * 400
    rng.shuffle(rows)
    return rows


def plain(rows, size):
    escaped = lambda s: s.replace("<|", "<\\|")
    groups = {}
    for conv, turn, role, text, *_ in rows:
        said = text or ""
        groups.setdefault(conv, []).append(((turn is not None, turn or 0), "unknown"
                          if role is None else role, hashlib.sha256(said.encode()).hexdigest(), said))
    out = []
    for conv, turns in groups.items():
        turns.sort()
        system = [t for t in turns[:size] if t[1] == "system"]
        for speaker in {t[1] for t in turns} - {"system"}:
            for start in range(0, len(turns), size):
                part = turns[start:start + size]
                before = system if start else []
                text, mask = "", []
                for _, role, _, said in before + part:
                    name = " ".join(escaped(role).replace("\r", "\n").split("\n"))
                    text += "<|im_start|>" + ("system" if role == "system" else "assistant"
                                              if role == speaker else f"user name={name}") + "\n"
                    begin = len(text)
                    text += escaped(said) + "<|im_end|>\n"
                    if role == speaker:
                        mask.append((begin, len(text)))
                out.append((conv, start // size, speaker, len(part), len(before), len(mask), text,
                            mask))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [128, 16])
def test_equals_brute_force(spark, size):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(((r.conv_id, r.part, r.speaker, r.n_turns, r.n_repeated, r.n_own, r.text,
                   [(s.start, s.end) for s in r.mask])
                  for r in C.rendered(df, part_turns=size).collect()), key=str)
    assert got == plain(rows, size)
    if size == 128:
        silent = [g for g in got if g[0] == 45 and g[2] == "cy"]
        assert [g[1:6] for g in silent] == [(0, "cy", 128, 0, 1), (1, "cy", 128, 2, 0),
                                            (2, "cy", 44, 2, 0)]
        assert sum(g[0] == 46 for g in got) == 1
    for *_, text, mask in got:
        assert all(text[:a].endswith("<|im_start|>assistant\n") for a, _ in mask)


def test_empty_and_no_python(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = C.rendered(df)
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_a_long_conversation_needs_no_python(spark):
    """Rows that are all alike are cut in parts, and the plan has no Python step."""
    df = spark.range(20_000).selectExpr("1L as conv_id", "cast(null as long) as turn",
                                        "'ann' as role", "'x' as text").repartition(4)
    out = C.rendered(df)
    plan = out._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
    assert sorted(r.part for r in out.select("part").collect()) == list(range(157))
    assert out.agg({"n_turns": "sum"}).first()[0] == 20_000


def test_sql_says_the_same(spark):
    duckdb = pytest.importorskip("duckdb")
    from credence.llm.oracle import CHAT
    rows = [r for r in table() if r[0] != 44]
    got = C.rendered(spark.createDataFrame(rows, SCHEMA)).withColumn("mask", C.listed("mask"))
    db = duckdb.connect()
    db.register("conversations", spark.createDataFrame(rows, SCHEMA).select(
        "conv_id", "turn", "role", "text").toArrow())
    want = db.sql(f"SELECT {', '.join(got.columns)} FROM ({CHAT})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
