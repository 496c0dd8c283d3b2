import random
import re
import zlib
from collections import Counter

import pytest

from credence.llm import variants as V

SCHEMA = "doc_id long, text string, word string, n int, key string, rest string"
LOW = str.maketrans(V.UPPER, V.LOWER)


def words_of(rows, misspelt=31):
    count = Counter()
    for i, text, *_ in rows:
        for run in re.findall(V.RUN, text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if misspelt and h % misspelt == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            count[run] += 1
    return count


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(rows, least=7, misspelt=31):
    count = {w: n for w, n in words_of(rows, misspelt).items() if n >= 2 and len(w) >= least}
    form, out = {}, {}
    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-count[v], v), default=None)
        if best is not None and count[best] >= 10 * count[w]:
            form[w] = best
    for w in count:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, count[w], len(near[w]), count.get(form.get(w)))
    return out


def table(seed=2, n=400):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcéÿÄ") for _ in range(rng.randint(6, 12)))
             for _ in range(30)] + ["aaaaaaa", "aaaaaaaa", "abababab", "×÷abcdef"]

    def word():
        w = rng.choice(stems[:rng.randint(1, len(stems))])
        for _ in range(rng.choice([0] * 6 + [1, 1, 2])):
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abcZ") + w[k:],
                            w[:k] + rng.choice("abcé") + w[k + 1:]])
        return w

    rows = [(i, " ".join(word() + rng.choice(["", ".", "-x", "ł", "Ω"]) for _ in range(40)))
            for i in range(n)]
    rows += [(None, rows[0][1]), rows[1], rows[1], (n, None), (n + 1, ""), (n + 2, "1234 _ !"),
             (n + 3, "abcdefgh " * 30_000), (n + 4, "x" * 3000), (n + 5, "x" * 3000 + "y"),
             (n + 6, "x" * 3000), (n + 7, "x" * 3000 + "y")]
    return [(*r, "w", 1, "k", "r") for r in rows]


@pytest.mark.parametrize("least,misspelt", [(7, 31), (3, 0)])
def test_equals_brute_force(spark, least, misspelt):
    rows = table()
    got = V.variants(spark.createDataFrame(rows, SCHEMA).repartition(4), least_letters=least,
                     misspelt=misspelt).collect()
    want = expected(rows, least, misspelt)
    assert {r.word: tuple(r[1:]) for r in got} == want and len(got) == len(want)
    assert sum(v[0] is not None for v in want.values()) > 20
    assert any(v[0] is not None and v[1] != v[0] for v in want.values())      # chains


def test_chain_of_forms_and_ties(spark):
    count = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000,
             "tttttta": 30, "ttttttb": 30, "ttttttc": 3, "lonely-no": 0, "solitary": 5,
             "underten": 3, "underte": 29}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(count.items())]
    got = {r.word: r for r in V.variants(spark.createDataFrame(rows, "doc_id long, text string"),
                                         misspelt=0).collect()}
    assert got["abcdefg"].root == got["abcdefgh"].root == "abcdefghij"
    assert got["abcdefg"].form == "abcdefgh" and got["abcdefghij"].root == "abcdefghij"
    assert (got["ttttttc"].form, got["ttttttc"].n_near) == ("tttttta", 2)
    assert got["tttttta"].form is None and got["tttttta"].root == "tttttta"
    assert tuple(got["solitary"])[1:] == (None, "solitary", 5, 0, None)
    assert got["underten"].form is None and got["underten"].n_near == 1


def test_keys_are_few_and_their_rests_short(spark):
    words = spark.createDataFrame([("abcdefghijklmnop"[:k], 2) for k in range(3, 17)],
                                  "word string, n long")
    for shift in (0, 1):
        for r in V._keys(words.where("length(word) > 3"), shift).collect():
            assert len(r.rest) - shift in (1, 2)
    assert V._keys(words.where("length(word) = 16"), 0).count() == 8


def test_nothing_and_no_python(spark):
    df = spark.createDataFrame(table()[:3], SCHEMA)
    assert V.variants(df.limit(0)).collect() == []
    assert V.variants(df.where("doc_id is null")).collect() == []
    plan = V.near_pairs(V.occurrences(df).groupBy("word").count().withColumnRenamed(
        "count", "n"))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
    with pytest.raises(ValueError):
        V.variants(df, least_letters=2)
