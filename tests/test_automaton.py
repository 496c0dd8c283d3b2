import random
import re

import pytest
from pyspark.sql import functions as F

from credence import settings
from credence.functions import automaton as A
from credence.operators import features as X

GROUPS = {"a": ("aa", "aba", "ab"), "b": ("b", "bab", "ab"), "c": ("ra g", "a", "é\U0001f600"),
          "none": ()}


def whole(word, text):
    return len(re.findall(rf"(?<!\w){re.escape(word)}(?!\w)", text, re.ASCII))


@pytest.mark.parametrize("whole_words", [False, True])
def test_equals_counting_each_keyword(whole_words):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aab rgé\U0001f600.\n") for _ in range(rng.randint(0, 60)))
             for _ in range(400)] + [None, "", "ab" * 5000, "aaaa aaa"]
    found = A.KeywordAutomaton(GROUPS, whole_words).count_all(texts)
    assert found.shape == (404, 4)
    for text, row in zip(texts, found.tolist()):
        count = whole if whole_words else lambda w, t: t.count(w)
        assert row == [sum(count(w, text or "") for w in ws) for ws in GROUPS.values()], text


def test_chunks_do_not_change_counts(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    automaton = A.KeywordAutomaton(GROUPS)
    at_once = automaton.count_all(texts)
    monkeypatch.setattr(A, "CHUNK", 50)
    assert (automaton.count_all(texts) == at_once).all()
    assert automaton.count_all([]).shape == (0, 4)


def test_column(spark):
    texts = ["semantic search, search and vector search", "", "ragrag storage", "rank-ranking",
             "é rag é", "html dl ml", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    words = settings.EVIDENCE_KEYWORDS
    for r in rows.select("t", A.KeywordAutomaton(words).counts(F.col("t")).alias("n")).collect():
        assert r.n.asDict() == {g: sum((r.t or "").count(w) for w in ws)
                                for g, ws in words.items()}
    got = rows.select("t", A.KeywordAutomaton({"x": ("rag", "ml")}, True).counts(
        F.col("t")).alias("n")).collect()
    assert {r.t: r.n.x for r in got} == dict(zip(texts, [0, 0, 0, 0, 1, 1, 0]))


def test_refused_keywords():
    for word in ("", "a\0b"):
        with pytest.raises(ValueError):
            A.KeywordAutomaton({"a": (word,)}).count_all(["x"])


def generated(spark, df):
    """Bytes of the largest method of every generated class of the plan."""
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"),
                    "MODULE$")
    parts = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]


def test_features_read_texts_once_and_compile(spark, records):
    from conftest import CLEAN
    df = X.features(records(CLEAN))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    sizes = generated(spark, df)
    print(sizes)
    assert sizes and max(sizes) < 8000      # the JIT compiler leaves larger methods alone
