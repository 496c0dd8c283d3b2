import random
import re
from collections import Counter, defaultdict

from credence.llm import quality as Q

SCHEMA = "doc_id long, text string, source string, n_chars long, kept string, lines int"
WORD = r"[^\x20\x09-\x0D]+"


def plain_stats(text):
    words = re.findall(WORD, text)
    lines = [line for line in text.split("\n") if re.search(WORD, line)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1
           for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(line in lines[:i] for i, line in enumerate(lines)), len(hit))


def plain_normal(line):
    line = "".join(c.lower() if "A" <= c <= "Z" else "0" if c in "0123456789" else c
                   for c in line)
    return " ".join(re.findall(WORD, line))


def plain_prose(line):
    words = re.findall(WORD, line)
    letter = lambda c: "a" <= c <= "z" or "A" <= c <= "Z" or ord(c) >= 128
    chars = "".join(words)
    return (sum(any(map(letter, w)) for w in words) >= 3
            and 5 * sum(map(letter, chars)) >= 3 * len(chars))


def plain_quality(rows, least, share, most, long_words=8, long_documents=100):
    documents = defaultdict(set)
    holders = defaultdict(set)
    for _, text, host, *_ in rows:
        documents[host].add(text)
        for line in (text or "").split("\n"):
            if plain_prose(line):
                holders[host, plain_normal(line)].add(text)
    in_all = sum(map(len, documents.values()))
    of_all = Counter()
    for (_, line), held in holders.items():
        of_all[line] += len(held)
    over = {k for k, v in holders.items()
            if len(v) >= least and len(v) > share * len(documents[k[0]])
            or len(v) >= long_documents and len(k[1].split(" ")) >= long_words
            or of_all[k[1]] >= least and of_all[k[1]] > share * in_all}
    out = []
    for doc, text, host, *_ in rows:
        stats = plain_stats(text or "")
        gone = sum(len(plain_normal(line).split(" ")) for line in (text or "").split("\n")
                   if plain_prose(line) and (host, plain_normal(line)) in over)
        failed = stats[0] < 20 or 100 * stats[4] > 30 * stats[0]
        out.append((doc, *stats, gone, failed, not failed and gone <= most * stats[0]))
    return sorted(out, key=str), over


def table(seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(["A", "bé", "C3", "日本,", "d#", "<e>", "f\x0b", "g"])
    line = lambda n: " ".join(word() for _ in range(n))
    common = ["Read MORE  here 12", "Read more here 34\t", "all rights reserved é",
              line(30)]
    rows = []
    for i in range(150):
        lines = [line(rng.randint(0, 25)) for _ in range(rng.randint(0, 4))]
        lines += rng.sample(common, rng.randint(0, 3))
        if i % 7 == 0:
            lines += lines[:2]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["h0", "h0", "h1", None]), 0, "k", 1))
    rows += [(150, None, "h0", None, None, None), (150, "", None, 0, "x", 2)]
    rows += [rows[3]] * 40                                      # copies count once
    rows += [(151, ("long line " * 4000 + "\n") * 3, "h1", 1, "y", 3)]
    return rows


def test_statistics_equal_the_definition():
    for _, text, *_ in table(3):
        if text is not None and len(text) < 10_000:
            assert Q.text_stats(text.encode()) == plain_stats(text)
    assert Q.text_stats(b"a b c d e f g h a b c d e f g h") == (16, 16, 0, 0, 16)


def test_verdicts_equal_brute_force(spark):
    rows = table()
    expected, over = plain_quality(rows, 5, 0.1, 0.5, 9, 6)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = Q.quality(df, min_documents=5, max_share=0.1, long_words=9, long_documents=6).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_removed_words", "base_failed", "kept")
    assert sorted(map(tuple, got.collect()), key=str) == expected
    assert over and any(r[-1] for r in expected) and any(
        not r[-1] and not r[-2] for r in expected)


def test_clean_removes_lines_and_keeps_columns(spark):
    rows = table()
    expected, over = plain_quality(rows, 5, 0.1, 0.5)
    df = spark.createDataFrame(rows, SCHEMA)
    got = Q.clean(df, min_documents=5, max_share=0.1)
    assert got.schema.simpleString() == df.schema.simpleString()
    kept = Counter(str(r[0]) for r in expected if r[-1])
    out = got.collect()
    assert Counter(str(r.doc_id) for r in out) == kept
    for r in out:
        assert r.n_chars == len(r.text)
        assert not any(plain_prose(x) and (r.source, plain_normal(x)) in over
                       for x in r.text.split("\n"))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert Q.quality(df).count() == 0 and Q.clean(df).count() == 0


def removed(spark, texts):
    """Number of texts that lose words, with production parameters."""
    rows = [(i, t, h) for i, (h, t) in enumerate(texts)]
    out = Q.quality(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    return out.where("n_removed_words > 0").count()


def own(i, n=6):
    rng = random.Random(i)
    return "\n".join(" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(9))
                     for _ in range(n))


def test_the_same_rate_has_the_same_verdict_in_small_large_and_hot_hosts(spark):
    """One page in ten has the line, then one in a thousand of a host with 120 000 pages."""
    short, long = "Read more here", "This passage of the site has a good many words in it"
    for size in (150, 1500):
        texts = [("h", own(i) + f"\n{short}" * (i % 10 == 0)) for i in range(size)]
        others = [("g", own(size + i)) for i in range(size)]
        assert removed(spark, texts + others) == size // 10
    texts = [("hot", own(i, 1) + f"\n{long}" * (i % 1000 == 0)
              + f"\n{short}" * (i % 1000 == 1)) for i in range(120_000)]
    assert removed(spark, texts) == 120


def test_many_small_hosts_are_counted_together(spark):
    texts = [(f"h{i}", own(i) + "\nall rights are reserved here" * (i % 10 == 0))
             for i in range(100)]
    assert removed(spark, texts) == 10
    assert removed(spark, texts[:31]) == 0      # four documents are too few


def test_figures_and_code_are_no_boilerplate(spark):
    figures = [("h", own(i) + f"\n{1000 + i} {10 + i / 10}\n}}\nint f() {{\n"
                "for (int i = 0; i < n; i++) {\nRow 12 3.50 7.25 8.00") for i in range(300)]
    assert removed(spark, figures) == 0
    texts = [("h", own(i) + f"\nPosted by admin on {i}.") for i in range(300)]
    assert removed(spark, texts) == 300         # digits are one in lines of words


def test_sql_says_the_same(spark):
    import duckdb

    from credence.llm.oracle import QUALITY
    rows = [r[:3] for r in table()[:190]] + [
        (1000 + i, own(i) + "\nThis passage has eight words or more\n12 34 ab", f"h{i % 40}")
        for i in range(200)] + [
        (2000 + i, own(i) + "\nA sentence that one host has over and over", "h0")
        for i in range(110)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Q.quality(df)
    db = duckdb.connect()
    db.register("documents", df.toArrow())
    want = db.sql(QUALITY)
    assert want.filter("n_removed_words > 0").shape[0] > 100
    got = got.select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
