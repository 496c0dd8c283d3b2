"""Groups of spelling variants: words one edit apart, by asymmetric q-chunks.

Of two words one edit apart, one contributes disjoint chunks and the other its positional grams.  Of
the two halves of the shorter word (or of either, if both are as long) one is untouched by the edit,
so it is a gram of the longer word at its own place or one further.  A half alone is in many words,
so within the rest the same holds again: the rest is halved until it has two letters at most, and
all halves kept on the way form one key, the word without its rest.  A key therefore holds as many
words as there are rests of two letters, whatever the size of the vocabulary, and candidates are
joined on keys, length and shift only and verified on their rests.  A pair is found with one key only:
that whose rest holds the first letter that differs.

Everything is DataFrame functions.  Occurrences are counted in the tasks before the shuffle; a word
has at most some hundred partners, whose best is found by aggregation.  Chains of forms are followed
by doubling, each round a join of the words that have a form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from credence.llm.common import column, stored

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for the rest in a key; no letter of a run.
GAP = "_"


def occurrences(df: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                misspelt: int = 31) -> DataFrame:
    """One row per run of letters: word.  A-Z is lower-cased.

    A run whose checksum with the document's id is divisible by `misspelt` loses the letter at
    checksum modulo length (made misspellings; 0 for none).
    """
    runs = df.select(
        F.coalesce(column(id_column).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(column(text_column).cast("string"), F.lit(f"({RUN})"))
                  ).alias("run"))
    plain = F.octet_length("run") == F.length("run")
    runs = runs.select("id", F.when(plain, F.lower("run")).otherwise(
        F.translate("run", UPPER, LOWER)).alias("run"))
    if not misspelt:
        return runs.select(F.col("run").alias("word"))
    runs = runs.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    return runs.select(F.when(F.col("h") % misspelt == 0, F.concat(
        F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    ).otherwise(F.col("run")).alias("word"))


def _keys(words: DataFrame, shift: int) -> DataFrame:
    """key, size, n, rest: a word without each of its rests, for partners of `shift` letters less."""
    size = F.length("word") - shift
    half = F.ceil(size / 2)
    parts = F.when(half <= 1, F.lit(1)).otherwise(
        F.expr("shiftleft(1, length(bin(half - 1)))"))
    cut = words.withColumn("size", size).withColumn("half", half.cast("int")).withColumn(
        "parts", parts).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    start = F.expr("int(part * size div parts)")
    end = F.expr("int((part + 1) * size div parts)")
    return cut.withColumn("a", start).withColumn("e", end + shift).select(
        F.concat(F.substring("word", F.lit(1), F.col("a")), F.lit(GAP),
                 F.substring("word", F.col("e") + 1, F.length("word"))).alias("key"),
        "size", "n", F.substring("word", F.col("a") + 1, F.col("e") - F.col("a")).alias("rest"))


def _word(side: str) -> Column:
    return F.replace(F.col("key"), F.lit(GAP), F.col(f"{side}.rest"))


def near_pairs(words: DataFrame, least_letters: int = 7) -> DataFrame:
    """word, near, n: for every word (with n) all words exactly one edit away, with their n."""
    chunks = _keys(words, 0)
    grams = chunks.withColumn("longer", F.lit(False)).union(
        _keys(words.where(F.length("word") > least_letters), 1).withColumn("longer", F.lit(True)))
    first = F.when(F.col("t.longer"), ~F.startswith(F.col("t.rest"), F.col("s.rest"))
                   | F.endswith(F.col("key"), F.lit(GAP))).otherwise(True)
    pairs = chunks.alias("s").join(grams.alias("t"), ["key", "size"]).where(
        (F.levenshtein("s.rest", "t.rest", 1) == 1) & first).select(
        _word("s").alias("s"), F.col("s.n").alias("sn"), _word("t").alias("t"),
        F.col("t.n").alias("tn"), F.col("t.longer").alias("longer"))
    one = F.struct(F.col("s").alias("word"), F.col("t").alias("near"), F.col("tn").alias("n"))
    two = F.struct(F.col("t").alias("word"), F.col("s").alias("near"), F.col("sn").alias("n"))
    # Words of one length meet twice, once from each side.
    return pairs.select(F.explode(F.when(F.col("longer"), F.array(one, two)).otherwise(
        F.array(one))).alias("p")).select("p.*")


def _roots(linked: DataFrame) -> DataFrame:
    """word, root for the words that have a form: pointers doubled until none moves."""
    chain = stored(linked.where("form is not null").select("word", F.col("form").alias("root")),
                   "forms")
    while True:
        onward = chain.select(F.col("word").alias("of"), F.col("root").alias("next"))
        moved = stored(chain.join(onward, F.col("root") == F.col("of"), "left").select(
            "word", F.coalesce("next", "root").alias("root"),
            F.col("next").isNotNull().alias("moved")), "forms")
        if not moved.where("moved").limit(1).count():
            return chain
        chain = moved.select("word", "root")


def variants(df: DataFrame, least_letters: int = 7, least_rows: int = 2, ratio: int = 10,
             misspelt: int = 31, id_column: str = "doc_id", text_column: str = "text"
             ) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least `least_letters` letters (3 or
    more) found at least `least_rows` times.

    The form of a word is its most frequent near word (ties: the smallest in code-point order) if
    that is at least `ratio` times as frequent; the root is the end of the chain of forms, the word
    itself without a form.  n_near is 0 without near words; form and form_n are null without a
    form.  A null text has no words and a null id counts as empty; repeated rows count each; other
    columns are ignored.  An empty table gives an empty one.
    """
    if least_letters < 3:
        raise ValueError("least_letters must be 3 or more")
    words = stored(
        occurrences(df, id_column, text_column, misspelt)
        .where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
        .where(F.col("n") >= least_rows), "words")
    near = near_pairs(words, least_letters).groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("n")).alias("n"), "near")).alias("best"))
    enough = -F.col("best.n") >= ratio * F.col("n")
    linked = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.n")).alias("form_n")), "near")
    return linked.join(_roots(linked), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
