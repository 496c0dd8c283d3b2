"""Quality rules with the frequency of lines across documents.

Lines of prose are normalised (ASCII lower case, runs of white space as one space, digits as 0)
and hashed.  A line is prose if at least three of its words have a letter (A-Z, a-z or beyond
ASCII) and three fifths of the characters of its words are letters; figures, brackets and most
code are never boilerplate.  For every host, and over all hosts, the documents that hold a line
are counted, copies of one text once.  A line is boilerplate

* in a host where it is in more than `max_share` of the documents, and in `min_documents`;
* in every host, if both hold for the documents of all hosts together;
* in a host where it has at least `long_words` words and is in at least `long_documents`
  documents: such lines do not recur by chance, however large the host is.

The share is the same in small and large hosts; `min_documents` only keeps a single repeat in a
host of a few documents from counting.  Boilerplate is removed, and a document is depleted if more
than `max_removed` of its words go with it.

Only narrow rows (host, text key, line hash, words) are shuffled.  They are made distinct before
they are counted, so a text with a third of all rows counts once, and the count of a line or
host with a third of all rows is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from credence.llm.common import column, join_checked, records, stored

WINDOW = 8
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(set(range(256)) - set(_SYMBOLS))
_TAILS = bytes(range(0x80, 0xC0))       # UTF-8 bytes that do not begin a code point
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_KEYS = ("doc_id", "text_key", "host")
_SQL = ", ".join(f"{n} bigint" for n in _KEYS + _STATS) + \
    ", lines array<bigint>, line_words array<bigint>"
_LETTERS = bytes(c for c in range(256) if c >= 0x80 or 65 <= c <= 90 or 97 <= c <= 122)
_PROSE_WORDS = 3
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside `size`-word windows that occur twice or more, the first one included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    mixed = np.zeros(n, np.uint64)
    for i in range(size):       # candidates by a rolling hash, then compared word by word
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[i:i + n] + np.uint64(1)
    _, back, count = np.unique(mixed, return_inverse=True, return_counts=True)
    places = np.flatnonzero(count[back] > 1)
    seen: dict[tuple, int] = {}
    twice = np.zeros(len(words) + 1, np.int64)
    windows = [tuple(ids[p:p + size].tolist()) for p in places]
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    for p, w in zip(places, windows):
        if seen[w] > 1:
            twice[p] += 1
            twice[p + size] -= 1
    return int((np.cumsum(twice) > 0).sum())


def text_stats(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    chars = len(b"".join(words).translate(None, _TAILS))
    return (len(words), chars, len(text.translate(None, _NOT_SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def _prose(words: list[bytes]) -> bool:
    """Whether the words of a line are prose: three with a letter, three fifths letters."""
    if len(words) < _PROSE_WORDS:
        return False
    whole = b"".join(words).translate(None, _TAILS)
    if 5 * (len(whole) - len(whole.translate(None, _LETTERS))) < 3 * len(whole):
        return False
    return sum(len(w.translate(None, _LETTERS)) < len(w) for w in words) >= _PROSE_WORDS


def text_lines(text: bytes) -> list[tuple[int, int]]:
    """Hash of the normalised form and number of words of every line of prose."""
    out = []
    for line in text.translate(_NORMAL).split(b"\n"):
        words = line.split()
        if _prose(words):
            out.append((xxhash.xxh64_intdigest(b" ".join(words), 42), len(words)))
    return out


def _scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        stats, hashes, words = [], [], []
        for (text,) in records(part, "text"):
            stats.append(text_stats(text or b""))
            found = text_lines(text or b"")
            hashes.append(np.array([h for h, _ in found], np.uint64).view(np.int64))
            words.append([w for _, w in found])
        columns = list(zip(*stats)) if stats else [[]] * len(_STATS)
        yield pa.RecordBatch.from_arrays(
            [part.column(part.schema.get_field_index(n)) for n in _KEYS]
            + [pa.array(c, pa.int64()) for c in columns]
            + [pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int64()))],
            names=[*_KEYS, *_STATS, "lines", "line_words"])


def quality(df: DataFrame, id_column: str = "doc_id", text_column: str = "text",
            host_column: str = "source", min_words: int = 20, max_repeat_percent: int = 30,
            min_documents: int = 5, max_share: float = 0.01, long_words: int = 8,
            long_documents: int = 100, max_removed: float = 0.5) -> DataFrame:
    """One row per row: doc_id, text_key, host, the base statistics, n_removed_words,
    removed_lines (hashes), base_failed, kept.

    A null text has no words and fails; a null host is a host of its own.  Repeated rows count as
    one document and each get a row.  Columns that are not named are ignored.
    """
    rows = stored(df.select(
        column(id_column).cast("bigint").alias("doc_id"), *_keys(text_column, host_column),
        column(text_column).cast("string").cast("binary").alias("text")
    ).mapInArrow(_scan, _SQL), "quality")
    n = rows.count()
    texts = rows.groupBy("host", "text_key").agg(F.any_value("lines").alias("lines"),
                                                 F.any_value("line_words").alias("words"))
    lines = texts.select("host", "text_key", F.explode(F.arrays_zip("lines", "words"))
                         .alias("l")).select("host", "text_key", "l.lines", "l.words")
    documents = stored(rows.select("host", "text_key").distinct().groupBy("host").agg(
        F.count("*").alias("documents")), "host-documents", n)
    in_all = documents.agg(F.sum("documents")).first()[0] or 0
    share = F.col("n") > max_share * F.col("documents")
    long = (F.col("words") >= long_words) & (F.col("n") >= long_documents)
    counted = stored(join_checked(
        lines.distinct().groupBy("host", "lines", "words").agg(F.count("*").alias("n")),
        documents, ["host"], "inner").where(share | long), "line-counts", n)
    of_host = counted.where(share & (F.col("n") >= min_documents) | long)
    # A line with that share of all documents has it in one host at least.
    seen = stored(counted.where(share).select("lines").distinct(), "line-candidates", n)
    spread = join_checked(lines, seen, ["lines"], "left_semi").select(
        "host", "text_key", "lines").distinct()
    common = spread.groupBy("lines").agg(F.count("*").alias("n")).where(
        (F.col("n") >= min_documents) & (F.col("n") > max_share * in_all)).select("lines")
    of_all = spread.select("host", "lines").distinct().join(common, "lines")
    over = stored(of_host.select("host", "lines").union(of_all.select("host", "lines"))
                  .distinct(), "boilerplate", n)
    removed = stored(join_checked(lines, over, ["host", "lines"], "inner")
                     .groupBy("host", "text_key").agg(
                         F.sum("words").alias("n_removed_words"),
                         F.collect_set("lines").alias("removed_lines")), "removed", n)
    judged = join_checked(rows.drop("lines", "line_words"), removed, ["host", "text_key"])
    n_removed = F.coalesce("n_removed_words", F.lit(0).cast("bigint"))
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return (judged.withColumn("n_removed_words", n_removed).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed")
                        & (F.col("n_removed_words") <= max_removed * F.col("n_words"))))


def _keys(text_column: str, host_column: str) -> list[Column]:
    return [F.xxhash64(column(text_column).cast("string")).alias("text_key"),
            F.xxhash64(column(host_column)).alias("host")]


def _without(text: str, removed: list[int]) -> str:
    """The text without the lines that have one of the hashes."""
    drop, out = {h % (1 << 64) for h in removed}, []
    for line in text.split("\n"):
        found = text_lines(line.encode())
        if not found or found[0][0] not in drop:
            out.append(line)
    return "\n".join(out)


def clean(df: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          host_column: str = "source", length_column: str | None = "n_chars", **rules: float
          ) -> DataFrame:
    """The rows of `df` that `quality` keeps, their boilerplate lines removed.

    All columns stay; `length_column`, if there is one, is set to the new length.
    """
    judged = quality(df, id_column, text_column, host_column, **rules)
    kept = stored(judged.where("kept").select("host", "text_key", "removed_lines")
                  .dropDuplicates(["host", "text_key"]), "kept", df.count())
    keys = df.select(F.struct(*map(column, df.columns)).alias("row"),
                     *_keys(text_column, host_column))
    # The texts are shuffled once, at every size; the partitions of a hot text are split.
    rows = keys.join(kept, ["host", "text_key"]).select("row", "removed_lines")
    return with_text(rows, df, text_column, length_column, _without, "removed_lines")


def with_text(rows: DataFrame, like: DataFrame, text_column: str, length_column: str | None,
              change: Callable[[str, list], str], argument: str | None = None) -> DataFrame:
    """Columns of `like` from `row`, the text changed by `change`, and its length.

    With an `argument` column, `change(text, argument)` is called where it has elements; without,
    `change(text)` for every text.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if argument is None:
                texts = [t if t is None else change(t) for (t,) in records(part, "text")]
            else:
                texts = [change(t, a) if t is not None and a else t
                         for t, a in records(part, "text", argument)]
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("row")), pa.array(texts, pa.string())],
                names=["row", "text"])

    text = F.col("row").getField(text_column).cast("string")
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])
    given = [] if argument is None else [argument]
    changed = rows.select("row", text.alias("text"), *given).mapInArrow(run, schema)
    out = []
    for f in like.schema:
        value = F.col("row").getField(f.name)
        if f.name == text_column:
            value = F.col("text")
        elif f.name == length_column:
            value = F.when(F.col("text").isNull(), value).otherwise(F.length("text"))
        out.append(value.cast(f.dataType).alias(f.name))
    return changed.select(*out)
