"""Benchmark decontamination with one Aho-Corasick automaton over the test items.

The automaton reads word numbers instead of characters: a window of ten words is a path of ten
nodes, and a hit is a place in the word list, which maps to the offsets of the original text.
Each text is read once and no row is shuffled.

The benchmark is broadcast behind a check of its size.  One with more than `automaton_words`
words is cut into that many automata by item, which scan the texts one after another in the same
narrow stage, so memory stays bounded and the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from credence.llm.common import column, records, unpacked

WINDOW = 10
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122
               else 32 for c in range(256))
_SPANS_TYPE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                        T.StructField("end", T.LongType())]))
_HITS_TYPE = T.StructType([T.StructField("hits", _SPANS_TYPE),
                           T.StructField("items", T.ArrayType(T.StringType()))])
_OUT_TYPE = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "n_hit", "n_items")]
    + [T.StructField("items_sha256", T.StringType()), T.StructField("spans", _SPANS_TYPE)])
_HITS = [pa.field("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
         pa.field("items", pa.list_(pa.string()))]


def normal_words(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of digits, ASCII letters and everything beyond ASCII."""
    return text.translate(_LOWER).split()


def word_offsets(text: bytes, words: list[bytes]) -> list[tuple[int, int]]:
    """Code point offsets, end exclusive, of the normalised words in the original text."""
    plain, at, seen, out = text.translate(_LOWER), 0, 0, []
    for word in words:
        start = plain.index(word, at)
        begin = seen + len(text[at:start].decode())
        seen = begin + len(text[start:start + len(word)].decode())
        at = start + len(word)
        out.append((begin, seen))
    return out


class Automaton:
    """Word windows of items, and the items that have each."""

    def __init__(self, items: Iterable[tuple[str | None, bytes]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for item, text in items:
            ids = tuple(self.numbers.setdefault(w, len(self.numbers) + 1)
                        for w in normal_words(text))
            for i in range(max(len(ids) - window + 1, min(len(ids), 1))):
                owners.setdefault(ids[i:i + window], set()).add(item)
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for ids, items_of in owners.items():
            self.tree.add_word(ids, (len(ids), items_of))
        if owners:
            self.tree.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged [start, end) word intervals that are hit, and the items hit."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        if not self.numbers or not words:
            return spans, items
        number = self.numbers.get
        found = [(last + 1 - size, last + 1, owner) for last, (size, owner) in
                 self.tree.iter(tuple([number(w, 0) for w in words]))]
        for _, _, owner in found:
            items |= owner
        return merged([(a, b) for a, b, _ in found]), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan_with(df: DataFrame, held, window: int) -> DataFrame:
    """Add hits and items of one automaton to the columns of `df`."""
    names = [f.name for f in df.schema if f.name not in ("hits", "items")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(held.value, window)
        for part in parts:
            hits, items = [], []
            for text, spans, ids in records(part, "text", "hits", "items"):
                found, owners = _together(automaton, normal_words(text or b""), spans, ids)
                hits.append([{"start": a, "end": b} for a, b in found])
                items.append(owners)
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index(n)) for n in names]
                + [pa.array(hits, _HITS[0].type), pa.array(items, _HITS[1].type)],
                names=names + ["hits", "items"])

    kept = T.StructType([f for f in df.schema if f.name in names])
    return df.mapInArrow(run, T.StructType(kept.fields + _HITS_TYPE.fields))


def _together(automaton: Automaton, words: list[bytes], spans: list[dict], ids: list[str]
              ) -> tuple[list[tuple[int, int]], list[str]]:
    """The hits of this automaton and of those before it."""
    found, owners = automaton.scan(words)
    before = [(s["start"], s["end"]) for s in spans]
    return merged(before + found), ids + [i for i in owners if i is not None]


def _finish(held, window: int, with_spans: bool):
    """Scan with the last automaton and put out what is asked for."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(held.value, window)
        for part in parts:
            out = []
            for text, spans, ids in records(part, "text", "hits", "items"):
                words = normal_words(text or b"")
                found, owners = _together(automaton, words, spans, ids)
                listed = sorted(set(owners))
                offsets = word_offsets(text, words) if found and with_spans else []
                out.append((len(words), sum(b - a for a, b in found), len(listed),
                            hashlib.sha256(",".join(listed).encode()).hexdigest(),
                            [{"start": offsets[a][0], "end": offsets[b - 1][1]}
                             for a, b in found if with_spans]))
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("row"))]
                + [pa.array(c, t) for c, t in zip(columns, (
                    pa.int64(), pa.int64(), pa.int64(), pa.string(), _HITS[0].type))],
                names=["row", "n_words", "n_hit", "n_items", "items_sha256", "spans"])
    return run


def contamination(df: DataFrame, benchmark: DataFrame, text_column: str = "text",
                  item_column: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, automaton_words: int = 200_000, with_spans: bool = True,
                  carry: Sequence[str] | None = None) -> DataFrame:
    """One row per row: row (the columns `carry` of `df`, or all), n_words, n_hit, n_items, items_sha256, spans.

    spans are the hit passages as code point offsets of the original text, end exclusive.  Rows
    of the benchmark with one item_id are one item; a null text has no words, a null item_id
    marks words as hit but is in no list.  An empty benchmark hits nothing.  Repeated documents
    each get a row; columns of any name are carried in `row`.
    """
    spark = df.sparkSession
    text = column(item_text).cast("string")
    items = benchmark.select(column(item_column).cast("string").alias("item"),
                             text.cast("binary").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-size // (4 * automaton_words)))      # a word and its gap: 4 bytes or more
    kept = df.columns if carry is None else carry
    carried = df.select(F.struct(*map(column, kept)).alias("row"),
                        column(text_column).cast("string").cast("binary").alias("text"),
                        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
                        .alias("hits"), F.expr("cast(array() as array<string>)").alias("items"))
    for shard in range(shards):
        of = F.pmod(F.xxhash64("item"), F.lit(shards)) == shard
        held = spark.sparkContext.broadcast(
            [(r["item"], bytes(r["text"])) for r in items.where(of).collect()])
        if shard + 1 < shards:
            carried = _scan_with(carried, held, window)
    return carried.mapInArrow(_finish(held, window, with_spans),
                              T.StructType([carried.schema["row"]] + _OUT_TYPE.fields))


def decontaminated(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `df` without any hit word, with the same columns."""
    found = contamination(df, benchmark, with_spans=False, **options)
    return unpacked(found.where("n_hit = 0"), df.columns)
