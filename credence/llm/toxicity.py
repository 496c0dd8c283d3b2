"""Toxicity by the nearest labelled examples, with evidence.

Texts are vectors of TF-IDF weights over the words that separate the classes of the labelled examples
(G test of document counts); the counts behind the weights are those of all documents.  The nearest
examples are found by exact cosine in an inverted index in blocks: for each word and block of examples the
largest weight is kept, their sums bound the cosine of a whole block, and blocks that cannot reach
the k best so far are not opened.  Neighbours vote with a weight that falls with their distance.  A
monotone curve, fitted to the votes that the examples get from one another, turns the share of
votes into the rate of toxic texts, so a score of 0.5 is an even chance.

The examples are a bounded sample (`examples` distinct texts, by a hash of their id), so their
words and index are bounded and broadcast.  Everything else is one pass over all texts, whose
short vectors are stored and read again for counts, examples and scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from credence.llm.common import column, records, stored

FOLDS = 5
EXAMPLES = 20_000
TERMS = 16_384
LEAST_TEXTS = 4
LEAST_GAIN = 24.0
NEIGHBOURS = 15
BLOCK = 64
#: A neighbour at cosine c votes with 1 / (1 - c + SOFT).
SOFT = 0.05
#: Cosines are compared in steps of this size, so that equal vectors tie whatever the order of sums.
_STEP = 1e-9
_WORD = re.compile(r"[^\W\d_]+")
_VECTORS = pa.schema([("doc_id", pa.int64()), ("terms", pa.list_(pa.int32())),
                      ("counts", pa.list_(pa.int32()))])
_VECTORS_SQL = "doc_id bigint, terms array<int>, counts array<int>"
#: Tasks that add up counts, and tasks in which the examples are judged.
_SUMS = 8
_JUDGES = 64
_SCORES = pa.schema([("doc_id", pa.int64()), ("share", pa.float64()), ("score", pa.float64()),
                     ("neighbours", pa.list_(pa.int64())), ("cosines", pa.list_(pa.float64()))])
_SCORES_SQL = ("doc_id bigint, share double, score double, neighbours array<bigint>, "
               "cosines array<double>")


def held_out(doc_id: Column) -> Column:
    """Whether a row is never learned from: one fold of five, by the checksum of its id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sampled(labels: DataFrame, examples: int = EXAMPLES, id_column: str = "doc_id",
            label_column: str = "toxic") -> DataFrame:
    """doc_id, toxic of at most `examples` labelled rows outside the held-out fold.

    Rows with a null id or label do not count; of several labels of one id the majority holds
    (toxic if even).
    """
    one = labels.select(column(id_column).cast("bigint").alias("doc_id"),
                        column(label_column).cast("int").alias("toxic")).where(
        "doc_id is not null and toxic is not null")
    return (one.where(~held_out(F.col("doc_id"))).groupBy("doc_id")
            .agg((F.avg("toxic") >= 0.5).alias("toxic"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples))


def _texts(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return df.select(column(id_column).cast("bigint").alias("doc_id"),
                     F.coalesce(column(text_column).cast("string"), F.lit("")).alias("text"))


def separating_terms(texts: DataFrame, sample: DataFrame, terms: int = TERMS,
                     least_texts: int = LEAST_TEXTS, least_gain: float = LEAST_GAIN
                     ) -> dict[str, int]:
    """The at most `terms` words whose document counts differ most between the classes.

    Equal texts of the sample count once, as toxic if any is.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for part in parts:
            for text, toxic in records(part, "text", "toxic"):
                seen[toxic].update({*_WORD.findall(text.lower()), ""})
        words = [*seen[0].keys() | seen[1].keys()]
        yield pa.RecordBatch.from_pydict({
            "word": pa.array(words, pa.string()),
            "clean": pa.array([seen[0][w] for w in words], pa.int64()),
            "toxic": pa.array([seen[1][w] for w in words], pa.int64())})

    known = texts.join(F.broadcast(sample), "doc_id").groupBy(
        F.sha2("text", 256).alias("same")).agg(F.first("text").alias("text"),
                                               F.max("toxic").alias("toxic"))
    counts = known.select("text", "toxic").mapInArrow(
        run, "word string, clean bigint, toxic bigint").groupBy("word").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = stored(counts.where(
        (F.col("clean") + F.col("toxic") >= least_texts) | (F.col("word") == "")), "words")
    total = counts.where("word = ''").first()       # the empty word is in every text
    if total is None or not total["clean"] or not total["toxic"]:
        return {}
    n = total["clean"] + total["toxic"]
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")

    def share(seen: Column, row: Column, of: float) -> Column:
        return F.when(seen > 0, seen * F.log(seen * n / (row * of))).otherwise(0.0)

    gain = 2 * (share(a, a + b, float(total["toxic"])) + share(b, a + b, float(total["clean"]))
                + share(total["toxic"] - a, n - a - b, float(total["toxic"]))
                + share(total["clean"] - b, n - a - b, float(total["clean"])))
    best = (counts.where("word <> ''").select("word", gain.alias("gain"))
            .where(F.col("gain") >= least_gain).orderBy(F.desc("gain"), "word").limit(terms))
    return {r["word"]: i for i, r in enumerate(best.collect())}


def vectors(texts: DataFrame, terms: dict[str, int]) -> DataFrame:
    """doc_id, terms, counts of every text: the known words it holds, by number."""
    known = texts.sparkSession.sparkContext.broadcast(terms)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = known.value
        for part in parts:
            held = []
            for doc_id, text in records(part, "doc_id", "text"):
                found = sorted(Counter(at[w] for w in _WORD.findall(text.lower())
                                       if w in at).items())
                held.append((doc_id, [t for t, _ in found], [c for _, c in found]))
            columns = zip(*held) if held else [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _VECTORS)], schema=_VECTORS)

    return texts.mapInArrow(run, _VECTORS_SQL)


class BlockMaxIndex:
    """Exact k nearest examples by cosine; examples are (doc_id, toxic, terms, counts)."""

    def __init__(self, examples: list[tuple], idf: np.ndarray):
        self.idf = idf
        rows = [(i, bool(y), *self.weighted(t, c)) for i, y, t, c in examples if len(t)]
        # Examples with the same heaviest words share blocks, so bounds are tight.
        rows.sort(key=lambda r: (r[2][np.argsort(-r[3], kind="stable")[:3]].tolist(), r[0]))
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.toxic = np.array([r[1] for r in rows], bool)
        self.blocks = -(-len(rows) // BLOCK)
        sizes = [len(r[2]) for r in rows]
        slot = np.repeat(np.arange(len(rows)), sizes)
        term = np.concatenate([np.empty(0, np.int64)] + [r[2] for r in rows])
        weight = np.concatenate([np.empty(0)] + [r[3] for r in rows])
        order = np.lexsort((slot, term))
        self.slot, self.weight, term = slot[order], weight[order], term[order]
        cell = term * max(self.blocks, 1) + self.slot // BLOCK
        self.start = np.flatnonzero(np.diff(cell, prepend=-1))          # postings of a cell
        self.stop = np.append(self.start[1:], len(cell))
        self.block = self.slot[self.start] // BLOCK
        self.top = np.maximum.reduceat(self.weight, self.start) if len(cell) else self.weight
        self.cells = np.searchsorted(term[self.start], np.arange(len(idf) + 1))

    def weighted(self, terms, counts) -> tuple[np.ndarray, np.ndarray]:
        """The words of a text and their weights, of length one together."""
        t = np.asarray(terms, np.int64)
        w = (1 + np.log(np.asarray(counts, float))) * self.idf[t]
        return t, w / np.sqrt(w @ w)

    def nearest(self, terms, counts, k: int, without: int | None = None
                ) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples (ties: the smallest id), cosine above 0.

        `without` leaves the examples of one id out.
        """
        t, w = self.weighted(terms, counts)
        cells = [np.arange(self.cells[x], self.cells[x + 1]) for x in t]
        cell, by = np.concatenate(cells), np.repeat(w, [len(c) for c in cells])
        bound = np.bincount(self.block[cell], by * self.top[cell], self.blocks)
        cosine, opened = np.zeros(self.blocks * BLOCK), np.zeros(self.blocks, bool)
        alive = np.argsort(-bound, kind="stable")[:1 + k // BLOCK]
        alive = alive[bound[alive] > 0]
        while len(alive):
            opened[alive] = True
            new = np.zeros(self.blocks, bool)
            new[alive] = True
            use = new[self.block[cell]]
            first, size = self.start[cell[use]], (self.stop - self.start)[cell[use]]
            upto = np.cumsum(size)
            place = np.repeat(first - upto + size, size) + np.arange(size.sum())
            cosine += np.bincount(self.slot[place], self.weight[place] * np.repeat(by[use], size),
                                  len(cosine))
            if without is not None:
                cosine[np.flatnonzero(self.ids == without)] = 0
            worst = np.partition(cosine, -k)[-k] if k <= len(cosine) else 0.0
            alive = np.flatnonzero(~opened & (bound >= max(worst - 2 * _STEP, _STEP)))
        found = np.flatnonzero(cosine > _STEP)
        steps = np.round(cosine[found] / _STEP)
        found = found[np.lexsort((self.ids[found], -steps))[:k]]
        return found, np.minimum(np.round(cosine[found] / _STEP) * _STEP, 1.0)


@dataclass(frozen=True)
class Model:
    """The index and the monotone curve from the share of votes to the rate of toxic texts."""
    index: BlockMaxIndex
    neighbours: int
    shares: np.ndarray
    rates: np.ndarray
    alone: float                            # the rate of examples without neighbours

    def share(self, terms, counts, without: int | None = None
              ) -> tuple[float | None, np.ndarray, np.ndarray]:
        """The toxic share of the votes (none without neighbours), the voters and their cosines."""
        if not len(terms) or not self.index.blocks:
            return None, np.empty(0, np.int64), np.empty(0)
        at, cosine = self.index.nearest(terms, counts, self.neighbours, without)
        if not len(at):
            return None, at, cosine
        votes = 1 / (1 - cosine + SOFT)
        return float(votes @ self.index.toxic[at] / votes.sum()), at, cosine

    def score(self, share: float | None) -> float:
        return self.alone if share is None else float(np.interp(share, self.shares, self.rates))


def _voted(rows: DataFrame, model: Model, leave_out: bool = False) -> DataFrame:
    """doc_id, share, score, neighbours, cosines of stored vectors, row by row."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = sent.value, {}
        for part in parts:
            held = []
            for doc_id, terms, counts in records(part, "doc_id", "terms", "counts"):
                key = (doc_id if leave_out else None, *terms, -1, *counts)
                found = known.get(key)
                if found is None:
                    share, at, cosine = own.share(terms, counts, doc_id if leave_out else None)
                    found = share, own.score(share), own.index.ids[at].tolist(), cosine.tolist()
                    if len(known) < 10_000 and len(key) < 64:       # copies are searched once
                        known[key] = found
                held.append((doc_id, *found))
            columns = zip(*held) if held else [[]] * len(_SCORES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _SCORES)], schema=_SCORES)

    return rows.select("doc_id", "terms", "counts").mapInArrow(run, _SCORES_SQL)


def _monotone(shares: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rates by share of votes, never falling (pooled neighbours), each smoothed by two texts."""
    pools: list[list[float]] = []                       # share sum, toxic, texts
    for share, y in sorted(zip(shares.tolist(), toxic.tolist())):
        if pools and pools[-1][0] / pools[-1][2] == share:
            pools[-1] = [pools[-1][0] + share, pools[-1][1] + y, pools[-1][2] + 1]
        else:
            pools.append([share, y, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    if not pools:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    rates = np.maximum.accumulate([(y + 1) / (n + 2) for _, y, n in pools])
    return np.array([s / n for s, _, n in pools]), rates


def document_counts(rows: DataFrame, n_terms: int) -> np.ndarray:
    """In how many of the stored vectors each word is.

    A task adds up its own vectors, so one row of counts leaves it, however many words a text has.
    """
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for part in parts:
            total += np.bincount(part.column(0).flatten().to_numpy(zero_copy_only=False),
                                 minlength=n_terms)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], ["n"])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for part in parts:
            total += part.column(0).flatten().to_numpy().reshape(-1, n_terms).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], ["n"])

    if not n_terms:
        return np.zeros(0, np.int64)
    sums = rows.select("terms").mapInArrow(count, "n array<bigint>").repartition(
        _SUMS).mapInArrow(add, "n array<bigint>").collect()
    return np.sum([np.zeros(n_terms, np.int64), *(np.array(r["n"]) for r in sums)], axis=0)


def fit(rows: DataFrame, sample: DataFrame, n_terms: int, examples: int = EXAMPLES,
        neighbours: int = NEIGHBOURS) -> Model:
    """Index and curve from the stored vectors of all documents and the sampled labels."""
    counts, n = document_counts(rows, n_terms).tolist(), rows.count()
    idf = np.array([math.log((1 + n) / (1 + c)) + 1 for c in counts])
    known = stored(rows.join(F.broadcast(sample), "doc_id").orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(examples), "examples", examples)
    index = BlockMaxIndex([tuple(r) for r in known.where(F.size("terms") > 0).select(
        "doc_id", "toxic", "terms", "counts").collect()], idf)
    blank = Model(index, neighbours, np.array([0.0, 1.0]), np.array([0.0, 1.0]), 0.0)
    # Every example is judged by the others.
    got = _voted(known.repartition(_JUDGES), blank, leave_out=True).select("doc_id", "share").join(
        F.broadcast(sample), "doc_id").select("share", "toxic").collect()
    none = [r["toxic"] for r in got if r["share"] is None]
    voted = [r for r in got if r["share"] is not None]
    shares, rates = _monotone(np.array([r["share"] for r in voted]),
                              np.array([r["toxic"] for r in voted], float))
    return Model(index, neighbours, shares, rates, (sum(none) + 1) / (len(none) + 2)
                 if none else 0.0)


def toxicity(df: DataFrame, labels: DataFrame, examples: int = EXAMPLES, terms: int = TERMS,
             neighbours: int = NEIGHBOURS, least_texts: int = LEAST_TEXTS,
             least_gain: float = LEAST_GAIN, id_column: str = "doc_id",
             text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted, share, neighbours, cosines of every row.

    The score is the rate of toxic texts among examples with the same share of votes; a text
    without any neighbour (an empty or null one too) gets the rate of such examples.  `neighbours`
    and `cosines` are the evidence: the ids of the voters, nearest first.  A null id is never
    held out nor learned from.  Repeated rows are scored each.  Without labels of both classes
    every score is the rate of toxic ones among the sampled (0 without any).  Other columns are
    ignored.  An empty table gives an empty one.
    """
    sample = stored(sampled(labels, examples, id_column, label_column), "labels", examples)
    texts = _texts(df, id_column, text_column)
    words = separating_terms(texts, sample, terms, least_texts, least_gain)
    rows = stored(vectors(texts, words), "terms")
    model = fit(rows, sample, len(words), examples, neighbours)
    return _voted(rows, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "share", "neighbours", "cosines")
