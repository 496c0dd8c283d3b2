"""Top-k under many sets of weights in one pass over the rows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


class BestRows:
    """The first k (score, key) seen: score descending, then key.

    The order is Spark's: NaN is the largest score, a missing one comes last, a missing key first.
    """

    def __init__(self, k: int):
        self.k, self.rows, self.floor = k, [], -np.inf

    def add(self, scores: np.ndarray, missing: np.ndarray, keys: pa.Array) -> None:
        reach = np.where(missing, -np.inf, np.where(np.isnan(scores), np.inf, scores))
        floor = self.floor
        if len(reach) > self.k:
            floor = max(floor, np.partition(reach, -self.k)[-self.k])
        at = np.flatnonzero(reach >= floor)
        if not len(at):
            return
        new = ((m, s == s, -s, key is not None, key) for m, s, key in zip(
            missing[at].tolist(), scores[at].tolist(), keys.take(pa.array(at)).to_pylist()))
        self.rows = heapq.nsmallest(self.k, [*self.rows, *map(_plain, new)])
        if len(self.rows) == self.k:
            missed, number, score, *_ = self.rows[-1]
            self.floor = -np.inf if missed else -score if number else np.inf

    def listed(self) -> Iterator[tuple]:
        for missed, number, score, named, key in self.rows:
            yield key if named else None, None if missed else -score if number else float("nan")


def _plain(row: tuple) -> tuple:
    """Without the values that cannot be compared."""
    missed, number, score, named, key = row
    return missed, number and not missed, score if number and not missed else 0.0, named, \
        key if named else 0


def weighted_scores(values: Sequence[np.ndarray], weights: np.ndarray, factor: np.ndarray
                    ) -> np.ndarray:
    """rows x objectives: the weighted sums times the factor.

    Added up in the order of the columns like the SQL expression, not by a matrix product, so that
    the last bit of a score, and with it the order of near-equal rows, is the same.
    """
    total = np.zeros((len(factor), weights.shape[1]))
    for column, by in zip(values, weights):
        total += column[:, None] * by[None, :]
    return total * factor[:, None]


def top_k_by_weights(rows: DataFrame, columns: Sequence[str],
                     objectives: Mapping[str, Sequence[float]], factor: str, k: int,
                     key: str) -> DataFrame:
    """objective, key, score, rank: the first k rows under each objective (weights of `columns`).

    A task scores a batch under all objectives at once and keeps k rows of each, so the rows are
    read once, and what is shuffled is at most k rows per task and objective.  A missing value
    makes a missing score.
    """
    names = list(objectives)
    weights = np.array([[float(w) for w in objectives[n]] for n in names]).T
    if names and weights.shape[0] != len(columns):
        raise ValueError("each objective needs one weight per column")
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [BestRows(k) for _ in names]
        for part in parts:
            if not part.num_rows:
                continue
            numbers = [c.to_numpy(zero_copy_only=False) for c in part.columns[1:]]
            missing = np.zeros(part.num_rows, bool)
            for c in part.columns[1:]:
                missing |= c.is_null().to_numpy(zero_copy_only=False)
            scores = weighted_scores(numbers[:-1], weights, numbers[-1])
            for i, keeper in enumerate(best):
                keeper.add(scores[:, i], missing, part.column(0))
        found = [(n, *row) for n, keeper in zip(names, best) for row in keeper.listed()]
        yield pa.RecordBatch.from_pydict({
            "objective": pa.array([f[0] for f in found], pa.string()),
            "key": pa.array([f[1] for f in found]),
            "score": pa.array([f[2] for f in found], pa.float64(), from_pandas=False)})

    narrow = rows.select(F.col(key).alias("key"), *[F.col(c).cast("double") for c in columns],
                         F.col(factor).cast("double").alias("_factor"))
    tops = narrow.mapInArrow(run, f"objective string, key {kind}, score double")
    order = Window.partitionBy("objective").orderBy(F.desc("score"), F.asc("key"))
    return (tops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("objective", F.col("key").alias(key), "score", "rank"))
