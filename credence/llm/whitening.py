"""Whitening of embeddings by a weighted multiplicity covariance.

Vectors are put on an integer grid, x = floor(scale * c) + shift, and equal ones are merged, so that
sums are exact and every distinct vector is centred, multiplied and whitened once.  A distinct vector
weighs one or its number of copies in the fit.  Three passes over the distinct vectors follow:
exact sums, the centred product of matrices, the projection.  Tasks put out partial sums and
products, which Spark adds up by position, so the driver sees d sums and d * (d + 1) / 2 products for
vectors of d entries, whatever the number of rows.  The result is joined back on the vector's
SHA-256; copies of one vector with a third of all rows are merged before the shuffle on one side, and
on the other adaptive execution splits their join partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from credence.llm.common import column, stored

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Sums of 2**31 numbers of either half of a long fit in a long.
_HALF = 31
_LARGEST = float(1 << 62)
_GRID = "id bigint, dim int, key binary, x binary"
_GRID_ARROW = pa.schema([("id", pa.int64()), ("dim", pa.int32()), ("key", pa.binary()),
                         ("x", pa.binary())])
_WHITE = pa.schema([("key", pa.binary()), ("copies", pa.int64()), ("deviation", pa.int64()),
                    ("white", pa.list_(pa.float64()))])
_OUT = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, "
        "explained double, identity_error double")


@dataclass(frozen=True)
class Fit:
    """Exact sums over the fit list, and the leading components of its covariance."""
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def grid(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
         scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """id, dim, key, x: the usable vectors on the integer grid, x as int32 or int64 entries.

    Null and empty vectors, and those with an entry that is null, not finite or beyond 62 bits on
    the grid, are left out.
    """
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, vectors = part.column(0), part.column(1)
            flat = vectors.flatten()
            entries = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = np.diff(vectors.offsets.to_numpy())
            sizes = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
            with np.errstate(over="ignore", invalid="ignore"):
                raw = np.floor(scale * entries)
                fine = (np.abs(raw) + abs(shift) < _LARGEST) & flat.is_valid().to_numpy(
                    zero_copy_only=False)
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~fine)])
            use = np.flatnonzero((sizes > 0) & (bad[ends] == bad[ends - sizes]))
            x = np.where(fine, raw, 0).astype(np.int64) + shift
            small = np.abs(x) < 1 << 31
            wide = np.concatenate([[0], np.cumsum(~small)])
            keys, held = [], []
            for a, b in zip((ends - sizes)[use].tolist(), ends[use].tolist()):
                row = x[a:b]
                keys.append(hashlib.sha256(row.tobytes()).digest())
                held.append((row.astype("<i4") if wide[a] == wide[b] else row).tobytes())
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(use)), pa.array(sizes[use], pa.int32()),
                 pa.array(keys, pa.binary()), pa.array(held, pa.binary())], schema=_GRID_ARROW)

    return df.select(column(id_column).cast("bigint").alias("id"),
                     column(vector_column).cast("array<double>").alias("vector")
                     ).mapInArrow(run, _GRID)


def _matrix(x: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a batch as rows of longs."""
    values = x.to_pylist()
    if all(len(v) == 4 * dim for v in values):
        return np.frombuffer(b"".join(values), "<i4").reshape(-1, dim).astype(np.int64)
    return np.array([np.frombuffer(v, "<i4" if len(v) == 4 * dim else "<i8") for v in values],
                    np.int64).reshape(-1, dim)


def _weights(part: pa.RecordBatch, counted: bool) -> np.ndarray:
    copies = part.column(part.schema.get_field_index("copies")).to_numpy()
    return copies if counted else np.ones(len(copies), np.int64)


def _added(rows: DataFrame, kind: str) -> dict[int, object]:
    """Partial arrays of all tasks, added up by position in Spark."""
    at = rows.select(F.posexplode("part").alias("at", "v"))
    return {r["at"]: r["v"] for r in at.groupBy("at").agg(
        F.sum(F.col("v").cast(kind)).alias("v")).collect()}


def _sums(distinct: DataFrame, dim: int, counted: bool) -> tuple[int, list[int]]:
    """The weight of the fit list and the exact sum of every dimension."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = _matrix(part.column(part.schema.get_field_index("x")), dim)
            if not len(x):
                continue
            w = _weights(part, counted)
            halves = np.concatenate([x >> _HALF, x & ((1 << _HALF) - 1)], axis=1)
            if w.max() * len(w) < 1 << 30:
                total = [int(w.sum()), *(w @ halves).tolist()]
            else:
                total = [int(w.sum()), *(w.astype(object) @ halves.astype(object))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([[str(v) for v in total]], pa.list_(pa.string()))], ["part"])

    # Decimal text: no sum of any size is rounded.
    found = _added(distinct.select("x", "copies").mapInArrow(run, "part array<string>"),
                   "decimal(38,0)")
    if not found:
        return 0, []
    return int(found[0]), [(int(found[1 + i]) << _HALF) + int(found[1 + dim + i])
                           for i in range(dim)]


def _centred(x: np.ndarray, sums: tuple[int, ...], n: int) -> np.ndarray:
    """x - S / n: the whole part of the mean is taken off exactly."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def _deviations(x: np.ndarray, sums: tuple[int, ...], n: int) -> list[int | None]:
    """The sum of (n * x - S)^2 of each row, exact; null if it does not fit in a long."""
    reach = max(abs(n * int(v) - s) for edge in (x.min(axis=0), x.max(axis=0))
                for v, s in zip(edge, sums))
    fits = all(abs(s) < 1 << 62 for s in sums) and n * int(np.abs(x).max()) < 1 << 62
    if fits and reach * reach * x.shape[1] < 1 << 63:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    exact = (sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist())
    return [v if v < 1 << 63 else None for v in exact]


def _products(rows: DataFrame, dim: int, read, counted: bool) -> np.ndarray:
    """The sum of w * c c' over all rows; `read` makes the centred matrix of a batch."""
    upper = np.triu_indices(dim)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for part in parts:
            c = read(part)
            if len(c):
                total += (c * _weights(part, counted)[:, None]).T @ c
        yield pa.RecordBatch.from_arrays(
            [pa.array([total[upper]], pa.list_(pa.float64()))], ["part"])

    found = _added(rows.mapInArrow(run, "part array<double>"), "double")
    out = np.zeros((dim, dim))
    out[upper] = [found[i] for i in range(len(upper[0]))]
    return out + np.triu(out, 1).T


def fit(distinct: DataFrame, dim: int, counted: bool = False, components: int = COMPONENTS
        ) -> Fit | None:
    """Sums and components of stored distinct vectors; None without any."""
    n, sums = _sums(distinct, dim, counted)
    if not n:
        return None

    def read(part: pa.RecordBatch) -> np.ndarray:
        return _centred(_matrix(part.column(part.schema.get_field_index("x")), dim), sums, n)

    covariance = _products(distinct.select("x", "copies"), dim, read, counted) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    use = np.flatnonzero(values > max(values[0], 0) * dim * np.finfo(float).eps)[:components]
    vectors = vectors[:, use]
    if len(use):
        # One sign for all rows: the largest entry of a component is positive.
        top = np.abs(vectors).argmax(axis=0)
        vectors = vectors * np.sign(vectors[top, np.arange(len(use))])
    return Fit(n, tuple(sums), values[use], vectors, float(np.trace(covariance)))


def _whitened(distinct: DataFrame, found: Fit) -> DataFrame:
    dim, turn = len(found.sums), found.vectors / np.sqrt(found.values)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = _matrix(part.column(part.schema.get_field_index("x")), dim)
            if not len(x):
                continue
            white = _centred(x, found.sums, found.n) @ turn
            ends = np.arange(0, white.size + 1, white.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("key")),
                 part.column(part.schema.get_field_index("copies")),
                 pa.array(_deviations(x, found.sums, found.n), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(white.ravel()))],
                schema=_WHITE)

    return distinct.mapInArrow(run, "key binary, copies bigint, deviation bigint, "
                                    "white array<double>")


def _identity_error(white: DataFrame, found: Fit, counted: bool) -> float:
    """The largest absolute entry of the covariance of the whitened vectors minus the identity."""
    width = len(found.values)
    weight = F.col("copies") if counted else F.lit(1)
    sums = _added(white.select(F.transform("white", lambda v: v * weight).alias("part")), "double")
    means = np.array([sums[i] for i in range(width)]) / found.n

    def read(part: pa.RecordBatch) -> np.ndarray:
        flat = part.column(part.schema.get_field_index("white")).flatten().to_numpy()
        return flat.reshape(-1, width) - means

    covariance = _products(white.select("white", "copies"), width, read, counted) / found.n
    return float(np.abs(covariance - np.eye(width)).max())


def whiten(df: DataFrame, weights: str = "one", components: int = COMPONENTS,
           id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE,
           shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row.

    `weights` is "one" (every distinct vector counts once) or "count" (as often as it occurs); n is
    the weight of the fit list.  Components are numbered from 1 by falling eigenvalue; their
    largest entry is positive.  Those without variance (an eigenvalue at or below d machine epsilons
    of the largest) are left out, so equal or single vectors give no rows.  `deviation` is null if it
    does not fit in a long.  Unusable vectors (see `grid`) have no rows, nor have those of another
    length than the most frequent one (ties: the longest).  Repeated rows and null ids are kept;
    other columns are ignored.  An empty table gives an empty one.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights must be 'one' or 'count'")
    spark, counted = df.sparkSession, weights == "count"
    rows = grid(df, id_column, vector_column, scale, shift)
    distinct = stored(rows.groupBy("key").agg(F.first("dim").alias("dim"), F.first("x").alias("x"),
                                              F.count("*").alias("copies")), "vectors")
    lengths = distinct.groupBy("dim").agg(F.sum("copies").alias("rows")).orderBy(
        F.desc("rows"), F.desc("dim")).first()
    if lengths is None:
        return spark.createDataFrame([], _OUT)
    dim = lengths["dim"]
    distinct = distinct.where(F.col("dim") == dim)
    found = fit(distinct, dim, counted, components)
    if not len(found.values):
        return spark.createDataFrame([], _OUT)
    white = stored(_whitened(distinct, found), "whitened")
    error = _identity_error(white, found, counted)
    explained = F.array(*[F.lit(float(v / found.trace)) for v in found.values])
    return (rows.select("id", "key").join(white.hint("merge"), "key")
            .select(F.col("id").alias("vec_id"), "deviation", F.posexplode("white").alias(
                "at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"),
                    F.lit(found.n).cast("bigint").alias("n"), "deviation", "whitened",
                    F.element_at(explained, F.col("at") + 1).alias("explained"),
                    F.lit(error).alias("identity_error")))
