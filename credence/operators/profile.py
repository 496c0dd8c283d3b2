"""Dataset profile: counts, distributions and correlations as DataFrames."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from credence.functions.numeric import sentinel_to_null
from credence.functions.text import sql_text
from credence.session import fresh_path

# --- missing values, keys ---------------------------------------------------------------------


def missing_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(field, n_missing, pct_missing) of the columns that have nulls.  One pass."""
    columns = columns or df.columns
    counts = df.agg(F.count("*").alias("_total"), *[
        F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return (counts.unpivot("_total", columns, "field", "n_missing").filter("n_missing > 0")
            .select("field", "n_missing",
                    F.round(F.col("n_missing") * 100.0 / F.col("_total"), 2)
                    .alias("pct_missing")))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def near_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that share all given columns with another row, and the number of such groups."""
    groups = df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")
    return groups.agg(F.count("*").alias("n_groups"),
                      F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def malformed_ids(df: DataFrame, key: str, pattern: str) -> DataFrame:
    """Ids that do not match; a null id is malformed."""
    return df.filter(~F.coalesce(F.col(key).rlike(pattern), F.lit(False))).select(key)


def id_sequence(df: DataFrame, key: str) -> DataFrame:
    """Range of the trailing number of the ids and how many numbers in it are unused."""
    number = F.regexp_extract(F.col(key).cast("string"), r"([0-9]+)$", 1).try_cast("bigint")
    one = df.select(F.col(key).alias("k"), number.alias("n")).groupBy("k").agg(
        F.first("n").alias("n"))
    return one.agg(F.min("n").alias("first_id"), F.max("n").alias("last_id"),
                   F.count("k").alias("n_ids"),
                   (F.max("n") - F.min("n") + 1 - F.count("k")).alias("n_gaps"))


# --- value counts -------------------------------------------------------------------------------

def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share) over all non-null values."""
    counts = (df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
              .agg(F.count("*").alias("n")))
    # The total is the sum of the counts: the exchange below them is used twice, the input once.
    total = counts.select("n").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(
        "value", "n", (F.col("n") / F.col("total")).alias("share"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; equal counts in value order."""
    counts = (df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
              .agg(F.count("*").alias("n")))
    return counts.orderBy(F.desc("n"), F.asc("value")).limit(k)


def domain_counts(df: DataFrame, column: str, domain: Iterable[str]) -> DataFrame:
    """Counts of a fixed list of values, 0 for values that do not occur."""
    domain = list(domain)
    counts = df.agg(*[F.count_if(F.col(column) == v).alias(f"v{i}")
                      for i, v in enumerate(domain)])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(v).alias("value"),
                              F.col(f"v{i}").alias("n")) for i, v in enumerate(domain)])
    return counts.select(F.inline(rows))


def known(value: Column | str) -> Column:
    """The value as double; NaN counts as missing."""
    number = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(~F.isnan(number), number)


# --- distributions ------------------------------------------------------------------------------

def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum; the maximum falls into the last bin.

    (bin, low, high, n) with all bins, from one pass for the range and one for the counts.
    """
    values = df.select(known(column).alias("v")).filter("v is not null")
    ends = values.agg(F.min("v").alias("low"), F.max("v").alias("high")).head()
    if ends.low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n bigint")
    # An empty range is widened by one half on both sides.
    low, high = (ends.low, ends.high) if ends.high > ends.low else (ends.low - .5, ends.high + .5)
    width = (high - low) / bins
    place = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    counts = values.groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(low) + F.col("id") * F.lit(width)).alias("low"),
        (F.lit(low) + (F.col("id") + 1) * F.lit(width)).alias("high"))
    return grid.join(counts, "bin", "left").select(
        "bin", "low", "high", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


_DIGIT = 16     # bits of the sort key that one pass over the rows settles
_TALLY = "field int, bucket bigint, n bigint, low double, high double"


def _buckets(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Buckets with their counts, smallest and largest values, each bucket once."""
    bucket, n, low, high = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(bucket, kind="stable")
    bucket, first = np.unique(bucket[order], return_index=True)
    return (bucket, np.add.reduceat(n[order], first), np.minimum.reduceat(low[order], first),
            np.maximum.reduceat(high[order], first))


def _tally(shift: int, wanted: list[np.ndarray] | None):
    """Counts of the values by the upper bits of their sort key, column after column.

    The key of a double is its 64 bits with those below the sign turned for negative numbers: keys
    sort as the numbers do.  `wanted` restricts a column to buckets of the pass before.  A task
    keeps at most 2 ** _DIGIT buckets of each wanted one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for batch in batches:
            for c, column in enumerate(batch.columns):
                values = column.to_numpy(zero_copy_only=False)
                values = np.sort(values[~np.isnan(values)]) + 0.0       # one zero only
                bits = values.view(np.int64)
                keys = bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
                if wanted is not None:
                    inside = np.isin(keys >> (shift + _DIGIT), wanted[c])
                    keys, values = keys[inside], values[inside]
                if not len(keys):
                    continue
                bucket, first, n = np.unique(keys >> shift, return_index=True, return_counts=True)
                parts = held.setdefault(c, [])
                parts.append((bucket, n.astype(np.int64), values[first], values[first + n - 1]))
                if len(parts) == 64:
                    held[c] = [_buckets(parts)]
        for c, parts in held.items():
            bucket, n, low, high = _buckets(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(bucket), c, np.int32)), pa.array(bucket), pa.array(n),
                 pa.array(low), pa.array(high)], names=["field", "bucket", "n", "low", "high"])
    return run


def _selected(df: DataFrame, columns: list[str], probabilities: list[float]
              ) -> list[tuple[str, float, float]]:
    """Exact quantiles by selection: which bucket holds a wanted position, then what is in it."""
    numbers = df.select(*[known(c).alias(f"c{i}") for i, c in enumerate(columns)])

    def counts(shift: int, wanted: list[np.ndarray] | None) -> DataFrame:
        return numbers.mapInArrow(_tally(shift, wanted), _TALLY).groupBy("field", "bucket").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))

    def positions(tally: DataFrame, group: list, base: Column, ranks: Column) -> list:
        """The buckets that hold the ranks; a group has at most 2 ** _DIGIT buckets."""
        whole = Window.partitionBy(*group)
        upto = F.sum("n").over(whole.orderBy("bucket")) + base
        return (tally.withColumn("total", F.sum("n").over(whole)).withColumn("upto", upto)
                .withColumn("rank", F.explode(ranks))
                .where((F.col("upto") - F.col("n") <= F.col("rank")) & (
                    F.col("rank") < F.col("upto"))).drop("n").collect())

    at = [float(p) * (F.col("total") - 1) for p in probabilities]
    shift = 64 - _DIGIT
    found = positions(counts(shift, None), ["field"], F.lit(0),
                      F.array_distinct(F.array(*[f(x).cast("bigint") for x in at
                                                 for f in (F.floor, F.ceil)])))
    totals = {r.field: r.total for r in found}
    value: dict[tuple[int, int], float] = {}
    while True:
        value |= {(r.field, r.rank): r.low for r in found if r.low == r.high}
        # One row per wanted position: columns times probabilities, twice at most.
        open_ = [r for r in found if r.low != r.high]
        if not open_:
            break
        ranks: dict[tuple[int, int], list[int]] = {}
        for r in open_:
            ranks.setdefault((r.field, r.bucket), []).append(r.rank)
        ends = {(r.field, r.bucket): r.upto for r in open_}     # values up to the bucket's end
        shift -= _DIGIT
        wanted = [np.array([b for f, b in ranks if f == c], np.int64)
                  for c in range(len(columns))]
        tally = counts(shift, wanted).withColumn("prefix", F.shiftright("bucket", _DIGIT))
        known_ = df.sparkSession.createDataFrame(
            [(f, b, ends[f, b], ranks[f, b]) for f, b in ranks],
            "field int, prefix bigint, ends bigint, ranks array<bigint>")
        found = positions(
            tally.join(F.broadcast(known_), ["field", "prefix"]), ["field", "prefix"],
            F.col("ends") - F.sum("n").over(Window.partitionBy("field", "prefix")),
            F.col("ranks"))
    out = []
    for c, total in totals.items():
        for p in probabilities:
            place = float(p) * (total - 1)
            a, b = value[c, math.floor(place)], value[c, math.ceil(place)]
            out.append((columns[c], float(p), a + (b - a) * (place - math.floor(place))))
    return out


def quantiles(df: DataFrame, columns: list[str], probabilities: list[float],
              exact: bool = True) -> DataFrame:
    """(field, probability, value) with linear interpolation between neighbouring values.

    The exact form selects instead of sorting: tasks count the values of all columns by the upper
    16 bits of their sort key, the buckets with a wanted position are counted by the next 16 bits,
    and so on until a bucket has one value.  That takes two or three passes over the rows as a
    rule, four at most, run while the DataFrame is built; only bucket counts are shuffled.
    `exact=False` uses sketches of bounded size.  A column without values has no rows.
    """
    if exact:
        return df.sparkSession.createDataFrame(
            _selected(df, columns, probabilities), "field string, probability double, value double")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), known(c).alias("v"))
        for c in columns])).alias("x")).select("x.*").filter("v is not null")
    sketch = F.percentile_approx("v", probabilities, 10000)
    pairs = F.arrays_zip(F.array(*[F.lit(p) for p in probabilities]).alias("probability"),
                         F.col("q").alias("value"))
    return (long.groupBy("field").agg(sketch.alias("q"))
            .select("field", F.explode(pairs).alias("p"))
            .select("field", "p.probability", "p.value"))


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, count, mean, std, min, max) of several columns in one pass."""
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[F.struct(*[f(known(c)).alias(n) for n, f in stats.items()])
                    .alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), *[F.col(c)[n].alias(n) for n in stats])
                     for c in columns])
    return wide.select(F.inline(rows))


def describe(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """count, mean, std, min, quartiles and max per column."""
    quarters = {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    spread = (quantiles(df, columns, list(quarters), exact).groupBy("field")
              .agg(*[F.max(F.when(F.col("probability") == p, F.col("value"))).alias(n)
                     for p, n in quarters.items()]))
    return (moments(df, columns).join(F.broadcast(spread), "field", "left")
            .select("field", "count", "mean", "std", "min", *quarters.values(), "max"))


def rates(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: share of rows for which each condition holds, nulls left out."""
    return df.agg(*[F.avg(c.cast("double")).alias(n) for n, c in conditions.items()])


def counts_where(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def conditional_means(df: DataFrame, columns: list[str], sentinel: float = -1) -> DataFrame:
    """Means without the sentinel, and how many rows hold it."""
    return df.agg(*[
        a for c in columns for a in (
            F.avg(F.when(F.col(c) >= 0, F.col(c))).alias(f"mean_{c}"),
            F.count_if(F.col(c) == sentinel).alias(f"none_{c}"))])


def distinct_counts(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """One row of distinct non-null values per column.

    The exact form counts one column after another on its own keys: each is a narrow scan and
    a shuffle of that column's distinct values, and no row is multiplied.
    """
    if not exact:
        return df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
    parts = [df.select(F.col(c).alias("value")).distinct().agg(
        F.count("value").alias("n")).select(F.lit(c).alias("field"), "n") for c in columns]
    return reduce(DataFrame.unionByName, parts).agg(*[
        F.max(F.when(F.col("field") == c, F.col("n"))).alias(c) for c in columns])


_MOMENTS = ("n", "mx", "my", "xx", "yy", "xy")
_ENDS = ("x0", "x1", "y0", "y1")


def _merged(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """Moments of two sets of rows together; columns as in _MOMENTS and _ENDS, a row per pair."""
    if a is None:
        return b
    n = a[:, 0] + b[:, 0]
    some = np.maximum(n, 1)
    dx, dy = b[:, 1] - a[:, 1], b[:, 2] - a[:, 2]
    dx, dy = np.where(a[:, 0] * b[:, 0] > 0, dx, 0), np.where(a[:, 0] * b[:, 0] > 0, dy, 0)
    both = a[:, 0] * b[:, 0] / some
    first = a[:, :1] > 0
    mean = np.where(first, a[:, 1:3], b[:, 1:3]) + np.column_stack([dx, dy]) * (
        np.where(first[:, 0], b[:, 0], 0) / some)[:, None]
    return np.column_stack([
        n, mean, a[:, 3] + b[:, 3] + dx * dx * both, a[:, 4] + b[:, 4] + dy * dy * both,
        a[:, 5] + b[:, 5] + dx * dy * both, np.fmin(a[:, 6], b[:, 6]),
        np.fmax(a[:, 7], b[:, 7]), np.fmin(a[:, 8], b[:, 8]), np.fmax(a[:, 9], b[:, 9])])


def _one_pair(a: np.ndarray, b: np.ndarray) -> tuple:
    ma, mb = a.mean(), b.mean()
    da, db = a - ma, b - mb
    return (len(a), ma, mb, da @ da, db @ db, da @ db, a.min(), a.max(), b.min(), b.max())


def _varies(there: np.ndarray, known: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By pair, how many rows of both differ from the first value of column i, and that value."""
    first = x[there.argmax(axis=0), np.arange(x.shape[1])]
    return ((there & (x != first)).astype(float)).T @ known, first


def _batch_moments(x: np.ndarray, places: list[tuple[int, int]]) -> np.ndarray:
    """Moments of each pair of columns over the rows where both are known.

    Products of masked matrices give the sums of all pairs at once: with C the values less their
    column's mean, zero where unknown, and M the mask, they are M'M, C'M, (C*C)'M and C'C.  A pair
    is computed on its own rows only where that would lose digits (its mean is far from those of
    its columns), and where the products cannot tell whether a column varies.  A column that varies is
    marked by infinite ends.
    """
    out = np.zeros((len(places), 10))
    out[:, 6:] = np.nan
    if not len(places) or not len(x):
        return out
    i, j = np.array(places).T
    there = ~np.isnan(x)
    known = there.astype(float)
    with np.errstate(all="ignore"):
        centre = np.where(there, x, 0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
        finite = np.isfinite(np.where(there, x, 0)).all(axis=0) & np.isfinite(centre)
        c = np.where(there & finite, x - centre, 0)
    n, s, q, xy = (known.T @ known)[i, j], c.T @ known, (c * c).T @ known, (c.T @ c)[i, j]
    rows = np.maximum(n, 1)
    sx, sy, qx, qy = s[i, j], s[j, i], q[i, j], q[j, i]
    xx, yy = qx - sx * sx / rows, qy - sy * sy / rows
    differ, first = _varies(there, known, x)
    dx, dy = differ[i, j], differ[j, i]
    moved = np.column_stack([dx > 0, dy > 0])
    out[:, :6] = np.column_stack([n, centre[i] + sx / rows, centre[j] + sy / rows,
                                  np.where(moved[:, 0], xx, 0), np.where(moved[:, 1], yy, 0),
                                  np.where(moved.all(axis=1), xy - sx * sy / rows, 0)])
    still = np.column_stack([first[i], first[i], first[j], first[j]])
    ends = np.array([-np.inf, np.inf, -np.inf, np.inf])
    out[:, 6:] = np.where(moved[:, [0, 0, 1, 1]], ends, still)
    # A column of one value has exactly that mean.
    out[:, 1:3] = np.where(moved, out[:, 1:3], still[:, [0, 2]])
    unsure = (dx == n) | (dy == n) | (moved[:, 0] & (xx < 1e-4 * qx)) | (
        moved[:, 1] & (yy < 1e-4 * qy)) | ~finite[i] | ~finite[j]
    for k in np.flatnonzero((n > 0) & unsure):
        both = there[:, i[k]] & there[:, j[k]]
        with np.errstate(all="ignore"):
            out[k] = _one_pair(x[both, i[k]], x[both, j[k]])
    out[n == 0, 1:6] = 0
    out[n == 0, 6:] = np.nan
    return out


def _pair_moments(values: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Moments of every pair over the rows where both are known: one row per pair.

    One pass over the rows and the same method for any number of columns.  Each task merges its
    batches and puts out one row per pair; those rows are stored, and merged around the mean of
    the pair.
    """
    columns = values.columns
    places = [(columns.index(a), columns.index(b)) for a, b in pairs]

    def partial(batches):
        total = None
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float)
                                 for c in batch.columns])
            total = _merged(total, _batch_moments(x, places))
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(places)), pa.int32()), *[pa.array(c) for c in total.T]],
                ["pair", *_MOMENTS, *_ENDS])

    spark = values.sparkSession
    ddl = "pair int, " + ", ".join(f"{s} double" for s in (*_MOMENTS, *_ENDS))
    path = fresh_path(spark, "moments")
    values.mapInArrow(partial, ddl).where("n > 0").write.parquet(path)
    parts = spark.read.schema(ddl).parquet(path)
    means = parts.groupBy("pair").agg(*[
        (F.sum(F.col("n") * F.col(m)) / F.sum("n")).alias(f"all_{m}") for m in ("mx", "my")])
    dx, dy = F.col("mx") - F.col("all_mx"), F.col("my") - F.col("all_my")
    # One row per pair of columns.
    return parts.join(F.broadcast(means), "pair").groupBy("pair").agg(
        F.sum("n").alias("n"), F.sum(F.col("xx") + F.col("n") * dx * dx).alias("xx"),
        F.sum(F.col("yy") + F.col("n") * dy * dy).alias("yy"),
        F.sum(F.col("xy") + F.col("n") * dx * dy).alias("xy"),
        (F.min("x0") < F.max("x1")).alias("x_varies"),
        (F.min("y0") < F.max("y1")).alias("y_varies"))


def correlation(df: DataFrame, columns: list[str], sentinel: float | None = -1,
                part: str = "full") -> DataFrame:
    """Pearson correlation of each pair over the rows where both are known.

    The sentinel counts as missing in every column, and so does NaN.  Null when a column does
    not vary over those rows.  `part` is 'full' (both triangles and the diagonal) or 'lower'
    (each pair once, first column after the second).
    """
    def value(c: str) -> Column:
        number = known(c)
        return number if sentinel is None else sentinel_to_null(number, sentinel)

    pairs = list(combinations(columns, 2))
    # As SQL text: hundreds of literals made one call at a time take longer than the job.
    listed = ", ".join(f"({i}, {sql_text(a)}, {sql_text(b)})"
                       for i, (a, b) in enumerate(pairs)) or "(-1, '', '')"
    places = df.sparkSession.sql(
        f"SELECT * FROM VALUES {listed} AS t(pair, x, y) WHERE pair >= 0")
    moments_ = _pair_moments(df.select(*[value(c).alias(c) for c in columns]), pairs)
    # Pairs without a row in common have no moments.
    table = places.join(moments_, "pair", "left").select(
        F.struct("x", "y").alias("p"), F.when(
            (F.col("n") > 1) & F.col("x_varies") & F.col("y_varies"),
            F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy"))).alias("corr"))
    lower = table.select(F.col("p.y").alias("field_a"), F.col("p.x").alias("field_b"), "corr")
    if part == "lower":
        return lower
    rows = F.array(F.struct("field_a", "field_b", "corr"), F.struct(
        F.col("field_b").alias("field_a"), F.col("field_a").alias("field_b"), "corr"))
    diagonal = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], lower.schema)
    return lower.select(F.inline(rows)).unionByName(diagonal)


# --- flags --------------------------------------------------------------------------------------

def flag_breakdown(hits: DataFrame) -> DataFrame:
    """Findings per code, from (id, code, n) rows."""
    return hits.groupBy("code").agg(F.sum("n").alias("n_flags"), F.count("*").alias("n_records"))


def flag_totals(counted: DataFrame, flags: str = "n_flags") -> DataFrame:
    """Totals over records: flagged share, flags in all, flags per flagged record."""
    flagged = F.count_if(F.col(flags) > 0)
    total = F.sum(flags)
    return counted.agg(
        F.count("*").alias("n_records"), flagged.alias("n_flagged"), total.alias("n_flags"),
        F.try_divide(flagged.cast("double"), F.count("*").cast("double")).alias("flagged_share"),
        F.try_divide(total.cast("double"), flagged.cast("double")).alias("flags_per_flagged"))


def flag_histogram(counted: DataFrame, flags: str = "n_flags") -> DataFrame:
    """How many records have 1, 2, ... flags."""
    return (counted.filter(F.col(flags) > 0).groupBy(F.col(flags).cast("bigint").alias("flags"))
            .agg(F.count("*").alias("n")))


def worst_records(counted: DataFrame, k: int, flags: str = "n_flags",
                  key: str = "candidate_id") -> DataFrame:
    return counted.orderBy(F.desc(flags), F.asc(key)).limit(k)


# --- scores -------------------------------------------------------------------------------------

SCORE_BANDS = ((0.9, ">0.9"), (0.7, "0.7-0.9"), (0.5, "0.5-0.7"), (0.3, "0.3-0.5"))


def score_bands(scored: DataFrame, column: str = "final_score") -> DataFrame:
    """Records per score band; bounds belong to the lower band."""
    score = F.col(column)
    chain = F
    for bound, name in SCORE_BANDS:
        chain = chain.when(score > bound, name)
    return scored.groupBy(chain.otherwise("<0.3").alias("band")).agg(F.count("*").alias("n"))


def trust_bands(scored: DataFrame, column: str = "trust_score", floor: float = 0.25
                ) -> DataFrame:
    trust = F.col(column)
    return scored.agg(F.count_if(trust == 1.0).alias("full"), F.count_if(trust < 1.0)
                      .alias("reduced"), F.count_if(trust <= floor).alias("floor"))


def archetype_summary(ranked: DataFrame, archetype: Column) -> DataFrame:
    """Selected records per archetype with their mean scores."""
    return ranked.groupBy(archetype.alias("archetype")).agg(
        F.count("*").alias("n"), F.avg("final_score").alias("avg_score"),
        F.avg("domain_score").alias("avg_domain"), F.avg("skill_score").alias("avg_skill"))


def cohort_summary(ranked: DataFrame) -> DataFrame:
    """One row over the selected records; means are over the rows there are."""
    return ranked.agg(
        F.count("*").alias("n"), F.min("final_score").alias("min_score"),
        F.max("final_score").alias("max_score"),
        F.avg("implied_experience_years").alias("avg_experience"),
        F.avg("ai_skill_count").alias("avg_ai_skills"),
        F.avg("trust_score").alias("avg_trust"), F.avg("domain_score").alias("avg_domain"))


def selected_lists(ranked: DataFrame) -> DataFrame:
    """Core-skill counts and years of the selected records in rank order (k entries each)."""
    inside = F.array_sort(F.collect_list(F.struct("rank", "ai_skill_count", "years_experience")))
    return ranked.agg(inside.alias("x")).select(
        F.col("x.ai_skill_count").alias("ai_skill_counts"),
        F.col("x.years_experience").alias("experience"))


# --- exploded tables ----------------------------------------------------------------------------

def entries(records: DataFrame, array: str) -> DataFrame:
    """One row per array element with its record id and position."""
    return (records.select("candidate_id", F.posexplode(array).alias("pos", "e"))
            .select("candidate_id", "pos", "e.*"))


def job_summary(jobs: DataFrame, short_months: int = 3) -> DataFrame:
    return jobs.agg(F.count("*").alias("n_jobs"),
                    F.count_distinct("company").alias("n_companies"),
                    F.count_if(F.col("duration_months") < short_months).alias("n_very_short"))


def education_summary(education: DataFrame, max_years: int = 12, last_year: int = 2030
                      ) -> DataFrame:
    years = F.col("end_year") - F.col("start_year")
    impossible = (years < 0) | (years > max_years) | (F.col("end_year") > last_year)
    return education.agg(F.count("*").alias("n_entries"),
                         F.count_if(impossible).alias("n_impossible"))


def skill_frequency(records: DataFrame, skills: Iterable[str], k: int) -> DataFrame:
    """Records per listed skill (each skill once per record); the k most frequent."""
    wanted = F.array(*[F.lit(s) for s in skills])
    names = records.select(F.explode(F.array_intersect(F.col("skills.name"), wanted))
                           .alias("skill"))
    return top_values(names, "skill", k)


def dashboard(flat: DataFrame) -> DataFrame:
    """Key figures of the whole data set from the flat profile table, in one pass."""
    is_tier = lambda t: F.avg((F.col("highest_tier") == t).cast("double"))
    ai = F.col("n_ai_skills")
    return flat.agg(
        F.count("*").alias("n_records"), F.sum("n_skills").alias("n_skill_entries"),
        F.sum("n_edu").alias("n_education_entries"), F.sum("n_jobs").alias("n_job_entries"),
        F.min("years_of_experience").alias("min_years"),
        F.max("years_of_experience").alias("max_years"),
        F.avg("years_of_experience").alias("mean_years"),
        F.avg("implied_exp_years").alias("mean_implied_years"),
        F.count_if(F.abs("exp_discrepancy") > 5).alias("n_high_discrepancy"),
        *[is_tier(f"tier_{i}").alias(f"tier_{i}_share") for i in (1, 2, 3, 4)],
        F.count_if(ai == 0).alias("n_no_ai"), F.count_if(ai >= 5).alias("n_ai_5"),
        F.count_if(ai >= 10).alias("n_ai_10"),
        F.avg(F.col("open_to_work").cast("double")).alias("open_to_work"),
        F.avg(F.col("verified_email").cast("double")).alias("verified_email"),
        F.avg((F.col("github_activity_score") > -1).cast("double")).alias("github_linked"),
        F.avg(F.col("willing_to_relocate").cast("double")).alias("relocate"),
        F.avg("recruiter_response_rate").alias("response_rate"),
        F.avg("interview_completion_rate").alias("interview_rate"))


def outliers(flat: DataFrame) -> DataFrame:
    """Counts of extreme or contradictory rows of the flat profile table."""
    return counts_where(flat, {
        "high_discrepancy": F.abs("exp_discrepancy") > 5,
        "salary_known": F.col("salary_min").isNotNull() & F.col("salary_max").isNotNull(),
        "salary_inverted": F.col("salary_max") < F.col("salary_min"),
        "many_connections": F.col("connection_count") > 1000,
        "many_applications": F.col("applications_30d") > 15,
        "slow_response": F.col("avg_response_time_hours") > 500,
        "no_skills": F.col("n_skills") == 0,
        "no_education": F.col("n_edu") == 0,
        "no_github": F.col("github_activity_score") == -1,
    })


CORRELATED = (
    "years_of_experience", "implied_exp_years", "exp_discrepancy", "n_jobs", "n_skills",
    "n_ai_skills", "n_expert_skills", "n_advanced_skills", "n_edu", "n_certs", "n_assessments",
    "avg_assessment_score", "profile_completeness", "recruiter_response_rate",
    "interview_completion_rate", "offer_acceptance_rate", "github_activity_score",
    "connection_count", "endorsements_received", "profile_views_30d", "applications_30d",
    "search_appearance_30d", "saved_by_recruiters_30d", "avg_response_time_hours",
    "notice_period_days", "salary_min", "salary_max", "days_since_active",
)
