"""Neighbouring rows of the same key: gaps and overlaps.  Table form, safe for hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from credence.operators.ordered import with_next


def adjacent_overlaps(df: DataFrame, key: str, start: str, end: str, tie: list[str],
                      min_overlap: float | None = None) -> DataFrame:
    """Pairs of neighbouring intervals (by start) of one key that overlap.

    `overlap` is in days for dates and in units of the columns otherwise.  Rows without a start
    or an end take no part.  With `min_overlap` only larger overlaps are kept.
    """
    known = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    paired = with_next(known, [key], [F.asc(start), *[F.asc(t) for t in tie]],
                       [start, end, *tie])
    is_date = dict(df.dtypes)[start] in ("date", "timestamp")
    overlap = F.datediff(F.col(end), F.col(f"next_{start}")) if is_date else \
        F.col(end) - F.col(f"next_{start}")
    pairs = paired.filter(F.col(f"next_{start}") < F.col(end)).withColumn("overlap", overlap)
    return pairs if min_overlap is None else pairs.filter(F.col("overlap") > min_overlap)


def education_overlaps(entries: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Number of overlapping neighbours per person, with the null rules of the profile.

    Rows without a start sort last; a pair counts when the first has an end and the second a
    start.  Takes exploded entries with a position column `pos`.
    """
    paired = with_next(entries, [key], [F.asc_nulls_last("start_year"), F.asc("pos")],
                       ["start_year"])
    overlapping = F.col("end_year").isNotNull() & (F.col("next_start_year") < F.col("end_year"))
    return paired.groupBy(key).agg(F.count_if(overlapping).alias("n_overlaps"))


def gap_to_next(df: DataFrame, key: str, at: str, tie: list[str],
                gap: Column | None = None) -> DataFrame:
    """Seconds from each row to the following row of the same key; null for the last one."""
    paired = with_next(df, [key], [F.asc(at), *[F.asc(t) for t in tie]], [at])
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    between = gap if gap is not None else (micros(f"next_{at}") - micros(at)) / F.lit(1e6)
    return paired.withColumn("gap", between)
