"""Array column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def total(array: Column, value: Callable[[Column], Column], kind: str = "bigint") -> Column:
    """Sum of `value(element)` in array order."""
    return F.aggregate(array, F.lit(0).cast(kind), lambda acc, e: acc + value(e).cast(kind))


def count_where(array: Column, condition: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(array, condition))


def first_where(array: Column, condition: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(array, condition), F.lit(0))


def numbered(array: Column, value: Callable[[Column, Column], Column]) -> Column:
    """Elements together with their position, counted from 0."""
    return F.transform(array, value)


def adjacent_pairs(array: Column, pair: Callable[[Column, Column], Column]) -> Column:
    """`pair(element, next element)` for an array that is already in order."""
    pairs = F.greatest(F.size(array) - 1, F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), pairs), F.slice(array, F.lit(2), pairs), pair)


def adjacent_overlaps(array: Column, start: Callable[[Column], Column],
                      end: Callable[[Column], Column],
                      payload: Callable[[Column], dict[str, Column]]) -> Column:
    """Neighbouring intervals, ordered by start, where the next begins before this one ends.

    Only neighbours are compared.  Equal starts keep their array order.  Each result is
    struct<left, right> of `payload` plus start and end.
    """
    keyed = F.transform(array, lambda e, i: F.struct(
        start(e).alias("start"), i.alias("at"), end(e).alias("end"),
        *[v.alias(n) for n, v in payload(e).items()]))
    ordered = F.array_sort(keyed)
    pairs = adjacent_pairs(ordered, lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return F.filter(pairs, lambda p: p["right"]["start"] < p["left"]["end"])
