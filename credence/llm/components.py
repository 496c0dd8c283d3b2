"""Connected components by alternating large-star and small-star steps.

Kiveris and others, Connected Components in MapReduce and Beyond, 2014.  Each step is a grouped
minimum and a join on the node, so a hub with a third of all links is combined before the
shuffle and its join partition is split by adaptive execution.  Every round is written to the
shared folder; the links never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from credence.llm.common import stored


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
                           ).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (both.where("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"),
                                                          F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(moved).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) pairs of bigint nodes -> (node, root): root is the smallest node of the component.

    Nodes without a link have no row, nor has a root itself.  Repeated, reversed and self links
    do no harm; rows with a null end are no links.  Empty input gives an empty table.
    """
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"),
                                              F.least("a", "b").alias("b")).distinct(), "links",
                 links.count())
    before, state = None, _state(now)
    while state[0] and state != before:
        before = state
        # Neither step makes more links than there are.
        now = stored(_small_star(_large_star(now)), "links", state[0])
        state = _state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
