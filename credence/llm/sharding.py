"""Sharding by sampled splitters.

The key of a record is a hash of its text, so equal texts are neighbours.  A size-weighted sample
of the keys gives quantile boundaries, and records are range-partitioned between them.  A key
that is two boundaries in a row gets a range of its own.  Ranges with more than `overfull` times
the mean size are subdivided: by the key, or by a hash of the id where the range is one single
key, so a group of copies with a third of all bytes is spread and any other group stays together.

Shards are runs of ranges, cut where the exact running total of bytes passes an eighth (or what
the number of shards is); a group of copies goes where its middle lies.  What is broadcast has
one row per range or per cell of the key space; the number of ranges follows from the bytes,
never from the groups.  All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from credence.llm.common import column, stored

_KEY_BITS = 53      # quantiles are computed in doubles, which hold such keys exactly
_CELL_BITS = 12
_SHIFT = _KEY_BITS - _CELL_BITS


def _uniform(*keys: Column | str) -> Column:
    """A number in [0, 1) that follows from the row: a repeated task draws the same sample."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _splitters(records: DataFrame, ranges: int, per_range: int, total: int) -> DataFrame:
    """Range starts (s) from a sample in which a record's chance grows with its size."""
    steps = F.col("size") * F.lit(per_range * ranges / max(total, 1))
    # A record larger than a sampling step counts as often as steps fit into it.
    times = F.floor(steps + _uniform("key", "doc_id", F.lit("sample"))).cast("int")
    sample = records.select("key", times.alias("times")).where("times > 0").select(
        "key", F.explode(F.sequence(F.lit(1), F.col("times"))))
    cuts = sample.agg(F.percentile_approx(
        "key", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("cuts"))
    at = cuts.select(F.explode("cuts").alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    own = at.where("n > 1").select((F.col("s") + 1).alias("s"))
    return at.select("s").union(own).distinct()


def _cells(splitters: DataFrame) -> DataFrame:
    """Of each cell of the key space: the splitters inside, and the number of those before."""
    inside = splitters.groupBy(F.shiftright("s", _SHIFT).alias("cell")).agg(
        F.collect_list("s").alias("starts"))
    every = splitters.sparkSession.range(1 << _CELL_BITS).select(F.col("id").alias("cell")).join(
        inside, "cell", "left").withColumn(
        "starts", F.coalesce("starts", F.array().cast("array<bigint>")))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return every.withColumn("before", F.coalesce(F.sum(F.size("starts")).over(before), F.lit(0)))


def shard(df: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text",
          min_ranges: int = 1024, range_bytes: int = 256 << 20, per_range: int = 8,
          overfull: float = 2.0) -> DataFrame:
    """One row per row: doc_id, size, text_crc32, shard, slot.

    Sizes are UTF-8 bytes and 1; a null text has none and the checksum of the empty text.  Shards
    differ in bytes by a few ranges' sizes or one record at most; slots count from 0 in the order
    of the keys.  Repeated rows each get a slot.  Other columns are ignored; an empty table gives
    an empty one.
    """
    text = F.coalesce(column(text_column).cast("string"), F.lit(""))
    records = stored(df.select(
        column(id_column).cast("bigint").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.shiftrightunsigned(
            F.xxhash64(text), 64 - _KEY_BITS).alias("key")), "records")
    total = records.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = max(min_ranges, -(-total // range_bytes))
    mean = max(total, 1) / ranges

    cells = stored(_cells(_splitters(records, ranges, per_range, total)), "cells")
    ranged = records.withColumn("cell", F.shiftright("key", _SHIFT)).join(
        F.broadcast(cells), "cell").withColumn("range", F.col("before") + F.size(F.filter(
            "starts", lambda s: s <= F.col("key")))).drop("cell", "starts", "before")

    # Exact sizes; a range over the limit gets several pieces.
    sizes = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("key").alias("low"),
                                        F.max("key").alias("high"))
    pieces = stored(sizes.select(
        "range", "low", "high", F.when(F.col("bytes") > overfull * mean, F.ceil(
            F.col("bytes") / mean)).otherwise(1).cast("bigint").alias("pieces")), "ranges")
    low, high = F.col("low").cast("double"), F.col("high").cast("double")
    along = (F.col("key").cast("double") - low) / (high - low + 1) * F.col("pieces")
    piece = F.when(F.col("pieces") == 1, 0).when(
        F.col("low") == F.col("high"),
        F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.col("pieces"))).otherwise(
        F.least(F.floor(along), F.col("pieces") - 1)).cast("bigint")
    placed = ranged.join(F.broadcast(pieces), "range").select(
        "doc_id", "size", "text_crc32", "key", "range", piece.alias("piece"),
        (F.col("low") == F.col("high")).alias("single"))

    before = Window.orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(placed.groupBy("range", "piece").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n")).select(
        "range", "piece", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before")), "pieces")
    own = Window.partitionBy("range", "piece")
    upto = own.orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    groups = own.orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    group = F.sum("size").over(Window.partitionBy("range", "piece", "key"))
    # A range of one key is cut record by record, any other group by group.
    middle = F.when(F.col("single"), F.sum("size").over(upto) - F.col("size") / 2).otherwise(
        F.sum("size").over(groups) - group / 2)
    numbered = stored(placed.join(F.broadcast(starts), ["range", "piece"]).select(
        "doc_id", "size", "text_crc32",
        F.least(F.lit(shards - 1), F.floor((F.col("bytes_before") + middle) * shards / F.lit(
            float(max(total, 1))))).cast("int").alias("shard"),
        (F.col("rows_before") + F.row_number().over(own.orderBy("key", "doc_id")) - 1).alias(
            "place")), "numbered")
    first = numbered.groupBy("shard").agg(F.min("place").alias("first"))
    return numbered.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("place") - F.col("first")).cast("bigint").alias("slot"))
