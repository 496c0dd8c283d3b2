"""Perspective rotation: a dialogue as training texts of each of its participants.

For every participant the dialogue is rendered with that speaker as the assistant and all others
as named users; the mask marks what the assistant says.  System turns stay system turns and are
no participant's.

A conversation of at most `part_turns` turns is one text, grouped by one shuffle.  A longer one,
which may have a third of all rows, is cut by the rank of its turns: its rows are range-sorted in
slices of similar size, so no task holds all of it, and every `part_turns` turns are one part.
Each part is rendered for every participant of the whole conversation, and the system turns of
the first part stand in front of all later ones.  All else is done inside the row by DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from credence.llm.common import column, join_checked, stored
from credence.operators.ordered import ranked

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    """Text that cannot be taken for a marker of the template."""
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def _turns_of(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per key with its turns in order; at most `part_turns` rows have a key."""
    return rows.groupBy(*keys).agg(
        F.any_value("conv_id").alias("conv_id"),
        # array_sort puts structs with a null turn first, as the sort of long conversations does.
        F.array_sort(F.collect_list(F.struct("turn", "role", "digest", "said"))).alias("turns"))


def _parts(turns: DataFrame, part_turns: int, system_role: str) -> DataFrame:
    """conv_id, part, before (repeated system turns), turns, speaker: a row per participant."""
    long = stored(turns.groupBy("key").agg(F.count("*").alias("n"))
                  .where(F.col("n") > part_turns).select("key"), "long-conversations")
    none = F.expr("cast(array() as array<struct<turn:bigint,role:string,digest:string,"
                  "said:string>>)")
    speakers = F.array_sort(F.array_distinct(F.filter(
        F.transform("turns", lambda t: t["role"]), lambda r: r != system_role)))
    columns = ["conv_id", "part", "before", "turns", "speaker"]
    short = _turns_of(join_checked(turns, long, ["key"], "left_anti"), "key").select(
        "conv_id", F.lit(0).cast("bigint").alias("part"), none.alias("before"), "turns",
        F.explode(speakers).alias("speaker")).select(*columns)
    if long.isEmpty():
        return short
    # Rows that are equal in all columns are told apart by their place, so they spread.
    rows = ranked(join_checked(turns, long, ["key"], "inner").withColumn(
        "row", F.monotonically_increasing_id()),
        *map(F.col, ("key", "turn", "role", "digest", "row")))
    first = stored(rows.groupBy("key").agg(F.min("rank").alias("first")), "first-turns")
    rows = join_checked(rows, first, ["key"], "inner").withColumn(
        "part", F.floor((F.col("rank") - F.col("first")) / part_turns).cast("bigint"))
    system = F.col("role") == system_role
    people = stored(rows.where(~system).select("key", F.col("role").alias("speaker")).distinct(),
                    "participants")
    # At most `part_turns` turns of a conversation.
    before = stored(_turns_of(rows.where(system & (F.col("part") == 0)), "key").select(
        "key", F.col("turns").alias("system")), "system-turns")
    parts = join_checked(join_checked(_turns_of(rows, "key", "part"), before, ["key"]),
                         people, ["key"], "inner")
    return short.unionByName(parts.withColumn("before", F.when(
        F.col("part") > 0, F.coalesce("system", none)).otherwise(none)).select(*columns))


def rendered(df: DataFrame, id_column: str = "conv_id", turn_column: str = "turn",
             role_column: str = "role", text_column: str = "text", part_turns: int = 128,
             system_role: str = "system") -> DataFrame:
    """One row per part and participant of its conversation: conv_id, part (from 0), speaker,
    n_turns, n_repeated, n_own, text, mask.

    mask has the [start, end) code points of what the speaker says, end markers included, as
    structs; it is empty where a participant is silent in a part.  n_turns counts the turns of
    the part, n_repeated the system turns in front that belong to the first part.  Turns are
    ordered by turn, role and SHA-256 of the text, nulls first, whatever their numbers; a null
    text is empty and a null role is the speaker "unknown".  Rows that repeat a turn are turns of
    their own; rows without an id are one conversation.  A conversation without any participant
    gives no row.  Other columns are ignored.
    """
    identity = column(id_column)
    said = F.coalesce(column(text_column).cast("string"), F.lit(""))
    turns = df.select(
        F.coalesce(F.concat(F.lit("="), identity.cast("string")), F.lit("")).alias("key"),
        identity.alias("conv_id"), column(turn_column).cast("bigint").alias("turn"),
        F.coalesce(column(role_column).cast("string"), F.lit("unknown")).alias("role"),
        F.sha2(said, 256).alias("digest"), said.alias("said"))
    each = _parts(turns, part_turns, system_role)

    def segment(t: Column) -> Column:
        own, system = t["role"] == F.col("speaker"), t["role"] == system_role
        head = F.when(system, F.lit(OPEN + "system\n")).when(
            own, F.lit(OPEN + "assistant\n")).otherwise(F.concat(
                F.lit(OPEN + "user name="),
                F.regexp_replace(escaped(t["role"]), "[\r\n]+", " "), F.lit("\n")))
        body = F.concat(escaped(t["said"]), F.lit(CLOSE))
        return F.struct(own.alias("own"), head.alias("head"), body.alias("body"),
                        F.length(head).alias("skip"), F.length(body).alias("size"))

    segments = F.transform(F.concat("before", "turns"), segment)
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    zero = F.lit(0).cast("bigint")

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["skip"]
        end = start + s["size"]
        return F.struct(end.cast("bigint").alias("at"), F.when(s["own"], F.concat(
            acc["spans"], F.array(F.struct(start.cast("bigint").alias("start"),
                                           end.cast("bigint").alias("end"))))
        ).otherwise(acc["spans"]).alias("spans"))

    mask = F.aggregate("segments", F.struct(zero.alias("at"), empty.alias("spans")), step,
                       lambda acc: acc["spans"])
    return each.select(
        "conv_id", "part", "speaker", F.size("turns").cast("bigint").alias("n_turns"),
        F.size("before").cast("bigint").alias("n_repeated"), segments.alias("segments")).select(
        "conv_id", "part", "speaker", "n_turns", "n_repeated",
        F.size(F.filter("segments", lambda s: s["own"])).cast("bigint").alias("n_own"),
        F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"])), "")
        .alias("text"), mask.alias("mask"))


def listed(mask: Column | str) -> Column:
    """start:end of the mask's spans, comma-joined."""
    return F.array_join(F.transform(mask, lambda s: F.concat_ws(
        ":", s["start"].cast("string"), s["end"].cast("string"))), ",")
