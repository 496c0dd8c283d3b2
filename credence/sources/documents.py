"""Readers for nested documents: JSON lines, JSON arrays, and what could not be read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from credence import schema as S
from credence.functions.coerce import strip
from credence.operators.normalize import normalize, untypable
from credence.operators.ordered import ranked

JSON_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": S.CORRUPT,
                "allowSingleQuotes": "false"}


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Non-blank lines with the file they come from.  Line-delimited files split freely."""
    return (spark.read.text(path)
            .select(F.col("_metadata.file_path").alias("source_file"), "value")
            .filter(strip(F.col("value")) != ""))


def signal_keys(keys: str | Sequence[str]) -> tuple[str, ...]:
    return (keys,) if isinstance(keys, str) else tuple(keys)


def parse_lines(lines: DataFrame, signals_keys: str | Sequence[str] = "signals") -> DataFrame:
    """Parse the `value` column.  Adds `reject_reason`, null for a usable document.

    The platform signals are read from whichever of `signals_keys` a document has (the first, if
    it has several) into the column `signals`, so data sets may mix layouts.

    The parsed fields leave a generator (`inline` over one struct).  Filters on them cannot be
    pushed below it, which would parse the text again for every field they mention.
    """
    keys = signal_keys(signals_keys)
    doc = F.from_json("value", S.raw_schema(*keys), JSON_OPTIONS)
    others = [c for c in lines.columns if c != "value"]
    parsed = lines.select(*others, "value", F.inline(F.array(doc)))
    signals = F.coalesce(*[F.col(f"`{k}`") for k in keys])
    rest = [f"`{c}`" for c in parsed.columns if c not in keys]
    return (parsed.select(*rest, signals.alias("signals"))
            .withColumn("reject_reason", reject_reason()))


def reject_reason() -> Column:
    """bad_json, missing_id, bad_value, or missing_signals: the document has an object of signals,
    but under a name that was not asked for.  One without any has the defaults of the contract."""
    # The parser also fills the corrupt slot for a wrong type somewhere, which is no syntax
    # error, and keeps the readable part of a cut text; only such texts are tokenised again.
    malformed = F.col(S.CORRUPT).isNotNull() & F.json_object_keys(S.CORRUPT).isNull()
    elsewhere = F.exists(F.json_object_keys("value"), lambda k: F.endswith(k, F.lit("signals")))
    unread = F.when(F.col("signals").isNull(), F.coalesce(elsewhere, F.lit(False)))
    return (F.when(malformed, "bad_json")
            .when(F.col("candidate_id").isNull(), "missing_id")
            .when(unread, "missing_signals")
            .when(untypable(), "bad_value"))


def accepted(parsed: DataFrame, on_error: str = "skip") -> DataFrame:
    """Usable documents.  `on_error="fail"` stops the job at the first unusable one."""
    if on_error == "skip":
        return parsed.filter(F.col("reject_reason").isNull())
    if on_error != "fail":
        raise ValueError(f"on_error is 'skip' or 'fail', not {on_error!r}")
    message = F.concat(F.lit("unusable document ("), F.col("reject_reason"), F.lit("): "),
                       F.substring("value", 1, 200))
    checked = F.when(F.col("reject_reason").isNull(), True).otherwise(
        F.raise_error(message).cast("boolean"))
    return parsed.filter(checked)


def quarantine(parsed: DataFrame) -> DataFrame:
    """Unusable documents: where they are, why, and their whole text.

    `locator` grows in reading order within a file split; it is not a line number.
    """
    origin = F.col("source_file") if "source_file" in parsed.columns else \
        F.lit(None).cast("string").alias("source_file")
    return (parsed.withColumn("locator", F.monotonically_increasing_id())
            .filter(F.col("reject_reason").isNotNull())
            .select(origin, "locator", "reject_reason", "value"))


def read_records(spark: SparkSession, path: str | list[str], signals_keys: str | Sequence[str],
                 on_error: str = "skip", defaults: bool = True,
                 limit: int | None = None) -> DataFrame:
    """Typed records from JSON lines.  `limit` is the sampling form (first rows only)."""
    records = normalize(accepted(parse_lines(read_lines(spark, path), signals_keys), on_error),
                        defaults=defaults)
    return records if limit is None else records.limit(limit)


def array_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The elements of files that hold one JSON list each, as the lines of `read_lines`.

    A JSON list cannot be split, so each file is one task; large inputs belong in JSON lines.  A
    file that is no list, or breaks off, gives its whole text as one line, which no parser of
    documents accepts, so it is turned away by `parse_lines` and kept by `quarantine`.
    """
    whole = (spark.read.text(path, wholetext=True)
             .select(F.col("_metadata.file_path").alias("source_file"), "value"))
    elements = F.when(_is_list(F.col("value")), F.from_json("value", "array<string>"))
    broken = F.array(F.concat(F.lit("not a JSON list: "), "value"))
    return (whole.select("source_file", F.explode(F.coalesce(elements, broken)).alias("value"))
            .select("source_file", F.coalesce("value", F.lit("null")).alias("value")))


def _is_list(value: Column) -> Column:
    """A complete JSON list: its length is only known if all of it can be read."""
    return F.startswith(strip(value), F.lit("[")) & F.json_array_length(value).isNotNull()


def read_json_array(spark: SparkSession, path: str | list[str],
                    signals_keys: str | Sequence[str] = "signals", on_error: str = "skip",
                    defaults: bool = True) -> DataFrame:
    """Typed records from files that hold one JSON list each; elements are turned away one by
    one.  `on_error="fail"` stops at the first, or at a file that is no list."""
    return normalize(accepted(parse_lines(array_lines(spark, path), signals_keys), on_error),
                     defaults=defaults)


def load_stats(parsed: DataFrame) -> DataFrame:
    """One row: how many documents were read, used and turned away, by reason."""
    why = F.col("reject_reason")
    return parsed.agg(
        F.count("*").alias("total_lines"),
        F.count_if(why.isNull()).alias("parsed_ok"),
        F.count_if(why == "bad_json").alias("parse_errors"),
        F.count_if(why == "missing_id").alias("missing_id"),
        F.count_if(why == "bad_value").alias("bad_value"),
        F.count_if(why == "missing_signals").alias("missing_signals"))


def observed_stats(parsed: DataFrame, observation) -> DataFrame:
    """The same counts as a side effect of the job that consumes `parsed`."""
    why = F.col("reject_reason")
    return parsed.observe(
        observation, F.count(F.lit(1)).alias("total_lines"),
        F.count_if(why.isNull()).alias("parsed_ok"),
        F.count_if(why.isNotNull()).alias("rejected"))


def read_line_stream(spark: SparkSession, path: str, files_per_batch: int | None = None
                     ) -> DataFrame:
    """Non-blank lines of files as they arrive; the batch size is a number of files."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).filter(strip(F.col("value")) != "")


def read_record_stream(spark: SparkSession, path: str,
                       signals_keys: str | Sequence[str] = "signals",
                       files_per_batch: int | None = None) -> DataFrame:
    """Typed records from files as they arrive."""
    return normalize(accepted(parse_lines(read_line_stream(spark, path, files_per_batch),
                                          signals_keys)))


def key_presence(lines: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Documents that have each top-level key (a key with a null value counts)."""
    present = lines.select(F.json_object_keys("value").alias("keys"))
    counts = present.agg(F.count("*").alias("total"), *[
        F.count_if(F.array_contains("keys", k)).alias(k) for k in keys])
    return (counts.unpivot("total", list(keys), "field", "n_present")
            .select("field", "n_present",
                    (F.col("n_present") * 100.0 / F.nullif(F.col("total"), F.lit(0)))
                    .alias("pct_present")))


def in_chunks(df: DataFrame, size: int, *order: Column, name: str = "chunk") -> DataFrame:
    """Number consecutive runs of `size` rows from 0.  Runs follow the given total order."""
    return (ranked(df, *order, name="_row")
            .withColumn(name, F.floor((F.col("_row") - 1) / F.lit(size)).cast("bigint"))
            .drop("_row"))
