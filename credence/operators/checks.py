"""Checks of a ranked output.  Each violation is one row (check, place, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from credence.functions.coerce import number_or_null, strip
from credence.operators.ordered import ranked, with_next
from credence.session import fresh_path, kept
from credence.settings import ID_PATTERN, RANKED_COLUMNS

_EMPTY = "check string, place bigint, detail string"


def _violation(df: DataFrame, check: str, condition: Column, place: Column, detail: Column
               ) -> DataFrame:
    return df.filter(condition).select(F.lit(check).alias("check"),
                                       place.cast("bigint").alias("place"),
                                       detail.alias("detail"))


def check_table(df: DataFrame, expected_rows: int = 100,
                columns: tuple[str, ...] = RANKED_COLUMNS) -> DataFrame:
    """Checks of the in-memory result: shape, ids, ranks, order of scores, empty values."""
    spark = df.sparkSession
    if tuple(df.columns) != tuple(columns):
        return spark.createDataFrame(
            [("columns", None, f"Columns are {df.columns}, expected {list(columns)}.")], _EMPTY)
    df = kept(df, "checked")        # counted, sampled and sorted: made once
    ids, rank, score, text = [F.col(c) for c in columns]
    totals = df.agg(
        F.count("*").alias("n"), F.count_distinct(ids).alias("n_ids"),
        F.count_distinct(F.when(rank.between(1, expected_rows), rank)).alias("n_ranks"),
        F.count_if(text.isNull() | (text == "")).alias("n_blank"),
        F.count_if(ids.isNull() | rank.isNull() | score.isNull() | text.isNull())
        .alias("n_null"))
    n = F.col("n")
    fault = lambda check, detail: F.struct(F.lit(check).alias("check"), detail.alias("detail"))
    wrong = F.array_compact(F.array(
        F.when(n != expected_rows, fault("row_count", F.format_string(
            f"Row count is %d, expected {expected_rows}.", n))),
        F.when(F.col("n_ids") != n, fault("duplicate_id", F.lit(
            "Duplicate candidate_ids found."))),
        F.when((F.col("n_ranks") != expected_rows) | (n != expected_rows), fault(
            "ranks", F.lit(f"Ranks are not exactly 1 to {expected_rows} in order."))),
        F.when(F.col("n_blank") > 0, fault("empty_reasoning", F.lit(
            "Empty reasoning strings found."))),
        F.when(F.col("n_null") > 0, fault("nulls", F.lit("Null values found in dataframe.")))))
    summary = (totals.select(F.explode(wrong).alias("w"))
               .select("w.check", F.lit(None).cast("bigint").alias("place"), "w.detail"))
    steps = with_next(df.select(rank, score, ids), [], [F.asc(columns[1]), F.asc(columns[0])],
                      [columns[2]])
    rising = (steps.agg(F.count_if(F.col(f"next_{columns[2]}") > score).alias("n_up"))
              .filter("n_up > 0")
              .select(F.lit("score_order").alias("check"),
                      F.lit(None).cast("bigint").alias("place"),
                      F.lit("Scores are not sorted descending.").alias("detail")))
    return summary.unionByName(rising)


def is_valid(violations: DataFrame) -> bool:
    return violations.isEmpty()


def numbered_rows(raw: DataFrame) -> DataFrame:
    """Data rows of a file read by `sources.csv_cells`, numbered as in the file (header is 1).

    Rows that hold only blanks are left out and take no number.
    """
    used = raw.filter(~F.col("is_header") & F.exists("cells", lambda c: strip(c) != ""))
    rows = ranked(used.drop("fault"), F.asc("source_file"), F.asc("locator"), name="row_num")
    return rows.withColumn("row_num", F.col("row_num") + 1)


def check_encoding(raw: DataFrame) -> DataFrame:
    """What is wrong with a file as a whole."""
    detail = F.when(F.col("fault") == "utf8", "the file is not UTF-8.").otherwise(
        "a quoted cell is not closed.")
    # A file without a byte gives no row at all.
    rows = raw.agg(F.count("*").alias("n"))
    return _violation(raw, "encoding", F.col("fault").isNotNull(),
                      F.when(F.col("fault") == "quotes", F.col("locator") + 1), detail).unionByName(
        _violation(rows, "encoding", F.col("n") == 0, F.lit(None), F.lit("the file is empty.")))


def check_header(raw: DataFrame, columns: tuple[str, ...] = RANKED_COLUMNS) -> DataFrame:
    wanted = F.array(*[F.lit(c) for c in columns])
    # One row, also for a file that has none.
    header = raw.filter("is_header").agg(F.count("*").alias("n"), F.collect_list("cells").alias(
        "found"), F.count_if(F.col("cells") == wanted).alias("good"))
    found = F.array_join(F.transform("found", lambda c: F.array_join(c, ",")), " | ")
    return _violation(header, "header", (F.col("n") == 0) | (F.col("good") < F.col("n")),
                      F.lit(1), F.concat(F.lit(
                          f"Row 1 (header) must be exactly: {','.join(columns)}; found: "), found))


def check_cells(rows: DataFrame, expected_rows: int = 100, id_pattern: str = ID_PATTERN,
                columns: tuple[str, ...] = RANKED_COLUMNS) -> DataFrame:
    """Checks of the text rows (`row_num`, `cells`): the first use of an id or rank is accepted,
    later ones are reported; order is checked between neighbouring ranks."""
    width = len(columns)
    place = F.col("row_num")
    cell = lambda i: strip(F.get(F.col("cells"), F.lit(i)))
    typed = rows.select(
        "row_num", F.size("cells").alias("n_cells"), cell(0).alias("id"),
        cell(1).alias("rank_text"), number_or_null(cell(2)).alias("score")).withColumns({
            # Text is canonical when printing the number gives the same text again.
            "rank": F.when(F.col("rank_text").try_cast("bigint").cast("string")
                           == F.col("rank_text"), F.col("rank_text").try_cast("bigint")),
            "id_ok": F.col("id").rlike(id_pattern),
        }).withColumn("rank_ok", F.coalesce(F.col("rank").between(1, expected_rows),
                                            F.lit(False)))

    # The typed cells are narrow and read by every check below: the rows are cast once.
    spark, path = rows.sparkSession, fresh_path(rows.sparkSession, "cells")
    typed.write.parquet(path)
    typed = spark.read.schema(typed.schema).parquet(path)
    count = (typed.agg(F.count("*").alias("n")).filter(F.col("n") != expected_rows)
             .select(F.lit("row_count").alias("check"), F.lit(None).cast("bigint").alias("place"),
                     F.format_string(f"there must be exactly {expected_rows} data rows; "
                                     "found %d.", F.col("n")).alias("detail")))

    fault = lambda condition, check, detail: F.when(condition, F.struct(
        F.lit(check).alias("check"), place.cast("bigint").alias("place"),
        detail.alias("detail")))
    id_, rank, whole = F.col("id"), F.col("rank"), F.col("n_cells") == width
    # One pass for everything that concerns a single row.
    per_row = typed.select(F.inline(F.array_compact(F.array(
        fault(~whole, "cells", F.format_string(f"expected {width} columns, got %d.",
                                               F.col("n_cells"))),
        fault(whole & (id_ == ""), "id_required", F.lit("candidate_id is required.")),
        fault(whole & (id_ != "") & ~F.col("id_ok"), "id_format",
              F.lit("candidate_id must be CAND_XXXXXXX (7 digits).")),
        fault(whole & rank.isNull(), "rank_integer",
              F.lit(f"rank must be an integer (1–{expected_rows}).")),
        fault(whole & rank.isNotNull() & ~F.col("rank_ok"), "rank_range",
              F.lit(f"rank must be between 1 and {expected_rows}.")),
        fault(whole & F.col("score").isNull(), "score_number",
              F.lit("score must be a float."))))))

    def repeats(accepted: DataFrame, column: str, check: str, few: bool = False) -> DataFrame:
        """Rows after the first use of a value; `few` says the values are a bounded number."""
        firsts = accepted.groupBy(column).agg(F.min("row_num").alias("first"),
                                              F.count("*").alias("n")).filter("n > 1")
        later = accepted.join(F.broadcast(firsts) if few else firsts, column).filter(
            F.col("row_num") > F.col("first"))
        return _violation(later, check, F.lit(True), place,
                          F.format_string("duplicate %s", F.col(column).cast("string")))

    full = typed.filter(whole)
    ranks = full.filter("rank_ok").select("row_num", "rank")
    missing = _violation(missing_ranks(ranks, expected_rows), "rank_missing", F.lit(True), rank,
                         F.format_string("missing rank %d", rank))
    complete = full.filter("rank is not null and score is not null and id <> ''")
    return _union([count, per_row,
                   repeats(full.filter("id_ok").select("row_num", "id"), "id", "id_duplicate"),
                   repeats(ranks, "rank", "rank_duplicate", few=True), missing,
                   order_violations(complete.select("rank", "row_num", "score", "id"))])


def missing_ranks(rows: DataFrame, expected_rows: int) -> DataFrame:
    """Ranks 1..n that no row has."""
    wanted = rows.sparkSession.range(1, expected_rows + 1).withColumnRenamed("id", "rank")
    return wanted.join(rows.select("rank").distinct(), "rank", "left_anti")


def order_violations(rows: DataFrame) -> DataFrame:
    """Neighbouring ranks whose scores rise, or whose equal scores break ties the wrong way."""
    steps = with_next(rows.select("rank", "row_num", "score", "id"), [],
                      [F.asc("rank"), F.asc("row_num")], ["rank", "score", "id"])
    rises = _violation(steps, "score_order", F.col("score") < F.col("next_score"), F.col("rank"),
                       F.format_string("rank %d (%s) < rank %d (%s)", F.col("rank"),
                                       F.col("score").cast("string"), F.col("next_rank"),
                                       F.col("next_score").cast("string")))
    ties = _violation(steps, "tie_order",
                      (F.col("score") == F.col("next_score")) & (F.col("id") > F.col("next_id")),
                      F.col("rank"),
                      F.format_string("equal scores at ranks %d and %d: '%s' > '%s'",
                                      F.col("rank"), F.col("next_rank"), F.col("id"),
                                      F.col("next_id")))
    return rises.unionByName(ties)


def check_file(spark: SparkSession, path: str, expected_rows: int = 100,
               columns: tuple[str, ...] = RANKED_COLUMNS) -> DataFrame:
    """All checks of a CSV file."""
    from credence.sources.csv_cells import read_csv_cells
    named = [] if path.lower().endswith(".csv") else [
        ("suffix", None, "Filename must use a .csv extension.")]
    # Four checks read the rows, one of them twice for its sort: the files are parsed once.
    raw = kept(read_csv_cells(spark, path), "csv-cells")
    return _union([spark.createDataFrame(named, _EMPTY), check_encoding(raw),
                   check_header(raw, columns),
                   check_cells(numbered_rows(raw), expected_rows, columns=columns)])


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
