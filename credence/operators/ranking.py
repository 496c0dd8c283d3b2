"""Top-k, ranks, overlaps between rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from credence.functions.numeric import round_exact
from credence.operators.objectives import top_k_by_weights
from credence.operators.ordered import ranked
from credence.operators.scoring import COMPONENTS
from credence.session import kept
from credence.settings import SCENARIOS, ScoreWeights

SCORE_DIGITS = 4


def numbered(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Row numbers for a result that is known to be small (after a limit)."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def top_k(df: DataFrame, k: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first k rows with their rank.  Each task keeps k rows, so nothing is shuffled whole."""
    return numbered(df.orderBy(*order).limit(k), *order, name=name)


def top_ranked(scored: DataFrame, k: int = 100, key: str = "candidate_id",
               dedupe: str = "keep") -> DataFrame:
    """Published order: score rounded to four decimals, then id.  Fewer rows if there are fewer.

    Repeated ids are all listed ("keep"), listed once with their best row ("best": one shuffle by
    id before the top-k), or stop the job if one is listed twice ("fail").
    """
    rounded = scored.withColumn("score", round_exact(F.col("final_score"), SCORE_DIGITS))
    if dedupe == "best":
        rounded = deduplicated(rounded, key, "first", [F.desc("score"), F.desc("final_score")])
    elif dedupe not in ("keep", "fail"):
        raise ValueError(f"dedupe is 'keep', 'best' or 'fail', not {dedupe!r}")
    top = top_k(rounded, k, F.desc("score"), F.asc(key))
    if dedupe == "fail":        # k rows
        message = F.concat(F.lit("repeated id: "), F.col(key).cast("string"))
        times = F.count("*").over(Window.partitionBy(key))
        top = top.withColumn("_times", times).filter(F.when(
            F.col("_times") > 1, F.raise_error(message).cast("boolean")).otherwise(True)).drop(
            "_times").orderBy("rank")
    return top


def top_by(scored: DataFrame, column: str, k: int = 100, key: str = "candidate_id") -> DataFrame:
    """First k by an unrounded column; equal values in id order."""
    return top_k(scored, k, F.desc(column), F.asc(key))


def rank_all(scored: DataFrame, column: str = "final_score", key: str = "candidate_id"
             ) -> DataFrame:
    """Every row with its rank by (column descending, id)."""
    return ranked(scored, F.desc(column), F.asc(key))


def top_k_per_group(df: DataFrame, keys: list[str], k: int, *order: Column,
                    name: str = "rank", salts: int = 64) -> DataFrame:
    """First k rows of each group.

    Spark cuts groups to k rows before the shuffle.  Groups first compete inside salted parts,
    so a group with a third of all rows is sorted by many tasks, and the final contest of a group
    sees at most `salts * k` rows.
    """
    plain = [c for c, kind in df.dtypes if not kind.startswith(("map", "array", "struct"))]
    salt = F.pmod(F.xxhash64(*plain), F.lit(salts))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    part = (df.withColumn("_salt", salt).withColumn("_rn", F.row_number().over(first))
            .filter(F.col("_rn") <= k).drop("_rn", "_salt"))
    return part.withColumn(name, F.row_number().over(final)).filter(F.col(name) <= k)


def deduplicated(df: DataFrame, key: str, how: str = "keep", order: list[Column] | None = None
                 ) -> DataFrame:
    """What to do with repeated ids: 'keep' all, 'first' by `order`, or 'fail'."""
    if how == "keep":
        return df
    if how == "first":
        if not order:
            raise ValueError("how='first' needs an order")
        return top_k_per_group(df, [key], 1, *order, name="_rank").drop("_rank")
    if how == "fail":
        # The message depends on the count, so the check cannot move below the grouping.
        message = F.concat(F.lit("repeated id: "), F.col(key).cast("string"))
        checked = df.groupBy(key).agg(F.count("*").alias("_n")).filter(
            F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(False))
        return df.join(checked, key, "left_anti")
    raise ValueError(f"how is 'keep', 'first' or 'fail', not {how!r}")


def scenario_overlaps(scored: DataFrame, scenarios: dict[str, ScoreWeights] | None = None,
                      cuts: tuple[int, ...] = (20, 50, 100), baseline: str = "A",
                      key: str = "candidate_id") -> DataFrame:
    """How many of the baseline's top-n each other scenario keeps.

    One pass over the rows: every task keeps the deepest list of each scenario.
    """
    scenarios = scenarios or SCENARIOS
    tops = top_k_by_weights(
        scored, [f"{c}_score" for c in COMPONENTS],
        {n: [getattr(w, c) for c in COMPONENTS] for n, w in scenarios.items()}, "trust_score",
        max(cuts), key).withColumnRenamed("objective", "scenario")
    # At most `max(cuts)` rows per scenario from here on.
    ranks = tops.groupBy(key).pivot("scenario", list(scenarios)).agg(F.first("rank"))
    others = [s for s in scenarios if s != baseline]
    counts = ranks.agg(*[
        F.count_if((F.col(baseline) <= n) & (F.col(s) <= n)).alias(f"{s}|{n}")
        for s in others for n in cuts])
    rows = F.array(*[
        F.struct(F.lit(s).alias("scenario"), F.lit(scenarios[s].domain).alias("domain_weight"),
                 F.lit(scenarios[s].skill).alias("skill_weight"),
                 *[F.col(f"`{s}|{n}`").alias(f"top_{n}_overlap") for n in cuts])
        for s in others])
    return counts.select(F.inline(rows))


def ablation(scored: DataFrame, k: int = 100, key: str = "candidate_id") -> DataFrame:
    """Overlap of the top-k with the baseline when one component's weight is set to zero."""
    base = ScoreWeights()
    scenarios = {"baseline": base, **{f"no_{c}": base.without(c) for c in COMPONENTS}}
    return (scenario_overlaps(scored, scenarios, (k,), "baseline", key)
            .select("scenario", F.col(f"top_{k}_overlap").alias("kept")))


def fell_out(scored: DataFrame, k: int = 100, show: int = 5, key: str = "candidate_id"
             ) -> DataFrame:
    """Rows in the top-k by raw score that trust pushed out of the final top-k."""
    # Both lists read the scores, which are made once.
    columns = kept(scored.select(key, "raw_score", "final_score", "trust_score"), "scores")
    raw = top_by(columns, "raw_score", k, key)
    final = top_by(columns, "final_score", k, key).select(key)
    lost = raw.join(F.broadcast(final), key, "left_anti").drop("rank")
    return top_k(lost, show, F.desc("raw_score"), F.asc(key))


def matching(df: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Rows whose key was selected, however many were.

    Spark broadcasts the keys if they are few, as those of a top-k result are.
    """
    return df.join(selected.select(key), key, "left_semi")


def ndcg_at_k(df: DataFrame, group: str, order: list[Column], gain: str, k: int) -> DataFrame:
    """Normalised discounted cumulative gain of the first k rows of each group."""
    def discounted(rows: DataFrame) -> DataFrame:
        worth = F.col(gain) / F.log2(F.col("rank") + F.lit(1.0))
        return rows.groupBy(group).agg(F.sum(worth).alias("dcg"))

    actual = discounted(top_k_per_group(df, [group], k, *order))
    ideal = discounted(top_k_per_group(df, [group], k, F.desc(gain)))
    return (actual.join(ideal.withColumnRenamed("dcg", "ideal_dcg"), group)
            .withColumn("ndcg", F.coalesce(F.try_divide("dcg", "ideal_dcg"), F.lit(0.0))))
