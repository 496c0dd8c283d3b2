"""Registered queries: each operator on the driver's tables.  `catalog.oracle` has the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalog import view
from credence import settings
from credence.functions import text as T
from credence.functions.automaton import KeywordAutomaton
from credence.functions.coerce import integer, integer_or_null
from credence.operators import (checks, evidence, explain, features as X, intervals,
                                normalize as N, ordered, profile as P, ranking as R, rules,
                                scoring as C)
from credence.plans import audit, rank_records
from credence.session import fresh_path, kept
from credence.sources import documents as D, sinks
from credence.sources.csv_cells import read_csv_cells
from credence.sources.tables import parts_for, read_table, spread
from credence.streaming import scoring as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def r6(value: Column | str) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column.cast("double"), 6)


def whole(value: Column | str) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return column.cast("bigint")


def cand(spark: SparkSession, sf: str) -> DataFrame:
    return view.load(spark, sf)


def derived(spark: SparkSession, sf: str) -> DataFrame:
    return N.derive(cand(spark, sf))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return C.score_records(cand(spark, sf))


# --- sources ----------------------------------------------------------------------------------

@register
def normalize_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    lines = view.as_json(view.load(spark, sf, raw=True), "platform_signals")
    parsed = D.parse_lines(lines, "platform_signals")
    d = N.derive(N.normalize(D.accepted(parsed)))
    return d.select(
        "candidate_id", F.col("profile.current_title").alias("title"),
        F.col("profile.headline").alias("headline"), whole("total_career_months").alias("months"),
        r6("implied_experience_years").alias("implied"),
        r6("experience_discrepancy").alias("gap"), whole("n_skills").alias("n_skills"),
        whole("n_jobs").alias("n_jobs"), F.col("current_job.company").alias("current_company"),
        F.col("highest_education_tier").alias("tier"), "salary_inverted",
        r6("salary_midpoint").alias("salary_midpoint"), "has_github", "has_offer_history",
        whole("n_assessments").alias("n_assessments"),
        r6("avg_assessment_score").alias("avg_assessment"),
        whole("signals.notice_period_days").alias("notice"),
        whole(F.aggregate("education_years", F.lit(0).cast("bigint"),
                          lambda a, y: a + F.coalesce(y, F.lit(0)))).alias("study_years"),
        whole(F.size("certifications")).alias("n_certs"))


@register
def json_props_parse(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.from_json("props", "k string")
    events = read_table(spark, sf, "events").select("event_id", doc.alias("doc"))
    return events.select("event_id", integer_or_null(F.col("doc.k")).alias("k"),
                         integer(F.col("doc.k")).alias("k_or_zero"))


def _damaged(spark: SparkSession, sf: str) -> DataFrame:
    """The documents with some of them cut short, without an id, or with a bad number."""
    return _with_damage(view.as_json(view.load(spark, sf, raw=True)))


def _with_damage(lines: DataFrame) -> DataFrame:
    lines = lines.withColumn(
        "k", F.regexp_extract("value", r'"candidate_id":"[A-Z]+_([0-9]+)"', 1).cast("bigint"))
    k = F.col("k")
    value = (F.when(k % 97 == 6, F.substring("value", 1, 60))
             .when(k % 97 == 7, F.replace("value", F.lit('"candidate_id"'), F.lit('"id"')))
             .when(k % 97 == 8, F.regexp_replace("value", '"notice_period_days":[0-9]+',
                                                 '"notice_period_days":"soon"'))
             .when(k % 97 == 9, F.regexp_replace("value", '"notice_period_days":[0-9]+',
                                                 '"notice_period_days":"45"'))
             .otherwise(F.col("value")))
    return lines.select(value.alias("value"))


@register
def quarantine_counts(spark: SparkSession, sf: str) -> DataFrame:
    bad = D.quarantine(D.parse_lines(_damaged(spark, sf)))
    return bad.groupBy("reject_reason").agg(F.count("*").alias("n"))


@register
def load_stats(spark: SparkSession, sf: str) -> DataFrame:
    return D.load_stats(D.parse_lines(_damaged(spark, sf))).drop("missing_signals")


def _number(column: str = "candidate_id") -> Column:
    return F.regexp_extract(column, "([0-9]+)$", 1).cast("bigint")


@register
def mixed_layout_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of three layouts: two that are asked for, and one that is not."""
    raw = view.load(spark, sf, raw=True)
    layouts = {0: "platform_signals", 1: "other_signals"}
    parts = [view.as_json(raw.filter(_number() % 5 == r), key) for r, key in layouts.items()]
    lines = parts[0].unionByName(parts[1]).unionByName(view.as_json(
        raw.filter(_number() % 5 > 1)))
    parsed = D.parse_lines(lines, ("signals", "platform_signals"))
    return parsed.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce(integer_or_null(
            F.col("signals.connection_count")), F.lit(0))).alias("connections"))


@register
def json_array_records(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of up to 4 000 documents in two layouts, each with an element that is none."""
    orders = view.orders(spark, sf).withColumn("bucket", F.floor(F.col("o_orderkey") / 4000))
    # The narrow orders are dealt to the lists, so that no document is shuffled.
    raw = view.records(orders.repartition(parts_for(orders), "bucket"), raw=True,
                       keep=("bucket",))
    lines = raw.select("bucket", F.when(_number() % 2 == 0, view.document(raw)).otherwise(
        view.document(raw, "platform_signals")).alias("value"))
    folder = fresh_path(spark, "lists")
    (lines.groupBy("bucket").agg(F.array_join(F.collect_list("value"), ",\n").alias("l"))
     .select("bucket", F.concat(F.lit('["oops",\n'), "l", F.lit("]")).alias("value"))
     .write.partitionBy("bucket").option("compression", "gzip").text(folder))
    records = D.read_json_array(spark, folder, ("signals", "platform_signals"))
    return records.select("candidate_id", whole("signals.connection_count").alias("connections"),
                          whole(F.size("skills")).alias("n_skills"))


@register
def read_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The sampling form of the reader: which rows it takes is open, how many is not."""
    folder = fresh_path(spark, "lines")
    view.as_json(view.load(spark, sf, raw=True)).write.option("compression", "gzip").text(folder)
    some = D.read_records(spark, folder, "signals", limit=100)
    return some.agg(F.count("*").alias("n"), F.count_distinct("candidate_id").alias("n_ids"))


@register
def key_presence(spark: SparkSession, sf: str) -> DataFrame:
    presence = D.key_presence(_damaged(spark, sf),
                              ("candidate_id", "profile", "skills", "unknown_key"))
    return presence.select("field", "n_present", r6("pct_present").alias("pct_present"))


@register
def sample_limit(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy("o_orderkey").limit(100)


@register
def load_chunks(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return D.in_chunks(orders, 500, F.asc("o_orderdate"), F.asc("o_orderkey")).groupBy(
        "chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"),
                     F.max("o_orderkey").alias("last_key"))


@register
def flatten_profile(spark: SparkSession, sf: str) -> DataFrame:
    flat = N.flatten(view.load(spark, sf, raw=True))
    kinds = dict(flat.dtypes)
    as_out = lambda c: (r6(c).alias(c) if kinds[c] == "double" else
                        whole(c).alias(c) if kinds[c] in ("int", "bigint") else F.col(c))
    return flat.select(*[as_out(c) for c in flat.columns])


# --- rules --------------------------------------------------------------------------------------

def _hits(spark: SparkSession, sf: str, rule_set: str) -> DataFrame:
    hits = rules.rule_hits(derived(spark, sf), rules.RULE_SETS[rule_set]())
    return hits.select("candidate_id", "code", "severity", whole("n").alias("n"))


@register
def rules_schema(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, "schema")


@register
def rules_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, "consistency")


@register
def rules_anomaly(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, "anomaly")


@register
def rules_forensic(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, "forensic")


@register
def validation(spark: SparkSession, sf: str) -> DataFrame:
    return rules.validate(cand(spark, sf)).select(
        "candidate_id", whole(F.size("errors")).alias("n_errors"),
        whole(F.size("warnings")).alias("n_warnings"), whole("n_flags").alias("n_flags"),
        "is_valid", "is_clean", r6("trust_score").alias("trust_score"))


@register
def trust_score(spark: SparkSession, sf: str) -> DataFrame:
    return rules.with_trust(derived(spark, sf)).select(
        "candidate_id", whole("n_flags").alias("n_flags"), r6("trust_score").alias("trust_score"))


@register
def trust_bands(spark: SparkSession, sf: str) -> DataFrame:
    return P.trust_bands(rules.with_trust(derived(spark, sf)))


@register
def job_overlap_array(spark: SparkSession, sf: str) -> DataFrame:
    found = cand(spark, sf).select("candidate_id", F.explode(rules.job_overlaps(3.0)).alias("p"))
    return found.select("candidate_id", F.col("p.first").alias("first_company"),
                        F.col("p.second").alias("second_company"), r6("p.months").alias("months"))


@register
def interval_overlap_window(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer as stays of 0 to 90 days; neighbours that overlap by over 10 days."""
    stays = read_table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("begin"),
        F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 91).cast("int"))
        .alias("finish"))
    pairs = intervals.adjacent_overlaps(stays, "o_custkey", "begin", "finish", ["o_orderkey"], 10)
    return pairs.select("o_custkey", "o_orderkey", "next_o_orderkey",
                        whole("overlap").alias("overlap"))


@register
def education_overlap_window(spark: SparkSession, sf: str) -> DataFrame:
    counts = intervals.education_overlaps(P.entries(cand(spark, sf), "education"))
    return counts.filter("n_overlaps > 0")


@register
def gap_to_next(spark: SparkSession, sf: str) -> DataFrame:
    events = read_table(spark, sf, "events").select("event_id", "user_id", "ts")
    return intervals.gap_to_next(events, "user_id", "ts", ["event_id"]).select(
        "event_id", "user_id", r6("gap").alias("gap"))


# --- features -----------------------------------------------------------------------------------

DOCUMENT_WORDS = {"function": ("the", "and", "that", "with", "der", "les"),
                  "fragment": ("tion", "ing", "dl", "rag", "ment", "ent", "on the")}


@register
def keyword_evidence(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    found = docs.select("doc_id", KeywordAutomaton(DOCUMENT_WORDS).counts(
        F.lower("text")).alias("keywords"))
    return found.select("doc_id", *[
        whole(F.col(f"keywords.{g}")).alias(f"n_{g}") for g in DOCUMENT_WORDS], *[
        r6(F.log1p(F.col(f"keywords.{g}").cast("double"))).alias(f"evidence_{g}")
        for g in DOCUMENT_WORDS])


@register
def career_evidence(spark: SparkSession, sf: str) -> DataFrame:
    texts = cand(spark, sf).select("candidate_id", X.keyword_automaton().counts(N.career_text(
        F.col("profile"), F.col("career_history"))).alias("keywords"))
    return texts.select("candidate_id", *[
        r6(c).alias(n) for n, c in X.evidence_features().items()])


GROUP_WORDS = {"capability": settings.CAPABILITY_GROUPS,
               "production": settings.PRODUCTION_KEYWORDS,
               "quality": settings.QUALITY_KEYWORDS}


def _group_flags(table: DataFrame, keys: list[str]) -> DataFrame:
    words = KeywordAutomaton({f"{kind}_{name}": words for kind, groups in GROUP_WORDS.items()
                              for name, words in groups.items()})
    found = table.select(*keys, words.counts(F.lower("text")).alias("keywords"))
    return found.select(*keys, *[(F.col(f"keywords.{n}") > 0).alias(n) for n in words.groups], *[
        r6(X.category_share(kind, groups)).alias(f"{kind}_share")
        for kind, groups in GROUP_WORDS.items()])


@register
def keyword_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _group_flags(spread(read_table(spark, sf, "documents")), ["doc_id"])


@register
def keyword_groups_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return _group_flags(spread(read_table(spark, sf, "conversations")), ["conv_id", "turn"])


@register
def skill_weights(spark: SparkSession, sf: str) -> DataFrame:
    prepared = cand(spark, sf).withColumn("core_skills", X.core_skills(
        F.col("skills"), settings.Taxonomy()))
    wanted = T.literal_list(settings.PROFILE_CORE_SKILLS)
    return prepared.select("candidate_id", *[
        (r6(c) if "score" in n else whole(c)).alias(n) for n, c in X.skill_features().items()],
        whole(F.size(F.array_intersect(F.col("skills.name"), wanted))).alias("distinct_core"))


@register
def skill_taxonomy_join(spark: SparkSession, sf: str) -> DataFrame:
    """Skills against the taxonomy as a table of fixed size (56 rows), per core skill."""
    skills = P.entries(cand(spark, sf), "skills")
    taxonomy = spark.createDataFrame([(s,) for s in settings.CORE_SKILLS], "name string")
    return (skills.join(F.broadcast(taxonomy), "name").groupBy("name")
            .agg(F.count("*").alias("n"), F.sum("endorsements").alias("endorsements")))


def _assessments(spark: SparkSession, sf: str) -> DataFrame:
    return cand(spark, sf).select("candidate_id", F.explode(
        "signals.skill_assessment_scores").alias("name", "score"))


@register
def anti_membership(spark: SparkSession, sf: str) -> DataFrame:
    experts = P.entries(cand(spark, sf), "skills").filter(
        "proficiency = 'expert' and endorsements < 1")
    tested = _assessments(spark, sf).hint("merge")      # as in `lookup_default`
    return (experts.join(tested, ["candidate_id", "name"], "left_anti")
            .select("candidate_id", whole("pos").alias("pos"), "name"))


@register
def lookup_default(spark: SparkSession, sf: str) -> DataFrame:
    last = (P.entries(cand(spark, sf), "skills").groupBy("candidate_id", "name")
            .agg(F.max_by("endorsements", "pos").alias("endorsements")))
    # The size that Spark reckons for exploded entries is that of the orders: never broadcast.
    return (_assessments(spark, sf).join(last.hint("merge"), ["candidate_id", "name"], "left")
            .select("candidate_id", "name", r6("score").alias("score"),
                    F.coalesce("endorsements", F.lit(0)).cast("bigint").alias("endorsements")))


def _features(spark: SparkSession, sf: str, names: list[str]) -> DataFrame:
    table = X.features(cand(spark, sf))
    kinds = dict(table.dtypes)
    return table.select("candidate_id", *[
        (r6(n) if kinds[n] == "double" else whole(n) if kinds[n] in ("int", "bigint")
         else F.col(n)).alias(n) for n in names])


@register
def experience_features(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf, list(X.experience_features()))


@register
def education_features(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf, list(X.education_features()))


@register
def signal_features(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf, [*X.signal_features(), *X.trust_features()])


@register
def composite_features(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf, [*C.COMPOSITES, "confidence_category"])


# --- scores -------------------------------------------------------------------------------------

@register
def component_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).select("candidate_id", *[
        r6(f"{c}_score").alias(f"{c}_score") for c in C.COMPONENTS])


@register
def weighted_score(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).select("candidate_id", r6("raw_score").alias("raw_score"),
                                    r6("trust_score").alias("trust_score"),
                                    r6("final_score").alias("final_score"))


@register
def prefiltered_score(spark: SparkSession, sf: str) -> DataFrame:
    scored = C.score_records(cand(spark, sf), where="profile.years_of_experience >= 3")
    return scored.select("candidate_id", r6("final_score").alias("final_score"))


@register
def custom_job_score(spark: SparkSession, sf: str) -> DataFrame:
    job = settings.JobSpec(domains={n: n in ("search", "nlp", "ranking")
                                    for n in settings.EVIDENCE_KEYWORDS},
                           minimum_years=2.0, preferred_min_years=4.0, preferred_max_years=6.0)
    return C.score_records(cand(spark, sf), job).select(
        "candidate_id", r6("domain_score").alias("domain_score"),
        r6("experience_score").alias("experience_score"),
        r6("final_score").alias("final_score"))


@register
def alternative_scores(spark: SparkSession, sf: str) -> DataFrame:
    table = C.alternative_scores(derived(spark, sf))
    return table.select("candidate_id", *[r6(c).alias(c) for c in table.columns[1:]])


# --- ranking ------------------------------------------------------------------------------------

@register
def topk_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_ranked(scores(spark, sf)).select("candidate_id", whole("rank").alias("rank"),
                                                  "score")


@register
def topk_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return R.top_by(orders, "o_totalprice", 100, "o_orderkey").select(
        "o_orderkey", "o_totalprice", whole("rank").alias("rank"))


@register
def topk_raw(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_by(scores(spark, sf), "raw_score").select(
        "candidate_id", r6("raw_score").alias("raw_score"))


@register
def topk_final(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_by(scores(spark, sf), "final_score", 50).select(
        "candidate_id", r6("final_score").alias("final_score"))


@register
def rank_all(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return R.rank_all(orders, "o_totalprice", "o_orderkey").select(
        "o_orderkey", whole("rank").alias("rank"))


@register
def rank_all_scored(spark: SparkSession, sf: str) -> DataFrame:
    narrow = scores(spark, sf).select("candidate_id", R.round_exact(
        F.col("final_score"), 4).alias("score"))
    # The sort reads its input twice, for the bounds of its slices and for the rows.
    return R.rank_all(kept(narrow, "scores"), "score").select("candidate_id", whole("rank").alias("rank"))


@register
def reasoning(spark: SparkSession, sf: str) -> DataFrame:
    return rank_records.ranked_list(cand(spark, sf)).select(
        "candidate_id", whole("rank").alias("rank"), "score", "reasoning")


@register
def preview(spark: SparkSession, sf: str) -> DataFrame:
    return reasoning(spark, sf).filter("rank <= 25")


@register
def audit_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = explain.audit_rows(rank_records.select_top(cand(spark, sf)))
    return rows.select(
        whole("rank").alias("rank"), "candidate_id", "title", r6("score").alias("score"),
        r6("trust_score").alias("trust_score"), r6("experience").alias("experience"),
        whole("ai_skills").alias("ai_skills"), "technical_strengths", "weaknesses", "why_ranked",
        "jd_match_pct", "capability_coverage", "confidence")


@register
def component_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = explain.component_audit(audit.top_by_score(cand(spark, sf)))
    kinds = dict(rows.dtypes)
    return rows.select(*[(r6(c) if kinds[c] == "double" else whole(c) if kinds[c] in
                          ("int", "bigint") else F.col(c)).alias(c) for c in rows.columns])


@register
def example_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = explain.example_lines(rank_records.select_top(cand(spark, sf), 20))
    return lines.select(whole("rank").alias("rank"), "candidate_id", "title", "score",
                        whole("n_chars").alias("n_chars"))


@register
def reasoning_all(spark: SparkSession, sf: str) -> DataFrame:
    """Explanations of every record, not only the selected ones."""
    scored = C.score_records(cand(spark, sf), keep=explain.KEEP)
    lines = scored.select("candidate_id", explain.reasoning(explain.matched_tools())
                          .alias("reasoning"),
                          explain.strengths(explain.matched_groups()).alias("strengths"),
                          explain.weaknesses().alias("weaknesses"),
                          explain.why_ranked().alias("why_ranked"))
    return lines.withColumn("n_chars", whole(F.length("reasoning")))


@register
def archetypes(spark: SparkSession, sf: str) -> DataFrame:
    scored = C.score_records(cand(spark, sf), keep=("profile",))
    summary = P.archetype_summary(scored, explain.archetype())
    return summary.select("archetype", "n", *[r6(c).alias(c) for c in summary.columns[2:]])


@register
def archetypes_top(spark: SparkSession, sf: str) -> DataFrame:
    top = rank_records.select_top(cand(spark, sf), keep=("profile",))
    return P.archetype_summary(top, explain.archetype()).select(
        "archetype", "n")


@register
def snippets(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return spread(docs).select("doc_id", T.snippet(F.col("text"), F.lit("the")).alias("the"),
                               T.snippet(F.col("text"), F.lit("ING"), 10).alias("ing"),
                               T.truncated(F.col("text"), 200).alias("short"))


@register
def keyword_hits(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    return evidence.keyword_hits(docs, "text", DOCUMENT_WORDS, ["doc_id"], 20)


@register
def evidence_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = evidence.evidence_audit(audit.top_by_score(cand(spark, sf)))
    return rows.select("candidate_id", whole("rank").alias("rank"), "domain", "matched_keyword",
                       "source", "source_text_snippet")


@register
def deep_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = evidence.deep_audit(audit.top_by_score(cand(spark, sf)))
    return rows.select(whole("rank").alias("rank"), "candidate_id", "title", "headline",
                       "summary_text", "top_career_snippets",
                       r6("final_score").alias("final_score"))


# --- checks of an output ------------------------------------------------------------------------

def _submission(spark: SparkSession, sf: str) -> DataFrame:
    """All orders as cells of a ranked list, with planted defects."""
    k = F.col("o_orderkey")
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    ident = (F.when(k % 211 == 1, "").when(k % 211 == 2, "X1")
             .when(k % 211 == 3, view.padded_id(k + 1)).otherwise(
                 view.padded_id(k)))
    rank = (F.when(k % 223 == 4, F.concat(F.lit("0"), (k + 1).cast("string")))
            .when(k % 223 == 5, "first").when(k % 223 == 6, k.cast("string"))
            .otherwise((k + 1).cast("string")))
    score = F.when(k % 227 == 7, "high").otherwise(
        F.floor(F.col("o_totalprice") / 1000).cast("string"))
    cells = F.when(k % 229 == 8, F.array(ident, rank, score)).otherwise(
        F.array(ident, rank, score, F.lit("text")))
    return orders.select((k + 2).alias("row_num"), cells.alias("cells"))


@register
def output_checks(spark: SparkSession, sf: str) -> DataFrame:
    return checks.check_cells(_submission(spark, sf), 150).select("check", "place")


@register
def output_check_table(spark: SparkSession, sf: str) -> DataFrame:
    listed = reasoning(spark, sf)
    broken = listed.withColumns({
        "reasoning": F.when(F.col("rank") == 7, "").otherwise(F.col("reasoning")),
        "score": F.when(F.col("rank") == 3, 0.0).when(F.col("rank") == 9, None)
        .otherwise(F.col("score")),
        "candidate_id": F.when(F.col("rank") == 5, "CAND_X").when(F.col("rank") == 6, "CAND_X")
        .otherwise(F.col("candidate_id"))}).filter("rank <> 50")
    return checks.check_table(broken).select("check")


@register
def rank_sequence(spark: SparkSession, sf: str) -> DataFrame:
    taken = read_table(spark, sf, "orders").select((F.col("o_orderkey") % 89 + 1).alias("rank"))
    return checks.missing_ranks(taken, 100)


@register
def csv_file_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The planted defects again, as CSV files with quoted line breaks, commas and quotes."""
    cells = _submission(spark, sf).select("row_num", F.slice("cells", 1, 3).alias("c"))
    rows = cells.orderBy("row_num").select(
        *[F.col("c")[i].alias(n) for i, n in enumerate(settings.RANKED_COLUMNS[:3])],
        F.lit('some "text",\nin two lines').alias(settings.RANKED_COLUMNS[3]))
    folder = fresh_path(spark, "submission")
    sinks.write_table_csv(rows, folder)
    return checks.check_file(spark, folder, 150).filter("check <> 'suffix'").select(
        "check", "place")


@register
def ranked_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    folder = fresh_path(spark, "ranked")
    sinks.write_ranked_csv(rank_records.ranked_list(cand(spark, sf)), folder)
    rows = read_csv_cells(spark, folder).filter("not is_header")
    return rows.select(*[F.col("cells")[i].alias(n)
                         for i, n in enumerate(settings.RANKED_COLUMNS)])


@register
def ranked_deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    """All records twice, the second time with less trust: each id is listed once."""
    twice = scores(spark, sf).select("candidate_id", F.explode(F.array(
        F.col("final_score") * 0.5, F.col("final_score"))).alias("final_score"))
    return R.top_ranked(twice, dedupe="best").select(
        "candidate_id", whole("rank").alias("rank"), "score")


@register
def score_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    parts = scores(spark, sf).select("candidate_id", C.breakdown().alias("b"))
    return parts.select("candidate_id", *[r6(f"b.{c}_score").alias(f"{c}_score")
                                          for c in C.COMPONENTS],
                        r6("b.trust_score").alias("trust_score"))


@register
def feature_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Scores written as parquet, read back and ranked."""
    folder = fresh_path(spark, "features")
    sinks.write_features(scores(spark, sf).select("candidate_id", "final_score"), folder)
    return R.top_by(sinks.read_features(spark, folder), "final_score", 50).select(
        "candidate_id", r6("final_score").alias("final_score"))


@register
def metrics_file(spark: SparkSession, sf: str) -> DataFrame:
    """The score bands as a long table of metrics, written and read back."""
    folder = fresh_path(spark, "metrics")
    bands = P.score_bands(scores(spark, sf))
    sinks.write_metrics(bands.select(
        F.lit("score_distribution").alias("metric"), F.col("band").alias("key"),
        F.col("n").cast("double").alias("value")), folder)
    return spark.read.json(folder).select("metric", "key", whole("value").alias("value"))


# --- sensitivity --------------------------------------------------------------------------------

@register
def weight_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return R.scenario_overlaps(scores(spark, sf))


@register
def scenario_scores(spark: SparkSession, sf: str) -> DataFrame:
    table = C.scenario_scores(scores(spark, sf), settings.SCENARIOS)
    return table.select("candidate_id", "scenario", r6("score").alias("score"))


@register
def ablation(spark: SparkSession, sf: str) -> DataFrame:
    return R.ablation(scores(spark, sf))


@register
def trust_fell_out(spark: SparkSession, sf: str) -> DataFrame:
    return R.fell_out(scores(spark, sf)).select(
        "candidate_id", r6("raw_score").alias("raw_score"),
        r6("final_score").alias("final_score"), whole("rank").alias("rank"))


@register
def ndcg_at_k(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    labels = read_table(spark, sf, "labels").select("doc_id", "quality")
    both = docs.join(labels, "doc_id")
    return R.ndcg_at_k(both, "source", [F.desc("n_chars"), F.asc("doc_id")], "quality", 10) \
        .select("source", r6("dcg").alias("dcg"), r6("ndcg").alias("ndcg"))


# --- profile ------------------------------------------------------------------------------------

@register
def missing_values(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "source")
    both = docs.join(read_table(spark, sf, "labels"), "doc_id", "left")
    table = P.missing_values(both)
    return table.select("field", "n_missing", r6("pct_missing").alias("pct_missing"))


@register
def missing_profile(spark: SparkSession, sf: str) -> DataFrame:
    table = P.missing_values(N.flatten(view.load(spark, sf, raw=True)))
    return table.select("field", "n_missing", r6("pct_missing").alias("pct_missing"))


@register
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return P.duplicate_keys(read_table(spark, sf, "documents"), "text").agg(
        F.count("*").alias("n_keys"), F.sum("n").alias("n_rows"))


@register
def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return P.near_duplicates(read_table(spark, sf, "part"), ["p_brand", "p_type", "p_size"])


@register
def id_gaps(spark: SparkSession, sf: str) -> DataFrame:
    ids = read_table(spark, sf, "orders").filter("o_orderkey % 13 <> 4").select(
        view.padded_id(F.col("o_orderkey")).alias("id"))
    return P.id_sequence(ids, "id")


@register
def malformed_ids(spark: SparkSession, sf: str) -> DataFrame:
    return P.malformed_ids(cand(spark, sf), "candidate_id", settings.ID_PATTERN)


@register
def value_counts_topn(spark: SparkSession, sf: str) -> DataFrame:
    return P.top_values(P.entries(cand(spark, sf), "skills"), "name", 20)


@register
def value_counts_share(spark: SparkSession, sf: str) -> DataFrame:
    table = P.value_counts(read_table(spark, sf, "orders"), "o_orderpriority")
    return table.select("value", "n", r6("share").alias("share"))


@register
def value_counts_domain(spark: SparkSession, sf: str) -> DataFrame:
    table = P.domain_counts(read_table(spark, sf, "customer"), "c_mktsegment",
                            ["BUILDING", "MACHINERY", "NOWHERE", "AUTOMOBILE"])
    return table.select("value", "n")


@register
def skill_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return P.skill_frequency(cand(spark, sf), settings.PROFILE_CORE_SKILLS, 25)


@register
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    table = P.histogram(read_table(spark, sf, "lineitem"), "l_quantity", 20)
    return table.select(whole("bin").alias("bin"), r6("low").alias("low"), "n")


@register
def flag_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return P.flag_histogram(rules.with_trust(derived(spark, sf)))


@register
def describe(spark: SparkSession, sf: str) -> DataFrame:
    table = P.describe(read_table(spark, sf, "lineitem"),
                       ["l_quantity", "l_extendedprice", "l_discount"])
    return table.select("field", "count", *[r6(c).alias(c) for c in table.columns[2:]])


@register
def median_p99(spark: SparkSession, sf: str) -> DataFrame:
    table = P.quantiles(read_table(spark, sf, "events"), ["value"], [0.5, 0.99])
    return table.select("field", r6("probability").alias("probability"),
                        r6("value").alias("value"))


@register
def rates(spark: SparkSession, sf: str) -> DataFrame:
    names = ("open_to_work_flag", "willing_to_relocate", "verified_email", "verified_phone",
             "linkedin_connected")
    conditions = {n: F.col(f"signals.{n}") for n in names}
    conditions["no_github"] = F.col("signals.github_activity_score") == -1
    table = P.rates(cand(spark, sf), conditions)
    return table.select(*[r6(c).alias(c) for c in table.columns])


@register
def cond_mean(spark: SparkSession, sf: str) -> DataFrame:
    flat = N.flatten(view.load(spark, sf, raw=True))
    table = P.conditional_means(flat, ["offer_acceptance_rate", "github_activity_score"])
    return table.select(*[(r6(c) if c.startswith("mean") else F.col(c)).alias(c)
                          for c in table.columns])


@register
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return P.distinct_counts(read_table(spark, sf, "orders"),
                             ["o_custkey", "o_orderpriority", "o_orderdate"])


@register
def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    items = read_table(spark, sf, "lineitem").select(
        *[F.when(F.col("l_partkey") % 7 == 0, -1.0).otherwise(F.col(c)).alias(c)
          if c == "l_discount" else F.col(c) for c in columns])
    table = P.correlation(items, columns)
    return table.select("field_a", "field_b", r6("corr").alias("corr"))


@register
def corr_same_for_any_width(spark: SparkSession, sf: str) -> DataFrame:
    """One pair among 2 and among 14 columns.  The rows of the pair lie far from the mean that x
    has over all rows."""
    near = F.col("l_linenumber") == 1
    x = F.when(near, F.col("l_quantity").cast("double")).otherwise(
        F.lit(1e9) + F.col("l_extendedprice"))
    items = read_table(spark, sf, "lineitem").select(
        x.alias("x"), F.when(near, F.col("l_quantity") * 2.0 + F.col("l_discount")).alias("y"),
        *[(F.col("l_tax") + F.lit(float(i)) * F.col("l_discount")).alias(f"z{i}")
          for i in range(12)])
    pair = lambda columns: P.correlation(items, columns, None, "lower").filter(
        "field_a = 'y' and field_b = 'x'")
    return pair(["x", "y"]).withColumn("width", F.lit(2)).unionByName(
        pair(items.columns).withColumn("width", F.lit(14))).select(
        whole("width").alias("width"), r6("corr").alias("corr"))


def _with_nan(spark: SparkSession, sf: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 7 == 3, F.lit(float("nan"))).when(
        F.col("o_orderkey") % 11 != 5, F.col("o_totalprice").cast("double"))
    return read_table(spark, sf, "orders").select(price.alias("price"))


@register
def describe_nan(spark: SparkSession, sf: str) -> DataFrame:
    table = P.describe(_with_nan(spark, sf), ["price"])
    return table.select("field", "count", *[r6(c).alias(c) for c in table.columns[2:]])


@register
def histogram_nan(spark: SparkSession, sf: str) -> DataFrame:
    table = P.histogram(_with_nan(spark, sf), "price", 15)
    return table.select(whole("bin").alias("bin"), r6("low").alias("low"), "n")


@register
def corr_profile(spark: SparkSession, sf: str) -> DataFrame:
    """All 378 pairs of the 28 profile columns, each pair once."""
    table = P.correlation(N.flatten(view.load(spark, sf, raw=True)), list(P.CORRELATED),
                          part="lower")
    return table.select("field_a", "field_b", r6("corr").alias("corr"))


@register
def score_bands(spark: SparkSession, sf: str) -> DataFrame:
    return P.score_bands(scores(spark, sf))


@register
def cohort_summary(spark: SparkSession, sf: str) -> DataFrame:
    table = P.cohort_summary(R.top_ranked(scores(spark, sf)))
    return table.select("n", *[r6(c).alias(c) for c in table.columns[1:]])


@register
def selected_lists(spark: SparkSession, sf: str) -> DataFrame:
    lists = P.selected_lists(R.top_ranked(scores(spark, sf)))
    return lists.select(F.array_join(F.col("ai_skill_counts").cast("array<string>"), ",")
                        .alias("ai_skill_counts"), F.size("experience").cast("bigint").alias("n"))


@register
def top_titles(spark: SparkSession, sf: str) -> DataFrame:
    top = rank_records.select_top(cand(spark, sf), keep=("profile",))
    return P.top_values(top.select(F.col("profile.current_title").alias("title")), "title", 10)


@register
def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    table = P.dashboard(N.flatten(view.load(spark, sf, raw=True)))
    kinds = dict(table.dtypes)
    return table.select(*[(r6(c) if kinds[c] == "double" else whole(c)).alias(c)
                          for c in table.columns])


@register
def outlier_counts(spark: SparkSession, sf: str) -> DataFrame:
    return P.outliers(N.flatten(view.load(spark, sf, raw=True)))


@register
def job_summary(spark: SparkSession, sf: str) -> DataFrame:
    return P.job_summary(P.entries(cand(spark, sf), "career_history"))


@register
def education_summary(spark: SparkSession, sf: str) -> DataFrame:
    return P.education_summary(P.entries(cand(spark, sf), "education"))


@register
def education_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return P.domain_counts(P.entries(cand(spark, sf), "education"), "tier",
                           settings.EDUCATION_TIERS).select("value", "n")


@register
def flag_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return P.flag_breakdown(rules.rule_hits(derived(spark, sf), rules.forensic_rules()))


@register
def flag_totals(spark: SparkSession, sf: str) -> DataFrame:
    table = P.flag_totals(rules.with_trust(derived(spark, sf)))
    return table.select("n_records", "n_flagged", "n_flags",
                        r6("flagged_share").alias("flagged_share"),
                        r6("flags_per_flagged").alias("flags_per_flagged"))


@register
def worst_k(spark: SparkSession, sf: str) -> DataFrame:
    counted = rules.with_trust(derived(spark, sf)).select("candidate_id",
                                                          whole("n_flags").alias("n_flags"))
    return P.worst_records(counted, 10)


# --- joins --------------------------------------------------------------------------------------

@register
def scenario_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    best = R.top_by(customers, "c_acctbal", 50, "c_custkey").withColumnRenamed(
        "c_custkey", "o_custkey")
    picked = R.matching(orders, best, "o_custkey")
    return picked.join(F.broadcast(best.select("o_custkey", "c_name")), "o_custkey")


@register
def first_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """One row per repeated id: the first order of each customer."""
    orders = read_table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return R.deduplicated(orders, "o_custkey", "first",
                          [F.asc("o_orderdate"), F.asc("o_orderkey")]).select(
        "o_custkey", "o_orderkey")


@register
def running_total(spark: SparkSession, sf: str) -> DataFrame:
    parts = read_table(spark, sf, "part").select("p_partkey", whole("p_size").alias("p_size"))
    return ordered.running_total(parts, "p_size", F.asc("p_partkey"), name="before").select(
        "p_partkey", whole("before").alias("before"))


# --- streams ------------------------------------------------------------------------------------

def _order_stream(spark: SparkSession, sf: str, parts: int = 5) -> DataFrame:
    """All orders as files that arrive one after another, in `parts` micro-batches.  A file is one
    task of its batch, so a batch is many files."""
    folder = fresh_path(spark, "arriving")
    orders = view.orders(spark, sf)
    files = parts_for(orders)
    orders.repartition(parts * files, "o_orderkey").write.parquet(folder)
    return view.records(_arriving(spark, folder, orders, files))


def _arriving(spark: SparkSession, folder: str, like: DataFrame, files: int) -> DataFrame:
    return (spark.readStream.schema(like.schema).format("parquet")
            .option("maxFilesPerTrigger", files).load(folder))


@register
def stream_score(spark: SparkSession, sf: str) -> DataFrame:
    target = fresh_path(spark, "stream-score")
    stream.score_stream(_order_stream(spark, sf), f"{target}/out",
                        f"{target}/state").awaitTermination()
    table = spark.read.parquet(f"{target}/out")
    return table.select("candidate_id", *[r6(c).alias(c) for c in stream.SCORE_COLUMNS[1:]])


@register
def stream_topk(spark: SparkSession, sf: str) -> DataFrame:
    target = fresh_path(spark, "stream-topk")
    stream.topk_stream(_order_stream(spark, sf), f"{target}/scores",
                       f"{target}/state").awaitTermination()
    top = stream.current_topk(spark, f"{target}/scores")
    return top.select("candidate_id", r6("final_score").alias("final_score"))


@register
def stream_topk_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth record arrives a second time, without a flag to be open to work; some fall
    out of the list, others move up."""
    target = fresh_path(spark, "stream-updates")
    folder = fresh_path(spark, "arriving")
    orders = view.orders(spark, sf).withColumn("again", F.lit(False))
    files = parts_for(orders)

    def arriving() -> DataFrame:
        records = view.records(_arriving(spark, folder, orders, files), keep=("again",))
        signals = lambda name, value: F.when(F.col("again"), F.lit(value)).otherwise(
            F.col("signals")[name])
        return records.withColumn("signals", F.col("signals").withField(
            "open_to_work_flag", signals("open_to_work_flag", False)).withField(
            "recruiter_response_rate", signals("recruiter_response_rate", 0.0))).drop("again")

    orders.repartition(4 * files, "o_orderkey").write.parquet(folder)
    stream.topk_stream(arriving(), f"{target}/scores", f"{target}/state").awaitTermination()
    (orders.filter("o_orderkey % 10 = 3").withColumn("again", F.lit(True))
     .repartition(files, "o_orderkey").write.mode("append").parquet(folder))
    stream.topk_stream(arriving(), f"{target}/scores", f"{target}/state").awaitTermination()
    top = stream.current_topk(spark, f"{target}/scores")
    return top.select("candidate_id", r6("final_score").alias("final_score"))


@register
def stream_quality(spark: SparkSession, sf: str) -> DataFrame:
    target = fresh_path(spark, "stream-quality")
    stream.quality_stream(_order_stream(spark, sf), f"{target}/counts",
                          f"{target}/state").awaitTermination()
    return stream.last_counts(spark, f"{target}/counts")


@register
def stream_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Running totals of the damaged documents, in five micro-batches."""
    target = fresh_path(spark, "stream-arrivals")
    folder = fresh_path(spark, "arriving")
    # The narrow orders are dealt to the files, not the documents.
    orders = view.orders(spark, sf)
    files = 5 * parts_for(orders)
    _with_damage(view.as_json(view.records(orders.repartition(files, "o_orderkey"), raw=True))) \
        .write.option("compression", "gzip").text(folder)
    lines = D.read_line_stream(spark, folder, files_per_batch=files // 5)
    stream.arrival_stream(D.parse_lines(lines), f"{target}/counts",
                          f"{target}/state").awaitTermination()
    return stream.last_counts(spark, f"{target}/counts")
