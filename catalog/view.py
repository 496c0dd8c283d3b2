"""Typed records derived from the `orders` table, one per order.

Each record follows from the numbers of its own order by integer arithmetic, so building it is
one projection: no shuffle, no grouping, no limit, and as many records as orders.  Every rule
and feature occurs in some of them.  `catalog.oracle` states the same records in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from credence.schema import PROFILE_TEXT, RECORD_DDL
from credence.sources.tables import read_table, spread

TITLES = ("Search Engineer", "Recommendation Systems Engineer", "NLP Engineer",
          "Research Scientist", "Computer Vision Engineer", "Applied ML Engineer",
          "Data Engineer", "Backend Engineer", "ML Engineer", "Senior Retrieval Engineer",
          "Product Manager", "CV Lead")
SKILLS = ("Python", "NLP", "RAG", "FAISS", "PyTorch", "LoRA", "Elasticsearch", "BM25",
          "MLOps", "Learning to Rank", "Milvus", "Pinecone", "Statistics", "LangChain",
          "FastAPI", "Hybrid Search", "SQL", "Excel", "Java", "Docker", "Communication",
          "Photoshop", "PEFT", "XGBoost Ranker")
PHRASES = ("built semantic search over embeddings", "ranking with learning to rank and NDCG",
           "recommendation engine with collaborative filtering", "Elasticsearch and Solr tuning",
           "relevance and query understanding", "personalized feeds from user behavior",
           "offline evaluation and A/B testing", "deep learning and machine learning models",
           "NLP and large language model services", "production serving at scale",
           "owned end-to-end deployment on Kubernetes", "mentored a staff of analysts",
           "reduced latency and increased throughput", "monitoring of data drift with MLflow",
           "hybrid retrieval with BM25 and dense retrieval", "RAG with LangChain",
           "sales reports in spreadsheets", "customer support", "vector search on FAISS",
           "architected distributed sharding for millions of users",
           "quantization with ONNX and TensorRT", "budget planning", "html pages and storage",
           "reranking with sentence transformers")
SIZES = ("1-10", "11-50", "51-200", "201-500", "501-1000", "1001-5000", "5001-10000", "10001+",
         "unknown")
TIERS = ("tier_1", "tier_2", "tier_3", "tier_4", "unknown", "tier_9")
DEGREES = ("B.Tech", "M.Tech", "BSc", "PhD")
FIELDS = ("Computer Science", "Machine Learning", "Economics", "Data Science", "History")
COUNTRIES = ("India", "Germany", "Brazil", "Japan", "Kenya", "Canada", "Poland")
LEVELS = ("beginner", "intermediate", "advanced", "expert")
MODES = ("remote", "hybrid", "onsite", "flexible")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    choices = F.split(F.lit("|".join(values)), "[|]")     # folded to one literal by Spark
    return F.element_at(choices, (index % len(values) + 1).cast("int"))


def _upto(n: Column, most: int) -> Column:
    """0, 1, ... n-1 as bigint."""
    return F.slice(F.expr(f"sequence(0L, {most - 1}L)"), F.lit(1), n.cast("int"))


def padded_id(k: Column, prefix: str = "CAND_") -> Column:
    """At least seven digits; longer keys stay whole."""
    digits = k.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) < 7, F.lpad(digits, 7, "0"))
                    .otherwise(digits))


def array_builders() -> dict[str, Callable[..., Column]]:
    """Functions of the entries' number and the columns they follow from to an array column.

    The entries of a batch are made at once: as lambdas of `transform` Spark would interpret their
    expressions entry by entry, which took most of the time a record takes.  Everything is local,
    so that a worker needs no module of the catalog.
    """
    kinds = {f.name: f.dataType for f in T.StructType.fromDDL(RECORD_DDL).fields}
    texts = {"titles": TITLES, "fields": FIELDS, "sizes": SIZES, "phrases": PHRASES,
             "skills": SKILLS, "levels": LEVELS, "degrees": DEGREES, "tiers": TIERS,
             "companies": tuple(f"Co{i}" for i in range(63)),
             "schools": tuple(f"Univ{i}" for i in range(37))}

    def numbers(values: pa.Array, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The column for each entry, 0 where it is null, and where it is null."""
        missing = np.asarray(values.is_null())[parent]
        return np.asarray(values.fill_null(0), np.int64)[parent], missing

    def spread_out(n: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Row and position of each entry, and the offsets of the lists; no number, no list."""
        sizes = np.asarray(n.fill_null(0), np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        parent = np.repeat(np.arange(len(sizes)), sizes)
        return (parent, np.arange(offsets[-1]) - offsets[parent],
                pa.array(offsets, pa.int32(), mask=np.append(np.asarray(n.is_null()), False)))

    def pick(name: str, index: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
        return pa.array(texts[name]).take(pa.array(index % len(texts[name]), mask=missing))

    def lists(offsets: pa.Array, **columns: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
            list(columns.values()), list(columns)))

    @F.arrow_udf(kinds["career_history"])
    def jobs(n: pa.Array, k: pa.Array, c: pa.Array, day: pa.Array) -> pa.Array:
        parent, i, offsets = spread_out(n)
        last = np.asarray(n.fill_null(0), np.int64)[parent] - 1
        (k, _), (c, no_c) = numbers(k, parent), numbers(c, parent)
        day, no_day = numbers(day.cast(pa.int32()), parent)
        current = ((i == last) & (k % 3 != 0)) | ((k % 43 == 11) & (i == 0))
        start = day + i * 400 - 1600 - k % 50
        date = lambda d, missing: pa.array(d.astype(np.int32), pa.int32(), mask=missing).cast(
            pa.date32()).cast(pa.string())
        return lists(
            offsets, company=pick("companies", c + i, no_c), title=pick("titles", k + i),
            start_date=date(start, no_day),
            end_date=date(start + (k + i * 3) % 24 * 30, no_day | current),
            duration_months=pa.array(np.where((k % 71 == 3) & (i == 0), -1,
                                              3 + (k + i * 5) % 40)),
            is_current=pa.array(current), industry=pick("fields", c + i, no_c),
            company_size=pick("sizes", k + i * 2),
            description=pc.binary_join_element_wise(
                pc.binary_join_element_wise(pick("phrases", k + i),
                                            pick("phrases", k * 5 + i * 7 + 7), " and "),
                pick("phrases", c + i * 11, no_c), ", later "))

    @F.arrow_udf(kinds["skills"])
    def skills(n: pa.Array, k: pa.Array, c: pa.Array) -> pa.Array:
        parent, j, offsets = spread_out(n)
        (k, _), (c, no_c) = numbers(k, parent), numbers(c, parent)
        unnamed, first = (k % 89 == 4) & (j == 0), (k % 83 == 1) & (j == 0)
        slot = np.where(k % 17 == 0, j // 2, j)
        return lists(
            offsets, name=pc.if_else(unnamed, "", pick("skills", k * 3 + c + slot * 5, no_c)),
            proficiency=pc.if_else(k % 103 == 6, "guru", pick("levels", k + j)),
            endorsements=pa.array(np.where(first, -1, (c + j * 7) % 60), mask=no_c & ~first),
            duration_months=pa.array((k + j * 11) % 60 + np.where((k + j) % 29 == 0, 100, 0)))

    @F.arrow_udf(kinds["education"])
    def education(n: pa.Array, k: pa.Array) -> pa.Array:
        parent, j, offsets = spread_out(n)
        k, _ = numbers(k, parent)
        begin = 1995 + k % 20 + j * np.where(k % 4 == 2, 3, 5)
        return lists(
            offsets, institution=pick("schools", k + j), degree=pick("degrees", k + j),
            field_of_study=pick("fields", k + j * 2),
            start_year=pa.array(begin, mask=(k % 61 == 5) & (j == 0)),
            end_year=pa.array(begin + 4 - np.where(k % 41 == 0, 5, 0)
                              + np.where(k % 37 == 0, 10, 0)),
            grade=pa.nulls(len(j), pa.string()), tier=pick("tiers", k + j))

    return {"career_history": jobs, "skills": skills, "education": education}


def records(orders: DataFrame, raw: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed records.  `raw` keeps a notice period of 0, as before the contract's defaults; `keep`
    names columns of the orders that ride along."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    day = F.col("o_orderdate").cast("date")
    n_skills = F.when(k % 101 > 95, 2).otherwise(3 + c % 10)
    first_slot_name = _pick(SKILLS, k * 3 + c)
    entries = array_builders()
    jobs = entries["career_history"](F.when(k % 59 == 7, 0).otherwise(1 + k % 4), k, c, day)
    months = lambda a: F.aggregate(a, F.lit(0).cast("bigint"),
                                   lambda t, e: t + e["duration_months"])
    signup = F.date_add(F.lit("2024-01-01").cast("date"), (k % 400).cast("int"))
    active = (F.when(k % 67 == 3, F.lit("2026-07-01").cast("date"))
              .when(k % 13 == 0, F.date_add(signup, -10))
              .otherwise(F.date_add(signup, (k % 500).cast("int"))))
    low = F.when(k % 19 != 0, (10 + k % 30).cast("double"))
    first_skill = F.when(k % 89 == 4, F.lit("")).otherwise(first_slot_name)
    score_of = lambda name, value: F.create_map(name, value.cast("double"))
    scores = (F.when((k % 8 == 0) & (first_skill != "SQL"), F.map_concat(
                score_of(first_skill, 50 + k % 51), score_of(F.lit("SQL"), 60 + k % 41)))
              .when(k % 4 == 0, score_of(first_skill, 50 + k % 51))
              .otherwise(F.expr("cast(map() as map<string, double>)")))
    notice = (k % 14) * 15
    open_to_work = k % 3 == 1

    staged = orders.select("o_orderkey", "o_custkey", "o_totalprice", jobs.alias("jobs"),
                           F.col("o_orderdate"), *keep)
    current = F.get(F.filter("jobs", lambda j: j["is_current"]), F.lit(0))
    title = F.when((k % 11 == 0) | current.isNull(), _pick(TITLES, k)).otherwise(current["title"])
    profile = {
        "anonymized_name": F.concat(F.lit("P"), k.cast("string")),
        "headline": F.concat(title, F.lit(" - "), _pick(PHRASES, c)),
        "summary": F.concat_ws(". ", *[_pick(PHRASES, c * s + k + s) for s in (1, 3, 5, 7)]),
        "location": F.when(k % 53 == 0, "").otherwise(_pick(COUNTRIES, c + 3)),
        "country": _pick(COUNTRIES, c),
        "years_of_experience": (F.floor(months(F.col("jobs")) * 10 / 12) / 10.0
                                + F.when(k % 23 == 0, 5.0).otherwise(0.0)
                                + F.when(k % 997 == 8, 60.0).otherwise(0.0)),
        "current_title": F.when(k % 79 == 2, "").otherwise(title),
        "current_company": F.concat(F.lit("Co"), (c % 63).cast("string")),
        "current_company_size": _pick(SIZES, k), "current_industry": _pick(FIELDS, c),
    }
    order = ("anonymized_name", "headline", "summary", "location", "country",
             "years_of_experience", "current_title", "current_company", "current_company_size",
             "current_industry")
    assert set(order) == {*PROFILE_TEXT, "years_of_experience"}
    price = F.floor(F.col("o_totalprice")).cast("bigint")
    signals = {
        "profile_completeness_score": (k % 101 + F.when(k % 409 == 6, 50).otherwise(0))
        .cast("double"),
        "signup_date": signup.cast("string"), "last_active_date": active.cast("string"),
        "open_to_work_flag": open_to_work,
        "profile_views_received_30d": F.when(k % 31 == 0, 0).otherwise(k % 50),
        "applications_submitted_30d": k % 17,
        "recruiter_response_rate": (k % 101) / 100.0
        + F.when(k % 401 == 3, 1.0).otherwise(0.0),
        "avg_response_time_hours": (price % 600).cast("double"),
        "skill_assessment_scores": scores,
        "connection_count": price % 1200, "endorsements_received": k % 500,
        "notice_period_days": notice if raw else F.when(notice == 0, 60).otherwise(notice),
        "expected_salary": F.struct(low.alias("min_lpa"), F.when(k % 5 == 0, low - 5)
                                    .otherwise(low + 15).alias("max_lpa")),
        "preferred_work_mode": F.when(k % 73 == 9, "mars").otherwise(_pick(MODES, k)),
        "willing_to_relocate": k % 4 == 1,
        "github_activity_score": F.when(k % 3 != 0, -1.0).otherwise((k % 101).cast("double")),
        "search_appearance_30d": F.when(k % 31 == 0, 0).otherwise(k % 120),
        "saved_by_recruiters_30d": F.when(k % 31 == 0, 0).otherwise(k % 9),
        "interview_completion_rate": (k * 7 % 101) / 100.0,
        "offer_acceptance_rate": F.when(k % 3 == 0, -1.0).otherwise((k % 11) / 10.0),
        "verified_email": k % 5 < 4, "verified_phone": k % 5 < 3, "linkedin_connected": k % 3 == 2,
    }
    whole = lambda n, v: v.cast("bigint") if n in _WHOLE else v
    empty = lambda ddl: F.from_json(F.lit("[]"), ddl)
    return staged.select(
        F.when(k % 97 == 5, F.concat(F.lit("BAD_"), k.cast("string")))
        .otherwise(padded_id(k)).alias("candidate_id"),
        F.struct(*[profile[n].alias(n) for n in order]).alias("profile"),
        F.col("jobs").alias("career_history"),
        entries["education"](k % 3, k).alias("education"),
        entries["skills"](n_skills, k, c).alias("skills"),
        F.transform(_upto(k % 2, 1), lambda j: F.struct(
            F.lit("Cloud").alias("name"), F.lit("Org").alias("issuer"),
            (2015 + k % 8).alias("year"))).alias("certifications"),
        empty("array<struct<language: string, proficiency: string>>").alias("languages"),
        F.struct(*[whole(n, v).alias(n) for n, v in signals.items()]).alias("signals"), *keep)


_WHOLE = {"profile_views_received_30d", "applications_submitted_30d", "connection_count",
          "endorsements_received", "notice_period_days", "search_appearance_30d",
          "saved_by_recruiters_30d"}


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `records` needs of the orders."""
    return read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey",
                                                      "o_totalprice", "o_orderdate")


def load(spark: SparkSession, sf_dir: str, raw: bool = False) -> DataFrame:
    return records(spread(orders(spark, sf_dir)), raw)


def as_json(typed: DataFrame, signals_key: str = "signals") -> DataFrame:
    """Records as JSON documents in the input layout: one `value` per record."""
    return typed.select(document(typed, signals_key).alias("value"))


def document(typed: DataFrame, signals_key: str = "signals") -> Column:
    salary = F.struct(F.col("signals.expected_salary.min_lpa").alias("min"),
                      F.col("signals.expected_salary.max_lpa").alias("max"))
    names = [f for f in typed.schema["signals"].dataType.fieldNames() if f != "expected_salary"]
    return F.to_json(F.struct(
        "candidate_id", "profile", "career_history", "education", "skills", "certifications",
        "languages",
        F.struct(*[F.col(f"signals.{n}") for n in names],
                 salary.alias("expected_salary_range_inr_lpa")).alias(signals_key)))
