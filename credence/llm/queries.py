"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from credence.llm import (chat, decontaminate, html_text, licenses, packing, pii, quality,
                          sharding, simhash, toxicity, variants, warc, whitening)
from credence.session import fresh_path
from credence.sources.tables import read_table


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_duplicates(read_table(spark, folder, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                         "component_id", "n_rows")


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(read_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_removed_words", "base_failed", "kept")


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(
        read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"),
        carry=["doc_id"]).select(
        "row.doc_id", "n_words", "n_hit", "n_items", "items_sha256",
        (F.size("spans") > 0).alias("contaminated"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as files of a tree: source/language/thousands/tens/name.

    The first document of each ten is the licence file of its directory, the first of each
    thousand that of the directory above.
    """
    n = F.coalesce("doc_id", F.lit(0))
    upper = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("xx")),
                        F.concat(F.lit("d"), F.floor(n / 1000).cast("string")))
    lower = F.concat(upper, F.lit("/e"), F.floor(n / 10).cast("string"))
    name = F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))
    return read_table(spark, folder, "documents").select(
        F.when(n % 1000 == 0, F.concat_ws("/", upper, name)).when(
            n % 10 == 0, F.concat_ws("/", lower, name)).otherwise(F.concat_ws(
                "/", lower, F.concat(F.lit("f"), F.col("doc_id").cast("string")))).alias("path"),
        "text")


def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_files(spark, folder)).withColumn(
        "own_score", F.round("own_score", 4))


def op5_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(read_table(spark, folder, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(read_table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, folder, "documents"),
                          public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         "offset")


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    warc.write_archives(warc.resolved(read_table(spark, folder, "pages")), path)
    return warc.listing(warc.read_archives(spark, path))


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    found = pii.personal_data(documents, pii.train(documents), carry=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "row.doc_id",
        *[pii.counted(base, kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"))


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.rendered(read_table(spark, folder, "conversations")).withColumn(
        "mask", chat.listed(F.col("mask")))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read_table(spark, folder, "embeddings"))


def op12_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variants(read_table(spark, folder, "documents"))


def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, folder, "documents"),
                             read_table(spark, folder, "labels")).select(
        "doc_id", "held_out", "score", "predicted",
        F.concat_ws(",", F.col("neighbours").cast("array<string>")).alias("evidence"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_decontaminate": op3_decontaminate,
    "op4_licenses": op4_licenses,
    "op5_html": op5_html,
    "op6_sharding": op6_sharding,
    "op7_packing": op7_packing,
    "op8_warc": op8_warc,
    "op9_pii": op9_pii,
    "op10_chat": op10_chat,
    "op11_whitening": op11_whitening,
    "op12_variants": op12_variants,
    "op13_toxicity": op13_toxicity,
}
