"""Web archives with revisit records for payloads that were seen before.

Headers are shuffled by payload digest; of the records with one payload that with the smallest id
is the response, and the others become revisits of it.  The rows with the payloads are joined
with the digests that occur twice, so a payload held by a third of all records is counted before
the shuffle and its rows are split over tasks by adaptive execution, or not shuffled at all.

Archives are written with Spark's text sink: the line separator is the CR LF CR LF that ends a
record, and every header has the length of its block.  So they can lie in any store that Spark
writes to, and lost tasks leave no half archive.  They are read by the stated lengths.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from credence.llm.common import column, join_checked, stored

_END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + _END
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIELDS = T.StructType([
    T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()),
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload", T.StringType())])


def base32_digest(payload: Column) -> Column:
    """SHA-1 in upper-case base32, as archives state it: five hex digits give four letters."""
    digest, letters = F.sha1(payload.cast("binary")), []
    for at in range(0, 40, 5):
        bits = F.conv(F.substring(digest, at + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1,
                                F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _record_id(*parts: Column) -> Column:
    """A name that follows from the record, so a repeated task writes the same."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[
        F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
        F.lit(">"))


def resolved(pages: DataFrame, id_column: str = "page_id", url_column: str = "url",
             payload_column: str = "html") -> DataFrame:
    """The records with payload, digest, record_type, and for revisits the id of the response.

    A null payload is empty.  A null id never is the smallest unless all are null; then each
    record is a response.  Rows that repeat the smallest id are each a response.
    """
    payload = F.coalesce(column(payload_column).cast("string"), F.lit(""))
    rows = pages.select(column(id_column).cast("bigint").alias("page_id"),
                        column(url_column).cast("string").alias("url"), payload.alias("payload"))
    headers = rows.select("page_id", "url", base32_digest(F.col("payload")).alias("digest"))
    again = stored(headers.groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.min_by("url", "page_id").alias("first_url"),
        F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    digested = rows.withColumn("digest", base32_digest(F.col("payload")))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return join_checked(digested, again, ["digest"]).select(
        "page_id", "url", "payload", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("first_id"),
        F.when(revisit, F.col("first_url")).alias("first_url"))


def write_archives(records: DataFrame, path: str, date: str | None = None,
                   records_per_file: int = 2000) -> None:
    """Write the output of `resolved` with fresh headers, one record per row."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col("record_type") == "revisit"
    safe = lambda c: F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")),
                               F.lit("\n"), F.lit("%0A"))
    field = lambda name, value: F.concat(F.lit(name + ": "), value)
    block = F.when(revisit, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), "payload"))
    header = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), F.col("digest"))),
        F.lit("WARC-Date: " + date), field("WARC-Target-URI", safe(F.col("url"))),
        field("X-Page-ID", F.col("page_id").cast("string")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.lit("WARC-Profile: " + _PROFILE)),
        F.when(revisit, field("WARC-Refers-To", _record_id(
            F.col("first_id"), F.col("first_url"), F.col("digest")))),
        F.when(revisit, field("WARC-Refers-To-Target-URI", safe(F.col("first_url")))),
        F.when(revisit, F.lit("WARC-Refers-To-Date: " + date)),
        F.lit("Content-Type: application/http; msgtype=response"),
        field("Content-Length", F.octet_length(block).cast("string")))
    (records.select(F.concat(header, F.lit(_END), block).alias("value")).write
     .option("lineSep", _END).option("maxRecordsPerFile", records_per_file).text(path))


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record of an archive."""
    at, view = 0, memoryview(content)
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        first, *lines = content[at:end].decode(errors="replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in
                  (line.partition(":") for line in lines)}
        begin = end + 4
        at = begin + int(fields["content-length"])
        yield fields, bytes(view[begin:at])
        if content[at:at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record before byte {at} does not end there")
        at += 4


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records of the archives below `path`; payload digests of responses are checked.

    Columns: record_type, record_id, page_id, url, digest, payload_bytes (null for revisits),
    payload (null without `with_payload`).
    """
    schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()),
                        ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):      # one archive at a time
                out = [_record(f, block, with_payload) for f, block in
                       parse(part.column(0)[i].as_py())]
                columns = list(zip(*out)) if out else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
            .select("content").mapInArrow(run, _FIELDS))


def _record(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    payload = None
    if fields["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest and digest != found:
            raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
        digest = found
    page = fields.get("x-page-id")
    return (fields["warc-type"], fields["warc-record-id"], None if page is None else int(page),
            fields.get("warc-target-uri"), digest, None if payload is None else len(payload),
            payload.decode(errors="replace") if with_payload and payload is not None else None)


def originals(records: DataFrame) -> DataFrame:
    """Of each payload digest the response with the smallest id: digest, first_id, bytes."""
    return records.where("record_type = 'response'").groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.max("payload_bytes").alias("bytes"))


def listing(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the read records.

    Revisits have the bytes of the response they are joined to by digest; one whose response is
    in no archive has null there.
    """
    narrow = stored(records.select("page_id", "record_type", "digest", "payload_bytes"),
                    "headers")
    revisits = narrow.where("record_type = 'revisit'")
    # Only originals that are referred to are looked up, and only revisits are joined.
    wanted = narrow.join(revisits.select("digest").distinct(), "digest", "left_semi")
    joined = revisits.join(originals(wanted), "digest", "left").select(
        "page_id", F.col("bytes").alias("payload_bytes"), "digest", "record_type",
        F.col("first_id").alias("refers_to"))
    own = narrow.where("record_type <> 'revisit'").select(
        "page_id", "payload_bytes", "digest", "record_type",
        F.lit(None).cast("bigint").alias("refers_to"))
    return own.unionByName(joined).withColumnRenamed("digest", "payload_digest")


def deduplicate(spark: SparkSession, source: str, target: str, date: str | None = None,
                records_per_file: int = 2000) -> None:
    """Rewrite archives: revisits get the payload of their response, then one response of each
    payload stays and all other records are revisits of it, under fresh headers.

    A revisit whose response is in no archive of `source` stays a revisit without an original.
    """
    records = read_archives(spark, source, with_payload=True)
    whole = records.where("record_type = 'response'").select("page_id", "url", "payload")
    old = stored(records.where("record_type = 'revisit'").select("page_id", "url", "digest"),
                 "revisits")
    fresh = resolved(whole, payload_column="payload")
    first = stored(fresh.where("record_type = 'response'").groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.min_by("url", "page_id").alias("first_url")),
        "originals")
    again = old.join(first, "digest", "left").select(
        "page_id", "url", F.lit("").alias("payload"), "digest",
        F.lit("revisit").alias("record_type"), "first_id", "first_url")
    write_archives(fresh.unionByName(again), target, date, records_per_file)
