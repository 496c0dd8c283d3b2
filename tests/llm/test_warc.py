import base64
import glob
import hashlib
from collections import defaultdict

from credence.llm import warc as W
from credence.session import fresh_path

SCHEMA = "page_id long, url string, html string, digest string, payload string, n int"


def table():
    bodies = ["<p>é\r\n\r\nWARC/1.1\r\nx</p>", "", "日本" * 3000, "one", "\r\n\r\n", "a\nb\r\n\r\n"]
    rows = [(i, f"http://h{i % 3}/p\r\nX: {i}" if i % 5 == 0 else f"http://h/{i}",
             bodies[i % 6] if i % 4 else f"own {i}", "clash", "c", 1) for i in range(90)]
    return rows + [(90, None, None, None, None, None), (91, "u", "long " * 200_000, "", "", 0)]


def plain(rows):
    groups = defaultdict(list)
    for page, _, html, *_ in rows:
        groups[html or ""].append(page)
    return sorted((page, len((html or "").encode()), base64.b32encode(hashlib.sha1(
        (html or "").encode()).digest()).decode(),
        "response" if page == min(groups[html or ""]) else "revisit",
        None if page == min(groups[html or ""]) else min(groups[html or ""]))
        for page, _, html, *_ in rows)


def listed(spark, path):
    return sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in W.listing(W.read_archives(spark, path)).collect())


def test_round_trip(spark):
    rows = table()
    path = fresh_path(spark, "warc")
    W.write_archives(W.resolved(spark.createDataFrame(rows, SCHEMA).repartition(3)), path,
                     "2024-01-02T03:04:05Z", records_per_file=20)
    assert listed(spark, path) == plain(rows)
    files = glob.glob(path.removeprefix("file:") + "/part-*")
    assert len(files) > 3
    for name in files:
        content = open(name, "rb").read()
        for fields, block in W.parse(content):
            assert fields["warc-date"] == "2024-01-02T03:04:05Z"
            assert (b"HTTP/1.1 200 OK" in block) and "\r" not in fields.get("warc-target-uri", "")
            assert (fields["warc-type"] == "revisit") == ("warc-refers-to" in fields)
    payloads = {r.page_id: r.payload for r in
                W.read_archives(spark, path, with_payload=True).collect() if r.payload is not None}
    assert all(payloads[p] == (h or "") for p, _, h, *_ in rows if p in payloads)


def test_deduplicate_old_archives(spark):
    """Two captures, each with its own revisits, become one set of archives."""
    rows = table()
    source, target = fresh_path(spark, "old"), fresh_path(spark, "new")
    df = spark.createDataFrame(rows, SCHEMA)
    parts = [W.resolved(df.where(f"page_id % 2 = {k}")) for k in (0, 1)]
    W.write_archives(parts[0].unionByName(parts[1]), source)
    assert listed(spark, source) != plain(rows)
    W.deduplicate(spark, source, target)
    assert listed(spark, target) == plain(rows)


def test_repeated_null_and_empty(spark):
    rows = [(1, "u", "x", "", "", 0), (1, "u", "x", "", "", 0), (None, "v", "x", "", "", 0),
            (None, "w", "alone", "", "", 0)]
    path = fresh_path(spark, "warc")
    df = spark.createDataFrame(rows, SCHEMA)
    W.write_archives(W.resolved(df), path)
    got = [(r.page_id, r.record_type, r.refers_to) for r in
           W.listing(W.read_archives(spark, path)).collect()]
    assert sorted(got, key=str) == [(1, "response", None), (1, "response", None),
                                    (None, "response", None), (None, "revisit", 1)]
    empty = fresh_path(spark, "warc")
    W.write_archives(W.resolved(df.limit(0)), empty)
    assert W.read_archives(spark, empty).count() == 0
