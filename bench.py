"""Time the headline queries and the whole jobs.  Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 BENCH_RUNS=3 python bench.py [query ...]

The JVM is warmed up by one run that does not count; each figure is the median of the runs.  Once
BENCH_SECONDS (300) have gone by, what is left runs once.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from collections.abc import Callable
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import view  # noqa: E402
from catalog.queries import QUERIES  # noqa: E402
from credence.plans import audit, profile_report, rank_records  # noqa: E402
from credence.session import local_session  # noqa: E402
from credence.sources.documents import read_records  # noqa: E402

HEADLINE = ("reasoning", "rules_anomaly", "composite_features", "weight_sensitivity",
            "keyword_evidence", "keyword_groups", "keyword_hits", "rank_all",
            "interval_overlap_window", "gap_to_next", "describe", "corr_matrix", "corr_profile",
            "dashboard", "value_counts_topn", "ndcg_at_k", "output_checks", "near_duplicates")


def timed(job: Callable[[], object], runs: int, until: float = 0.0) -> float:
    """Median of the runs; no more are begun after the time `until`."""
    taken: list[float] = []
    while not taken or len(taken) < runs and time.perf_counter() < until:
        begin = time.perf_counter()
        job()
        taken.append(time.perf_counter() - begin)
    return round(median(taken), 3)


def whole_jobs(spark, folder: str) -> tuple[dict[str, float], int, int]:
    """The jobs from JSON lines to written results: seconds, documents, bytes.  Making the
    documents is not part of the time; each job runs once."""
    work = tempfile.mkdtemp(prefix="bench-")
    source = f"{work}/documents"
    view.as_json(view.load(spark, folder, raw=True)).write.text(source)
    size = sum(os.path.getsize(f"{source}/{f}") for f in os.listdir(source)
               if f.endswith(".txt"))

    def rank() -> None:
        assert rank_records.run(spark, source, f"{work}/out", "signals").count() == 0

    def audits() -> None:
        audit.run(read_records(spark, source, "signals"), f"{work}/audit")

    def profile() -> None:
        profile_report.run(read_records(spark, source, "signals", defaults=False),
                           f"{work}/profile")

    seconds = {"rank_documents": timed(rank, 1), "audit_job": timed(audits, 1),
               "profile_job": timed(profile, 1)}
    return seconds, spark.read.text(source).count(), size


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, shuffle_partitions=int(cores), memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> None:
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

    run(names[0])
    until = time.perf_counter() + float(os.environ.get("BENCH_SECONDS", "300"))
    seconds = {name: timed(lambda: run(name), runs, until) for name in names}
    extra = {}
    if not sys.argv[1:]:
        jobs, documents, size = whole_jobs(spark, folder)
        seconds |= jobs
        extra = {"documents": documents, "document_mb": round(size / 1e6, 1),
                 "documents_per_sec": round(documents / jobs["rank_documents"], 1)}
    print(json.dumps({"metric": "total query time", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(folder),
                      "cores": int(cores), "runs": runs, **extra}))


if __name__ == "__main__":
    main()
