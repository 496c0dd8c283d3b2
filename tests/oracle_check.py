"""Compare registered queries with their SQL on one data folder.

    python tests/oracle_check.py [folder] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import threading
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
         "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "float": "FLOAT"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=0, abs_tol=1.5e-6)
    return a == b


def compare(spark, con, query, sql: str, folder: str) -> list[str]:
    """Differences in columns, types, row count and values; empty when equal."""
    got = query(spark, folder)
    names = sorted(got.columns)
    relation = con.sql(sql)
    if sorted(relation.columns) != names:
        return [f"columns {names} != {sorted(relation.columns)}"]
    problems = []
    types = dict(zip(relation.columns, map(str, relation.types)))
    for name, kind in got.dtypes:
        if KINDS.get(kind, kind) != types[name]:
            problems.append(f"type of {name}: {kind} != {types[name]}")
    left = sorted((tuple(r) for r in got.select(*[f"`{n}`" for n in names]).collect()), key=_key)
    picked = ", ".join(f'"{n}"' for n in names)
    right = sorted(con.sql(f"SELECT {picked} FROM ({sql})").fetchall(), key=_key)
    if len(left) != len(right):
        problems.append(f"rows {len(left)} != {len(right)}")
    bad = [(a, b) for a, b in zip(left, right) if not all(map(_same, a, b))]
    if bad:
        problems.append(f"{len(bad)} of {len(left)} rows differ, first: {names} {bad[0]}")
    return problems


def main() -> int:
    import __spark_entry__ as entry
    from credence.session import local_session
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or queries:
        begin = time.time()
        watch = threading.Timer(120, spark.sparkContext.cancelAllJobs)
        watch.start()
        try:
            problems = compare(spark, con, queries[name], oracle[name], folder) \
                if name in oracle else [f"no SQL, {queries[name](spark, folder).count()} rows"]
        except Exception as error:  # report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        watch.cancel()
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - begin:.1f}s",
              *problems, sep="\n     " if problems else " ", flush=True)
    print(f"{failed} of {len(sys.argv[2:] or queries)} with differences; "
          f"without query: {sorted(set(oracle) - set(queries))}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
