import csv
import io
import random

import pytest

from credence.sources.csv_cells import read_csv_cells


def sequential(content):
    """One reader from the first byte to the last."""
    fault = None
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        fault, text = "utf8", content.decode("utf-8-sig", errors="replace")
    rows = []
    try:
        for cells in csv.reader(io.StringIO(text, newline=""), strict=True):
            number = len(rows)
            rows.append((number, number == 0, cells, fault if number == 0 else None))
    except csv.Error:
        rows.append((len(rows), False, None, "quotes"))
    return rows


def quoted_file(rng, rows):
    """Rows with quoted breaks, commas, quotes, blank rows and all kinds of row ends."""
    def cell():
        text = "".join(rng.choice(["a", "bc", "é", " ", "\n", ",", '""', "\r\n", "\r", "x" * 9])
                       for _ in range(rng.randint(0, 6)))
        if rng.random() < 0.5:
            return f'"{text}"'
        return "".join(c for c in text if c not in '",\r\n') + rng.choice(["", "", 'q"q'])

    out = [(",".join(cell() for _ in range(rng.randint(1, 4))) if rng.random() > 0.1 else "")
           + rng.choice(["\n", "\n", "\r\n", "\r"]) for _ in range(rows)]
    return "".join(out).encode()


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes",
                                                "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def read(spark, path):
    found = {}
    for r in read_csv_cells(spark, str(path)).collect():
        found.setdefault(r.source_file.rsplit("/", 1)[1], []).append(
            (r.locator, r.is_header, r.cells, r.fault))
    return {k: sorted(v, key=lambda r: r[0]) for k, v in found.items()}


def test_equals_the_sequential_reader_in_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(7)
    files = {f"r{i}.csv": quoted_file(rng, rng.randint(1, 60)) for i in range(40)}
    for i in range(40):                                 # quotes that do not fit, somewhere
        content = bytearray(quoted_file(rng, 40))
        for _ in range(rng.choice([1, 1, 2])):
            content.insert(rng.randrange(len(content)), rng.choice(b'"x'))
        files[f"broken{i}.csv"] = bytes(content)
    files["utf8.csv"] = b'a,"b\n' * 30 + b'\xff\xfe"\n' + b"c,d\n" * 30
    files["mark.csv"] = "﻿a,b\nc,d".encode()
    files["long.csv"] = b'a,"' + b"line\n" * 400 + b'end",z\nlast,row\n'
    files["open.csv"] = b"a,b\n" * 40 + b'x,"' + b"line\n" * 100
    files["blank.csv"] = b"\n\n\r\n"
    files["end.csv"] = b'a,"b\n""c"'
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "empty.csv").write_bytes(b"")
    got = read(spark, tmp_path)
    wrong = [n for n, content in files.items() if got.get(n, []) != sequential(content)]
    assert wrong == [] and "empty.csv" not in got


def test_one_file_is_many_tasks(spark, tmp_path, small_splits):
    (tmp_path / "one.csv").write_bytes(b'k,"v\nw"\n' * 3000)
    df = read_csv_cells(spark, str(tmp_path / "one.csv"))
    assert df.rdd.getNumPartitions() > 50
    rows = df.collect()
    assert sorted(r.locator for r in rows) == list(range(3000))
    assert {tuple(r.cells) for r in rows} == {("k", "v\nw")}
