import math
import re
from collections import Counter

from credence.llm import licenses as L

SCHEMA = "path string, text string, license string, unit int, term string"
APACHE = "Licensed under the Apache License, Version 2.0."
MIT = "Released under the MIT License."


def table():
    return [
        ("src/a/LICENSE", APACHE, "clash", 1, "t"), ("src/a/x.py", "# code\nprint()", "c", 1, ""),
        ("src/a/b/y.py", f"word\n// {MIT}\nword", "c", 1, ""), ("src/a/b/z.py", "z", "", 0, ""),
        ("src//a/b/deep/LICENSE.txt", "This work is licensed under the GNU General Public "
         "License, version 3.", "", 0, ""), ("src/a/b/deep/q", "q", "", 0, ""),
        ("src/ab/none.py", "licensed to thrill", "", 0, ""), ("src/ab/LICENSE", "nothing", "", 0, ""),
        ("src/ab/null", None, None, None, None), (None, MIT, "", 0, ""), ("top", "no", "", 0, ""),
        ("rep", MIT, "", 0, ""), ("rep", MIT, "", 0, ""), ("rep", APACHE, "", 0, ""),
        ("src/long", "w " * 300_000 + "\n" + "All rights reserved", "", 0, ""),
        ("LICENSE", "", "", 0, "")]


def terms(text):
    return Counter(re.findall(r"[a-z0-9]+(?:[.-][0-9]+)*", text.lower()))


def plain_own(rows):
    """path -> (license, score) by dense cosines."""
    notice = re.compile(r"licen[cs]|copyright|spdx|rights reserved|all copyright|"
                        r"creative commons", re.I)
    units = {}
    for path, text, *_ in rows:
        if path is None or text is None:
            continue
        path = re.sub("/+", "/", path)
        found = [x for x in text.split("\n") if notice.search(x)]
        if re.match(L.LICENSE_FILE, path.split("/")[-1]):
            found.append(text)
        units.setdefault(path, set()).update(found)
    every = sorted(set().union(*units.values()))
    df = Counter(t for text in every + [t for _, t in L.TEMPLATES] for t in terms(text))
    total = len(every) + len(L.TEMPLATES)
    vector = lambda s: {t: n * (math.log((total + 1) / (df[t] + 1)) + 1)
                        for t, n in terms(s).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = {}
    for path, own in units.items():
        best = []
        for unit in own:
            for name, text in L.TEMPLATES:
                a, b = vector(unit), vector(text)
                if a:
                    score = round(sum(x * b.get(t, 0) for t, x in a.items()) / norm(a) / norm(b), 6)
                    if score >= 0.7:
                        best.append((-score, name))
        if best:
            out[path] = (min(best)[1], -min(best)[0])
    return out


def test_scan_equals_brute_force(spark):
    rows = table()
    own = plain_own(rows)
    got = {r.path: r for r in L.scan(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    paths = {re.sub("/+", "/", p) for p, *_ in rows if p is not None}
    assert set(got) == paths
    for path in paths:
        r = got[path]
        name, score = own.get(path, (None, None))
        assert (r.own_license, r.own_score) == (name, score), path
    assert own["rep"][0] in ("Apache-2.0", "MIT") and "src/long" in own
    assert (got["src/a/x.py"].license, got["src/a/x.py"].inherited_from) == ("Apache-2.0", "src/a/")
    assert got["src/a/b/y.py"].license == "MIT" and got["src/a/b/y.py"].inherited_from is None
    assert got["src/a/b/z.py"].inherited_from == "src/a/"
    assert got["src/a/b/deep/q"].license == "GPL-3.0"
    assert got["src/ab/null"].license is None and got["top"].license is None
    assert got["src/a/b/deep/q"].inherited_from == "src/a/b/deep/"


def test_root_licence_empty_table_and_no_python(spark):
    df = spark.createDataFrame([("LICENSE", MIT), ("a/b/c", "x"), ("/a/d", "x"), ("e", "x")],
                               "path string, text string")
    got = {r.path: (r.license, r.inherited_from) for r in L.scan(df).collect()}
    assert got["e"] == ("MIT", "") and got["a/b/c"] == ("MIT", "")
    assert got["/a/d"] == (None, None)
    empty = L.scan(df.limit(0))
    assert empty.count() == 0
    plan = empty._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas"))
