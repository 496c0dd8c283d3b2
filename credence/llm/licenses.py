"""License scans: sparse TF-IDF cosine to templates, then inheritance from directories.

Units are the notice lines of a file, anywhere in its text, and the whole text of a licence file.
Equal units are scored once under their checksum, so a notice in a third of all files is one row.  Term weights are
counts times the inverse frequency of the term over all different units and templates.  The dot
products come from a join on the term; only terms of templates are joined, and the templates
are broadcast behind a check of their size.

A file without a licence of its own inherits that of the licence file in the nearest directory
above it: the file's directories are exploded with their depth and joined with the licensed
directories by path, and the deepest hit stays.  A directory with a third of all files is a hot
join key that adaptive execution splits, and the deepest hit is a grouped maximum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from credence.llm.common import column, join_checked, stored

#: Short notices by which the licences are commonly stated.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("CC-BY-4.0", "Licensed under Creative Commons Attribution CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "To the extent possible under law the author has waived all copyright, CC0 1.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, "
                 "version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0"),
    ("proprietary", "All rights reserved"),
)
NOTICE = r"(?i)licen[cs]|copyright|spdx|rights reserved|all copyright|creative commons"
TERM = "[a-z0-9]+(?:[.-][0-9]+)*"
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.-][a-z0-9.]+)?$"
MOST_TEMPLATES = 10_000


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def scan(files: DataFrame, templates: DataFrame | None = None, path_column: str = "path",
         text_column: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per path: path, own_license, own_score, license, inherited_from.

    The own licence is that of the best unit with a cosine of `threshold` or more; ties go to the
    first licence by name.  license is the own one, or else that of the nearest directory; both
    null if there is none.  Rows with one path are one file.  A null text has no unit; a null path
    is dropped, for it names no file.  Columns that are not named are ignored.
    """
    spark = files.sparkSession
    if templates is None:
        templates = spark.range(1).select(F.explode(F.array(*[
            F.struct(F.lit(n).alias("license"), F.lit(t).alias("text"))
            for n, t in TEMPLATES])).alias("t")).select("t.license", "t.text")
    templates = stored(templates.select("license", F.col("text").cast("string").alias("text"))
                       .where("license is not null and text is not null"), "templates")
    if templates.count() > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")

    path = F.regexp_replace(column(path_column).cast("string"), "/+", "/")
    rows = files.select(path.alias("path"), column(text_column).cast("string").alias("text")
                        ).where("path is not null")
    base = F.element_at(F.split("path", "/"), -1)
    found = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(NOTICE))
    units = rows.select("path", F.explode(F.when(
        base.rlike(LICENSE_FILE), F.array_append(found, F.col("text"))).otherwise(found))
        .alias("text")).where("text is not null").withColumn("unit", F.xxhash64("text"))
    texts = units.groupBy("unit").agg(F.any_value("text").alias("text"))
    scores = stored(_scores(texts, templates, threshold), "scores")
    owners = units.select("path", "unit").distinct()
    best = join_checked(owners, scores, ["unit"], "inner").groupBy("path").agg(F.min(F.struct(
        (-F.col("score")).alias("s"), "license")).alias("b")).select(
        "path", F.col("b.license").alias("own_license"), (-F.col("b.s")).alias("own_score"))
    own = stored(best, "own")
    paths = rows.select("path").distinct()
    above = stored(own.where(base.rlike(LICENSE_FILE)).select(
        F.regexp_replace("path", "[^/]*$", "").alias("directory"), "own_license").groupBy(
        "directory").agg(F.min("own_license").alias("found")), "directories")
    steps = F.split(F.regexp_replace("path", "/[^/]*$", ""), "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(
        n.alias("depth"), F.concat(F.array_join(F.slice(steps, 1, n), "/"), F.lit("/"))
        .alias("directory")))
    root = F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("directory")))
    rooted = F.when(F.col("path").startswith("/"), levels).when(
        F.col("path").contains("/"), F.concat(root, levels)).otherwise(root)
    nearest = join_checked(paths.select("path", F.explode(rooted).alias("d")).select(
        "path", "d.depth", "d.directory"), above, ["directory"], "inner").groupBy("path").agg(
        F.max(F.struct("depth", "directory", "found")).alias("n")).select(
        "path", F.col("n.directory").alias("directory"), F.col("n.found").alias("found"))
    return paths.join(own, "path", "left").join(nearest, "path", "left").select(
        "path", "own_license", "own_score",
        F.coalesce("own_license", "found").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("directory")).alias("inherited_from"))


def _scores(units: DataFrame, templates: DataFrame, threshold: float) -> DataFrame:
    """unit, license, score of all units (unit, text) and templates at the threshold or above."""
    # Units come hashed by their number, so counting their terms needs no further shuffle.
    terms = stored(units.select("unit", F.explode(F.concat(_terms(F.col("text")), F.array(
        F.lit("")))).alias("term")).groupBy("unit", "term").agg(F.count("*").alias("tf")), "terms")
    total = terms.where("term = ''").count() + templates.count()    # one empty term a unit
    terms = terms.where("term <> ''")
    known = stored(templates.select("license", "text", F.explode(_terms(F.col("text"))).alias(
        "term")).groupBy("license", "text", "term").agg(F.count("*").alias("tf")), "known")
    df = stored(terms.select("term").union(known.select("term")).groupBy("term").agg(
        F.count("*").alias("df")), "term-counts")
    weight = F.col("tf") * (F.log((F.lit(float(total)) + 1) / (F.col("df") + 1)) + 1)
    weighed = terms.join(df, "term").select("unit", "term", weight.alias("w"))
    norms = weighed.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    model = known.join(df, "term").select("license", "text", "term", weight.alias("v"))
    sizes = model.groupBy("license", "text").agg(
        F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    # A broadcast of bounded size: the terms of at most MOST_TEMPLATES templates.
    dots = weighed.join(F.broadcast(model), "term").groupBy("unit", "license", "text").agg(
        F.sum(F.col("w") * F.col("v")).alias("dot"))
    return dots.join(norms, "unit").join(F.broadcast(sizes), ["license", "text"]).select(
        "unit", "license", F.round(F.col("dot") / (F.col("norm") * F.col("size")), 6).alias(
            "score")).where(F.col("score") >= threshold).groupBy("unit", "license").agg(
        F.max("score").alias("score"))
