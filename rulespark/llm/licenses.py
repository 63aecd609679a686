"""Licence scans: TF-IDF cosine of lines to templates, then inheritance by directory.

Every line of every file is a candidate header.  Weights are term count times
idf = ln((N + 1) / (df + 1)) + 1, df counted over all files; a word of no
template weighs as one that no file holds.  A line has a template's licence if
their cosine is at least `least`; a file has that of its best line (ties: the
licence that sorts first).  Lines are found by an exact prefilter: without one
of a template's heaviest words the cosine cannot reach `least`.

A licence file is named like one or takes half of its words from its licence
lines.  A file without a licence of its own inherits from the nearest directory
above it that holds a licence file (of several, the one with the highest cosine,
then the licence that sorts first).  Directories are resolved first, by joins on
their paths, so a directory with very many files is one row there.

DataFrame functions only.  Null and empty texts have no lines; a null path has
no directory.  Repeated rows get equal answers.  Empty table: no rows.  Other
columns of the input are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What licence notices say, by SPDX id.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LicenseRef-Reserved": "All rights reserved.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Names of licence files, and what separates words.
LICENSE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$"
SEPARATOR = r"[^a-z0-9]+"
LEAST = 0.7


def terms(text: str) -> list[str]:
    return [w for w in re.split(SEPARATOR, text.lower()) if w]


VOCABULARY = sorted({w for t in TEMPLATES.values() for w in terms(t)})


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), SEPARATOR), lambda w: w != "")


def weights(idf: dict[str, float]) -> dict[str, dict[str, float]]:
    """Unit vectors of the templates."""
    out = {}
    for name, text in TEMPLATES.items():
        w = {t: terms(text).count(t) * idf[t] for t in set(terms(text))}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out[name] = {t: x / norm for t, x in w.items()}
    return out


def required(vectors: dict[str, dict[str, float]], least: float) -> list[str]:
    """Words of which a line must hold one to reach `least` with any template."""
    out: set[str] = set()
    for v in vectors.values():
        dropped = 0.0
        for t, x in sorted(v.items(), key=lambda p: (p[1], p[0])):
            dropped += x * x
            if dropped >= (least - 1e-9) ** 2:
                out.add(t)
    return sorted(out)


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """id, path, own_license, own_cosine, license, inherited_from (a directory or null)."""
    spark = files.sparkSession
    f = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    held = F.array_intersect(words(F.col("text")), F.lit(VOCABULARY))
    counted = f.select(F.explode(F.concat(F.coalesce(held, F.array().cast("array<string>")), F.array(F.lit("")))).alias("t")).groupBy("t").count()
    df = {r["t"]: r["count"] for r in counted.collect()}
    n = df.get("", 0)
    idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in VOCABULARY}
    other = math.log(n + 1) + 1
    vectors = weights(idf)
    cue = r"(?i)(?<![a-z0-9])(" + "|".join(required(vectors, least)) + r")(?![a-z0-9])"
    key = F.xxhash64("id", "path", "text").alias("k")
    lines = f.where(F.col("text").rlike(cue)).select(key, F.size(words(F.col("text"))).alias("all_words"), F.posexplode(F.split("text", "\n")).alias("line", "said")).where(F.col("said").rlike(cue))
    table = spark.createDataFrame([(t, idf[t], *(float(vectors[x].get(t, 0.0)) for x in TEMPLATES)) for t in VOCABULARY], ["t", "idf", *(f"w{k}" for k in range(len(TEMPLATES)))])
    counts = lines.withColumn("n_words", F.size(words(F.col("said")))).select("k", "all_words", "line", "n_words", F.explode(words(F.col("said"))).alias("t"))
    counts = counts.repartition("k", "line").groupBy("k", "line", "all_words", "n_words", "t").agg(F.count("*").alias("tf"))
    x = counts.join(F.broadcast(table), "t", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    each = x.groupBy("k", "line", "all_words", "n_words").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *(F.sum(F.coalesce(F.col("w") * F.col(f"w{j}"), F.lit(0.0))).alias(f"d{j}") for j in range(len(TEMPLATES))))
    scores = F.array(*(F.struct((-F.round(F.col(f"d{j}") / F.col("norm"), 6)).alias("less"), F.lit(name).alias("license")) for j, name in enumerate(TEMPLATES)))
    best = each.select("k", "line", "all_words", "n_words", F.array_min(scores).alias("b")).where(F.col("b.less") <= -least)
    own = best.groupBy("k").agg(F.min("b").alias("b"), (F.sum("n_words") * 2 >= F.first("all_words")).alias("mostly"))
    own = own.select("k", F.col("b.license").alias("own_license"), (-F.col("b.less")).alias("own_cosine"), "mostly")
    dir_of = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    mine = f.select("id", "path", key, dir_of.alias("dir")).join(own, "k", "left")
    is_file = F.col("own_license").isNotNull() & (F.col("mostly") | F.col("path").rlike(LICENSE_NAME))
    licensed = mine.where(is_file & F.col("dir").isNotNull()).groupBy("dir").agg(F.min(F.struct((-F.col("own_cosine")).alias("less"), F.col("own_license").alias("license"))).alias("b")).select("dir", F.col("b.license").alias("license"))
    dirs = mine.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts)))).alias("depth")).select("dir", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("up"))
    found = above.join(licensed.toDF("up", "license"), "up").groupBy("dir").agg(F.max_by(F.struct("license", "up"), "depth").alias("b"))
    found = found.select("dir", F.col("b.license").alias("dir_license"), F.col("b.up").alias("from_dir"))
    out = mine.join(found, "dir", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("path").alias(path_col), "own_license", "own_cosine",
        F.coalesce("own_license", "dir_license").alias("license"), F.when(F.col("own_license").isNull(), F.col("from_dir")).alias("inherited_from"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """documents as files of a tree: source / ten thousands / hundreds; every 7th a level up, every 49th two."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    level = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    deep = F.concat_ws("/", F.coalesce("source", F.lit("none")), level(10000), level(100), name)
    path = F.when(F.col("doc_id") % 49 == 0, F.concat_ws("/", F.coalesce("source", F.lit("none")), name)).when(F.col("doc_id") % 7 == 0, F.concat_ws("/", F.coalesce("source", F.lit("none")), level(10000), name)).otherwise(deep)
    return scan(docs.select("doc_id", path.alias("path"), "text"))


def sql() -> str:
    rows = ", ".join(f"('{name}', '{w}', {terms(text).count(w)})" for name, text in TEMPLATES.items() for w in sorted(set(terms(text))))
    return rf"""
WITH f AS (
  SELECT doc_id, text, CASE WHEN doc_id % 49 = 0 THEN concat_ws('/', coalesce(source, 'none'), doc_id || '.txt')
    WHEN doc_id % 7 = 0 THEN concat_ws('/', coalesce(source, 'none'), doc_id // 10000, doc_id || '.txt')
    ELSE concat_ws('/', coalesce(source, 'none'), doc_id // 10000, doc_id // 100, doc_id || '.txt') END AS path FROM documents
), t(license, w, n) AS (VALUES {rows}
), dw AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))) AS w FROM f
), total AS (SELECT count(*) AS n FROM f
), idf AS (SELECT v.w, ln((total.n + 1) / (coalesce(d.c, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT w FROM t) v LEFT JOIN (SELECT w, count(*) AS c FROM dw GROUP BY w) d USING (w), total
), tv AS (SELECT license, w, n * idf / sqrt(sum((n * idf) ** 2) OVER (PARTITION BY license)) AS v FROM t JOIN idf USING (w)
), l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS said FROM f
), lw AS (SELECT doc_id, line, unnest(list_filter(regexp_split_to_array(lower(said), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM l
), tf AS (SELECT doc_id, line, w, count(*) AS n FROM lw GROUP BY ALL
), x AS (SELECT doc_id, line, w, tf.n AS n, tf.n * coalesce(idf, ln(total.n + 1) + 1) AS v FROM tf LEFT JOIN idf USING (w), total
), norms AS (SELECT doc_id, line, sqrt(sum(v * v)) AS norm, sum(n) AS n_words FROM x GROUP BY ALL
), dots AS (SELECT doc_id, line, license, sum(x.v * tv.v) AS d FROM x JOIN tv USING (w) GROUP BY ALL
), cos AS (SELECT doc_id, line, license, round(d / norm, 6) AS c, n_words FROM dots JOIN norms USING (doc_id, line)
), hit AS (SELECT doc_id, line, license, c, n_words FROM cos WHERE c >= {LEAST} QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY c DESC, license) = 1
), own AS (SELECT doc_id, arg_min(license, struct_pack(a := -c, b := license)) AS own_license, max(c) AS own_cosine, sum(n_words) AS n FROM hit GROUP BY doc_id
), size AS (SELECT doc_id, sum(n_words) AS total_words FROM norms GROUP BY doc_id
), m AS (SELECT f.doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, own_license, own_cosine, coalesce(own.n * 2 >= total_words, false) AS mostly
  FROM f LEFT JOIN own USING (doc_id) LEFT JOIN size USING (doc_id)
), licensed AS (SELECT dir, arg_min(own_license, struct_pack(a := -own_cosine, b := own_license)) AS license FROM m WHERE mostly AND own_license IS NOT NULL GROUP BY dir
), found AS (SELECT d.dir, arg_max(l.license, length(l.dir)) AS license, arg_max(l.dir, length(l.dir)) AS up FROM (SELECT DISTINCT dir FROM m) d JOIN licensed l ON d.dir = l.dir OR starts_with(d.dir, l.dir || '/') GROUP BY d.dir
)
SELECT doc_id, path, own_license, own_cosine, coalesce(own_license, license) AS license, CASE WHEN own_license IS NULL THEN up END AS inherited_from FROM m LEFT JOIN found USING (dir)
"""
