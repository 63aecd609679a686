"""Text operators: sections, windows, chunks, citations, token indexes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalize as N
from .shared import bounded, cut



def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line", "said"))


def section_paths(rows: DataFrame, id_col: str) -> DataFrame:
    """Lines under their headings: "# A", "## B" .. give each line the path of open headings.

    For each level the last heading above counts unless a heading of a higher
    level came after it.
    """
    head = F.regexp_extract("said", r"^(#{1,6})\s+(.+)$", 1)
    x = rows.withColumns({"level": F.length(head), "title": F.trim(F.regexp_extract("said", r"^(#{1,6})\s+(.+)$", 2))})
    w = W.partitionBy(id_col).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    path = []
    for k in range(1, 7):
        at = F.last(F.when(F.col("level") == k, F.struct("line", "title")), ignorenulls=True).over(w)
        above = F.max(F.when((F.col("level") > 0) & (F.col("level") < k), F.col("line"))).over(w)
        path.append(F.when(at["line"] > F.coalesce(above, F.lit(-1)), at["title"]))
    return x.withColumn("path", F.array_join(F.array_compact(F.array(*path)), " > ")).select(id_col, "line", "said", "path", F.col("level"))


def page_ranges(entries: DataFrame, doc: str, order: str, page: str, last_page: Column) -> DataFrame:
    """Outline entries -> [start, end]: an unresolved page inherits the one before; the end is the next start - 1, never before the start."""
    w = W.partitionBy(doc).orderBy(order)
    start = F.coalesce(F.last(page, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(1))
    x = entries.withColumn("page_start", start)
    return x.withColumn("page_end", F.greatest(F.col("page_start"), F.coalesce(F.lead("page_start").over(w) - 1, last_page)))


def windows(text: Column, size: int, overlap: int) -> Column:
    """array<struct<start, end>>: windows of at most `size` characters that snap back to their last space, each beginning `overlap` before the end of the one before; nothing is lost.

    One pass over a text in Arrow batches: a column expression would count characters from the start for each window.
    """
    overlap = min(overlap, size // 2 - 1)

    def cut(t: str | None) -> list[tuple[int, int]]:
        out, at, n = [], 0, len(t or "")
        while at < n:
            end = min(at + size, n)
            if end < n:
                space = t.rfind(" ", at, end) + 1
                end = space if space > at + overlap else end
            out.append((at, end))
            at = n if end == n else end - overlap
        return out

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in cut(t)])

    return run(text)


def packed_paragraphs(text: Column, size: int) -> Column:
    """Paragraphs gathered until a chunk would reach `size` characters."""
    zero = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))
    full = lambda s, p: (s["cur"] != "") & (F.length(s["cur"]) + F.length(p) >= size)
    step = lambda s, p: F.struct(F.when(full(s, p), p).when(s["cur"] == "", p).otherwise(F.concat(s["cur"], F.lit("\n"), p)).alias("cur"), F.when(full(s, p), F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]).alias("out"))
    return F.aggregate(F.filter(F.split(text, "\n"), lambda p: F.trim(p) != ""), zero, step, lambda s: F.when(s["cur"] != "", F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]))


def tokens(text: Column, least: int = 4) -> Column:
    """Distinct lower-case ASCII words of `least` letters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z]+"), lambda t: F.length(t) >= least))


def rarest_anchors(passages: DataFrame, corpus: DataFrame, key: str, most: int = 32) -> DataFrame:
    """(key, token): the words of each passage (key, token) that fewest documents of the corpus (token) hold, of equally rare ones the longest."""
    vocabulary = bounded(cut(passages.select("token").distinct()))
    df = corpus.join(vocabulary, "token").groupBy("token").agg(F.count("*").alias("df"))
    w = W.partitionBy(key).orderBy("df", F.desc(F.length("token")), "token")
    return passages.join(df, "token").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select(key, "token")


def anchor_hits(anchors: DataFrame, corpus: DataFrame, key: str, doc: str) -> DataFrame:
    """(key, doc, n, hits): how many anchors each document (doc, n, token) has in common with each passage.

    Up to a bound the anchors go to the documents, so a document's hits are counted where it is read.
    """
    return corpus.join(bounded(cut(anchors)), "token").groupBy(key, doc).agg(F.first("n").alias("n"), F.count("*").alias("hits"))


def recovered(hits: DataFrame, sizes: DataFrame, key: str, doc: str, least: float = 0.55, margin: float = 0.12) -> DataFrame:
    """(key, doc, overlap): the document that holds most of a passage's anchors, if it holds enough and is clearly ahead of the next."""
    x = hits.join(sizes, key).withColumn("s", F.col("hits") / F.col("anchors"))
    w = W.partitionBy(key).orderBy(F.desc("s"), doc)
    x = x.withColumns({"r": F.row_number().over(w), "runner": F.lead("s").over(w)})
    return x.where((F.col("r") == 1) & (F.col("s") >= least) & (F.col("s") - F.coalesce("runner", F.lit(0.0)) >= margin)).select(key, doc, F.col("s").alias("overlap"))


def exact_span(text: Column, quote: Column) -> Column:
    """0-based [start, end) of a quote, or null."""
    at = F.position(quote, text)
    return F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(quote)).alias("end")))


def anchor_repair(text: Column, quote: Column) -> Column:
    """The text between a quote's first and last 6, else 5, else 4 words, as it stands in the text; null if there is none.

    Both are normalised; the last words are looked for after the first ones, and what lies between
    may be twice as long as the quote at most.
    """
    cased, q = N.cased_text(text), N.ascii_text(quote)
    low, w = F.lower(cased), F.split(q, " ")
    out = []
    for size in (6, 5, 4):
        head, tail = F.array_join(F.slice(w, 1, size), " "), F.array_join(F.slice(w, -size, size), " ")
        a = F.position(head, low)
        b = F.when(a > 0, F.position(tail, low, a + F.length(head)))
        n = b + F.length(tail) - a
        out.append(F.when((F.size(w) >= 2 * size) & (a > 0) & (b > 0) & (n <= 2 * F.length(q)), F.substring(cased, a, n)))
    return F.when((F.length(low) == F.length(cased)) & (q != "") & (low != ""), F.coalesce(*out))


def word_span_matches(text: Column, start: Column, end: Column, quote: Column) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), start + 1, end - start), " ") == quote


def top_evidence(hits: DataFrame, query_col: str, score: Column, tie: str, length: Column, most: int = 12, budget: int = 12_000) -> DataFrame:
    """The `most` best passages of each query that fit in a budget of characters, in order; the last one may be clipped."""
    w = W.partitionBy(query_col).orderBy(F.desc("_s"), tie)
    x = hits.withColumns({"_s": score, "_n": length}).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("taken", F.least(F.col("_n"), F.lit(budget) - before).cast("int")).where("taken > 0").drop("_n").withColumnRenamed("_s", "score")


def corpus_digest(index: DataFrame, path: str, text: str) -> DataFrame:
    """Chunks, and the digest of their digests in order of path."""
    x = index.select(F.struct(F.col(path).alias("p"), F.sha2(F.col(text), 256).alias("h")).alias("x"))
    return x.agg(F.count("*").alias("chunks"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda r: r["h"]), ""), 256).alias("digest"))


def exact_dedup(df: DataFrame, key: list[Column], order: str, evidence: str) -> DataFrame:
    """The first row of each group, with all evidence merged in order."""
    k = F.sha2(F.concat_ws("\x1f", *key), 256)
    return df.withColumn("fingerprint", k).groupBy("fingerprint").agg(F.min(order).alias(order), F.count("*").alias("copies"), F.array_join(F.array_sort(F.collect_set(evidence)), ",").alias("evidence"))

