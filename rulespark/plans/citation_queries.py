"""Queries on citations: spans, repairs, recovery of paths and evidence, over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import citations as C
from ..operators import text as T
from .registry import query, table


def quotes(spark, sf_dir):
    """From each text of 30 words and more: a part of it as it is, in other case and spacing, with a wrong edge, or with a lost middle."""
    ws = F.split(N.squeeze(F.col("text")), " ")
    d = table(spark, sf_dir, "documents").withColumn("ws", ws).where(F.size("ws") >= 30)
    words = lambda a, n: F.array_join(F.slice("ws", a, n), " ")
    k = F.col("doc_id") % 5
    quote = (
        F.when(k == 0, F.substring("text", 5, 60)).when(k == 1, F.upper(F.replace(words(3, 12), F.lit(" "), F.lit("\n ")))).when(k == 2, F.concat(words(2, 20), F.lit(" x")))
        .when(k == 3, F.concat(words(1, 6), F.lit(" lost here "), words(13, 6))).otherwise("words that no text has at all in it")
    )
    return d.select("doc_id", "text", quote.alias("quote"))


@query("citation_spans")
def citation_spans(spark, sf_dir):
    """Needs Unicode folding: no SQL, tests compare span by span."""
    x = quotes(spark, sf_dir).withColumn("s", C.citation_span(F.col("quote"), F.col("text")))
    return x.select("doc_id", "s.start", "s.end", "s.how")


@query("bridge_spans")
def bridge_spans(spark, sf_dir):
    """Quotes that drop five words in the middle, with a wrong place; no SQL."""
    ws = F.split(F.trim("text"), r"\s+")
    d = table(spark, sf_dir, "documents").withColumn("ws", ws).where(F.size("ws") >= 30)
    quote = F.concat_ws(" ", F.slice("ws", 5, 8), F.slice("ws", 18, 8))
    x = d.withColumn("s", C.bridge_span(quote, F.col("text"), F.lit(0), F.lit(16)))
    return x.select("doc_id", "s.start", "s.end")


@query("verified_references")
def verified_references(spark, sf_dir):
    """Quotes by words: right, moved, changed, or from another text; no SQL."""
    ws = F.split(F.trim("text"), r"\s+")
    d = table(spark, sf_dir, "documents").withColumn("ws", ws).where(F.size("ws") >= 30)
    k = F.col("doc_id") % 4
    words = lambda a, n: F.array_join(F.slice("ws", a, n), " ")
    quote = F.when(k == 0, words(6, 10)).when(k == 1, words(12, 10)).when(k == 2, F.concat(words(6, 3), F.lit("x "), words(9, 3), F.lit("y "), words(12, 3), F.lit("z "))).otherwise("nothing like it")
    x = d.withColumn("v", C.verified_reference(quote, F.col("text"), F.lit(5), F.lit(15)))
    return x.groupBy(k.alias("kind"), "v.state").agg(F.count("*").alias("n"))


@query("verbatim_evidence", "WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, text FROM documents) SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN trim(substr(t, 3, 30)) <> '' AND contains(t, trim(substr(t, 3, 30))) WHEN 1 THEN contains(t, 'zzz qqq') ELSE false END AS verbatim FROM d WHERE text IS NOT NULL")
def verbatim_evidence(spark, sf_dir):
    k = F.col("doc_id")
    q = F.when(k % 3 == 0, F.replace(F.substring(N.squeeze(F.col("text")), 3, 30), F.lit(" "), F.lit("\n  "))).when(k % 3 == 1, "zzz qqq").otherwise("  ")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", C.verbatim(q, F.col("text")).alias("verbatim"))


PATHS = """c AS (SELECT DISTINCT source || '/' || coalesce(lang, 'x') || '/' || doc_id % 20 || '.txt' AS path FROM documents WHERE doc_id % 20 < 12), q AS (SELECT doc_id AS cite_id, CASE doc_id % 3 WHEN 0 THEN source || '/' || coalesce(lang, 'x') || '/' || doc_id % 20 || '.txt' WHEN 1 THEN doc_id % 20 || '.txt' ELSE coalesce(lang, 'x') || '/' || doc_id % 20 || '.txt' END AS path FROM documents)"""


@query("recovered_paths", "WITH " + PATHS + """, n AS (SELECT string_split(path, '/')[-1] AS name, min(path) AS p FROM c GROUP BY 1 HAVING count(*) = 1), s AS (SELECT cite_id, min(c.path) AS p FROM q JOIN c ON suffix(c.path, '/' || q.path) GROUP BY cite_id HAVING count(*) = 1)
 SELECT q.cite_id, q.path, coalesce(c.path, n.p, s.p) AS found FROM q LEFT JOIN c ON c.path = q.path LEFT JOIN n ON n.name = string_split(q.path, '/')[-1] LEFT JOIN s USING (cite_id)""")
def recovered_paths(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    lang, file = F.coalesce("lang", F.lit("x")), F.concat((k % 20).cast("string"), F.lit(".txt"))
    whole = F.concat_ws("/", "source", lang, file)
    cites = d.select(k.alias("cite_id"), F.when(k % 3 == 0, whole).when(k % 3 == 1, file).otherwise(F.concat_ws("/", lang, file)).alias("path"))
    return C.recovered_paths(cites, d.where("doc_id % 20 < 12").select(whole.alias("path"))).select("cite_id", "path", "found")


@query("relocated_quotes", """WITH c AS (SELECT item_id % 4 AS root, 'b/' || item_id AS path, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM benchmark), q AS (SELECT item_id AS quote_id, item_id % 4 AS root, substr(t, 1, 3 + item_id % 30) AS quote FROM (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM benchmark)),
 h AS (SELECT quote_id, min(path) AS path FROM q JOIN c USING (root) WHERE contains(t, trim(quote)) GROUP BY quote_id HAVING count(*) = 1) SELECT q.quote_id, h.path FROM q LEFT JOIN h USING (quote_id)""")
def relocated_quotes(spark, sf_dir):
    i, t = F.col("item_id"), N.squeeze(F.col("text"))
    b = table(spark, sf_dir, "benchmark")
    return C.relocated(b.select(i.alias("quote_id"), (i % 4).alias("root"), F.substr(t, F.lit(1), (3 + i % 30).cast("int")).alias("quote")), b.select((i % 4).alias("root"), F.concat(F.lit("b/"), i.cast("string")).alias("path"), "text")).select("quote_id", "path")


@query("evidence_spans", "SELECT doc_id AS evidence_id, CASE WHEN doc_id % 4 = 3 THEN 'no_chunk' WHEN doc_id % 4 = 1 THEN 'absent' ELSE 'exact' END AS state FROM documents WHERE length(text) >= 20")
def evidence_spans(spark, sf_dir):
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").where(F.length("text") >= 20)
    path = F.concat(F.lit("d/"), k.cast("string"))
    e = d.select(k.alias("evidence_id"), path.alias("path"), F.when(k % 4 == 1, "words that are in no text").otherwise(F.substring("text", 1, 20)).alias("quote"))
    return C.evidence_spans(e, d.where("doc_id % 4 < 3").select(path.alias("path"), "text")).select("evidence_id", "state")


@query("tier2_lookup", """SELECT o.o_orderkey AS edit_id, n.v IS NOT NULL AS cited, coalesce(list_contains(n.v, o.o_orderstatus), false) AS recovered FROM orders o LEFT JOIN (SELECT o_custkey AS code, list(DISTINCT o_orderstatus) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey) n ON n.code = o.o_custkey WHERE o.o_orderkey % 3 = 0""")
def tier2_lookup(spark, sf_dir):
    """Edits of the old version looked up by citation in rules read anew: is their value there?"""
    o = table(spark, sf_dir, "orders")
    new = o.where("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("v"))
    x = o.where("o_orderkey % 3 = 0").join(new, "o_custkey", "left")
    return x.select(F.col("o_orderkey").alias("edit_id"), F.col("v").isNotNull().alias("cited"), F.coalesce(F.array_contains("v", F.col("o_orderstatus")), F.lit(False)).alias("recovered"))


@query("search_completeness", "WITH c AS (SELECT count(*) AS n, sha256(string_agg(sha256(text), '' ORDER BY source || '/' || doc_id)) AS h FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL) SELECT n AS chunks, h AS digest FROM c")
def search_completeness(spark, sf_dir):
    """What a search of the whole corpus is bound to."""
    d = table(spark, sf_dir, "documents").where("text is not null and doc_id is not null").withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    return T.corpus_digest(d, "path", "text")
