"""Queries on readers, chunks and their paths, logs and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import text as T
from ..sources import files as S
from ..streaming import metrics as M
from .registry import query, table


@query("row_chunks", """SELECT n_regionkey, (rn // 4) AS chunk, 'Columns: n_name, n_nationkey' || chr(10) || string_agg(concat_ws(' | ', CASE WHEN n_nationkey % 5 > 0 THEN 'n_name: ' || n_name END, 'n_nationkey: ' || n_nationkey), chr(10) ORDER BY rn) AS content, min(rn) AS row_start, max(rn) AS row_end FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS rn FROM nation) GROUP BY ALL""")
def row_chunks(spark, sf_dir):
    from pyspark.sql import Window as W

    n = table(spark, sf_dir, "nation").withColumn("rn", (F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).cast("long"))
    return S.row_chunks(n.withColumn("n_name", F.when(F.col("n_nationkey") % 5 > 0, F.col("n_name")).otherwise(" ")), ["n_name", "n_nationkey"], "n_regionkey", "rn", 4)


@query("nested_buckets", """WITH r AS (SELECT p_partkey, p_size FROM part) SELECT 'entity_types' AS bucket_kind, 'E' || p_partkey % 3 AS bucket, 0 AS pos, 'R' || p_partkey AS rule_id FROM r WHERE p_size % 2 = 0 UNION ALL SELECT 'relationships', 'L', i, 'R' || p_partkey || '_' || i FROM r, range(2) t(i) WHERE p_size % 3 = 0""")
def nested_buckets(spark, sf_dir):
    k, s = F.col("p_partkey").cast("string"), F.col("p_size")
    one = F.concat(F.lit('"entity_types": {"E'), (F.col("p_partkey") % 3).cast("string"), F.lit('": {"business_rules": [{"rule_id": "R'), k, F.lit('"}]}, "none": {}}'))
    two = F.concat(F.lit('"relationships": {"L": {"business_rules": [{"rule_id": "R'), k, F.lit('_0"}, {"rule_id": "R'), k, F.lit('_1"}]}}'))
    graph = F.concat(F.lit("{"), F.concat_ws(", ", F.when(s % 2 == 0, one), F.when(s % 3 == 0, two)), F.lit("}"))
    return S.nested_rules(table(spark, sf_dir, "part").select(graph.alias("graph")), "struct<rule_id:string>").select("bucket_kind", "bucket", "pos", F.col("rule.rule_id").alias("rule_id"))


@query("marked_sections", """WITH x AS (SELECT doc_id, text, substr(text, 3, 12) AS a, substr(text, 40, 12) AS e FROM documents WHERE length(text) > 60), p AS (SELECT *, strpos(text, a) AS i, strpos(substr(text, strpos(text, a) + 12), e) AS j FROM x)
 SELECT doc_id, 'A' AS title, length(substr(text, i, CASE WHEN j > 0 THEN 12 + j - 1 + 12 ELSE length(text) END))::INTEGER AS chars FROM p UNION ALL SELECT doc_id, 'B', (length(text) - i + 1)::INTEGER FROM p""")
def marked_sections(spark, sf_dir):
    """Two sections at marks taken from the text, and one whose mark is nowhere."""
    a, e = F.substring("text", 3, 12), F.substring("text", 40, 12)
    mark = lambda t, x, y: F.struct(F.lit(t).alias("title"), x.alias("start"), y.alias("end"))
    m = F.array(mark("A", a, e), mark("B", a, F.lit(None).cast("string")), mark("C", F.lit("~~~ nowhere ~~~"), e))
    d = table(spark, sf_dir, "documents").where(F.length("text") > 60)
    return d.select("doc_id", F.inline(S.marked_sections(F.col("text"), m))).select("doc_id", "title", F.length("content").alias("chars"))


@query("sub_chunks", """WITH d AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: trim(p) <> '') AS ps, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS words FROM documents WHERE text IS NOT NULL) SELECT 'd' || doc_id || CASE WHEN len(ps) > 1 THEN '_sub_' || lpad(i::VARCHAR, 3, '0') ELSE '' END AS chunk_id, 't' || CASE WHEN len(ps) > 1 THEN ' (part ' || i || '/' || len(ps) || ')' ELSE '' END AS title, CASE WHEN len(ps) > 1 THEN 'd' || doc_id END AS parent_chunk_id, CASE WHEN len(ps) > 1 THEN words END AS parent_words FROM d, LATERAL (SELECT unnest(range(1, greatest(len(ps), 1) + 1)) AS i)""")
def sub_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), F.lit("t").alias("title"), F.col("text").alias("content"))
    lines = F.filter(F.split("content", "\n"), lambda p: F.trim(p) != "")
    return S.sub_chunks(d, lines).select("chunk_id", "title", "parent_chunk_id", "parent_words")


@query("chunk_paths", """WITH c AS (SELECT 'c' || lpad(doc_id::VARCHAR, 8, '0') AS chunk_id, regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g') || '/' || coalesce(lower(lang), 'untitled') || '/t' || doc_id % 7 AS b FROM documents WHERE doc_id IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY chunk_id) AS n FROM c) SELECT chunk_id, b || CASE WHEN n > 1 THEN '_' || chunk_id ELSE '' END || '.txt' AS path FROM n""")
def chunk_paths(spark, sf_dir):
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.concat(F.lit("c"), F.lpad(k.cast("string"), 8, "0")).alias("chunk_id"), F.array("source", "lang").alias("section_path"), F.concat(F.lit("T"), (k % 7).cast("string")).alias("title"))
    return S.chunk_paths(d).select("chunk_id", "path")


@query("rerun_items", "SELECT event_id, sha256(event_type || chr(31) || props) AS fingerprint FROM events WHERE sha256(event_type || chr(31) || props) NOT IN (SELECT sha256(event_type || chr(31) || props) FROM events WHERE event_id % 4 = 0)")
def rerun_items(spark, sf_dir):
    """What a rerun has left to do where every fourth item was done."""
    e = table(spark, sf_dir, "events").select("event_id", F.sha2(F.concat_ws("\x1f", "event_type", "props"), 256).alias("fingerprint"))
    return M.new_items(e, e.where("event_id % 4 = 0"), "fingerprint").select("event_id", "fingerprint")


@query("concurrency_limits")
def concurrency_limits(spark, sf_dir):
    """The limiter replayed over events by type: a fold, no SQL; a test follows it."""
    e = table(spark, sf_dir, "events")
    return M.limits(e.select(F.col("event_type").alias("kind"), "ts", F.col("event_id").alias("id"), (F.col("event_id") % 6 > 0).alias("ok"), (F.col("event_id") % 12 == 0).alias("penalize")), "kind")


@query("name_cases", "SELECT c_custkey, 'customer' || substr(c_name, 10) AS camel FROM customer")
def name_cases(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", N.camel(F.col("c_name")).alias("camel"))


@query("window_words", "SELECT doc_id, length(text)::INTEGER AS chars FROM documents WHERE length(text) > 0")
def window_words(spark, sf_dir):
    """Windows of a text cover it whole, whatever their overlap."""
    w = T.windows(F.col("text"), 300, 40)
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", w.alias("w"))
    whole = F.aggregate("w", F.lit(0), lambda at, x: F.when(x["start"] <= at, x["end"]).otherwise(F.lit(-1)))
    return d.select("doc_id", whole.alias("chars"))
