"""Queries on chunking, sections, citations, tokens and names."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import text as T
from ..operators.shared import cut
from .registry import query, table

#: Documents have no headings, so the first line and every fifth after it become one; levels repeat 1, 2, 3, 2.
LEVELS = "[1, 2, 3, 2]"


def headed(spark, sf_dir):
    x = T.lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    level = F.element_at(F.array(*[F.lit(k) for k in (1, 2, 3, 2)]), (F.floor(F.col("line") / 5) % 4 + 1).cast("int"))
    mark = F.concat(F.repeat(F.lit("#"), level), F.lit(" H"), F.col("line").cast("string"))
    return x.withColumn("said", F.when(F.col("line") % 5 == 0, mark).otherwise(F.col("said")))


HEADED = """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
 l AS (SELECT doc_id, unnest(range(0, len(ls)))::INTEGER AS line FROM d),
 h AS (SELECT doc_id, line, CASE WHEN line % 5 = 0 THEN [1, 2, 3, 2][(line // 5) % 4 + 1] ELSE 0 END AS level FROM l)"""


@query("section_paths", HEADED + """, o AS (SELECT doc_id, line, [max(CASE WHEN level = 1 THEN line END) OVER w, max(CASE WHEN level = 2 THEN line END) OVER w, max(CASE WHEN level = 3 THEN line END) OVER w] AS z FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line))
 SELECT doc_id, line, concat_ws(' > ', CASE WHEN z[1] IS NOT NULL THEN 'H' || z[1] END, CASE WHEN z[2] > coalesce(z[1], -1) THEN 'H' || z[2] END, CASE WHEN z[3] > greatest(coalesce(z[1], -1), coalesce(z[2], -1)) THEN 'H' || z[3] END) AS path FROM o""")
def section_paths(spark, sf_dir):
    return T.section_paths(headed(spark, sf_dir), "doc_id").select("doc_id", "line", "path")


@query("page_ranges", """WITH x AS (SELECT l_orderkey, l_linenumber, last_value(CASE WHEN l_linenumber % 3 <> 2 THEN l_quantity::INTEGER END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity ROWS UNBOUNDED PRECEDING) AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS o FROM lineitem)
 SELECT l_orderkey, o::INTEGER AS entry, coalesce(p, 1) AS page_start, greatest(coalesce(p, 1), coalesce(lead(coalesce(p, 1)) OVER (PARTITION BY l_orderkey ORDER BY o) - 1, 60)) AS page_end FROM x""")
def page_ranges(spark, sf_dir):
    """An order is a document, its lines are outline entries; every third page is unresolved."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity")
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).alias("entry"), F.when(F.col("l_linenumber") % 3 != 2, F.col("l_quantity").cast("int")).alias("page"))
    return T.page_ranges(x, "l_orderkey", "entry", "page", F.lit(60)).select("l_orderkey", "entry", "page_start", "page_end")


WINDOWS = """WITH RECURSIVE d AS (SELECT doc_id, text, length(text)::INTEGER AS n FROM documents WHERE length(text) > 0), r AS (
  SELECT doc_id, n, 0 AS s, CASE WHEN n <= 1500 THEN n ELSE (SELECT CASE WHEN b > 0 AND 1500 - b + 1 >= 750 THEN 1500 - b + 1 ELSE 1500 END FROM (SELECT strpos(reverse(substr(text, 1, 1500)), ' ') AS b)) END AS e FROM d
  UNION ALL SELECT r.doc_id, r.n, r.e - 120, CASE WHEN r.e - 120 + 1500 >= r.n THEN r.n ELSE (SELECT CASE WHEN b > 0 AND 1500 - b + 1 >= 750 THEN r.e - 120 + 1500 - b + 1 ELSE r.e - 120 + 1500 END FROM (SELECT strpos(reverse(substr(d.text, r.e - 120 + 1, 1500)), ' ') AS b)) END
  FROM r JOIN d USING (doc_id) WHERE r.e < r.n)"""


@query("chunk_windows", WINDOWS + " SELECT doc_id, s::INTEGER AS start, e::INTEGER AS end_at FROM r")
def chunk_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(T.windows(F.col("text"), 1500, 120)).alias("w")).select("doc_id", F.col("w.start").alias("start"), F.col("w.end").alias("end_at"))


@query("chunk_coverage", "SELECT source, count(*) AS files, sum(length(text))::BIGINT AS chars, 0::BIGINT AS dropped FROM documents GROUP BY source")
def chunk_coverage(spark, sf_dir):
    """Every character is in a window: nothing is dropped."""
    d = table(spark, sf_dir, "documents").withColumn("w", T.windows(F.col("text"), 1500, 120))
    kept = F.aggregate("w", F.struct(F.lit(0).alias("at"), F.lit(0).alias("gap")), lambda s, x: F.struct(x["end"].alias("at"), (s["gap"] + F.greatest(F.lit(0), x["start"] - s["at"])).alias("gap")))
    lost = kept["gap"] + F.length("text") - kept["at"]
    return d.withColumn("lost", F.when(F.length("text") > 0, lost).otherwise(0)).groupBy("source").agg(F.count("*").alias("files"), F.sum(F.length("text").cast("long")).alias("chars"), F.sum("lost").cast("long").alias("dropped"))


@query("paragraph_chunks", """WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: trim(p) <> '') AS ps FROM documents), r AS (
  SELECT doc_id, 1 AS i, 1 AS c, length(ps[1]) AS n FROM d WHERE len(ps) > 0
  UNION ALL SELECT r.doc_id, i + 1, CASE WHEN n + length(ps[i + 1]) >= 600 THEN c + 1 ELSE c END, CASE WHEN n + length(ps[i + 1]) >= 600 THEN length(ps[i + 1]) ELSE n + 1 + length(ps[i + 1]) END FROM r JOIN d USING (doc_id) WHERE i < len(ps))
 SELECT doc_id, c::INTEGER AS chunk, max(n)::INTEGER AS chars, count(*) AS paragraphs FROM r GROUP BY ALL""")
def paragraph_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.packed_paragraphs(F.col("text"), 600)).alias("k", "chunk_text"))
    return d.select("doc_id", (F.col("k") + 1).alias("chunk"), F.length("chunk_text").alias("chars"), F.size(F.split("chunk_text", "\n")).cast("long").alias("paragraphs"))


@query("table_chunks", """WITH x AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS rn, concat_ws(' | ', 's_name: ' || s_name, CASE WHEN s_suppkey % 4 <> 0 THEN 's_acctbal: ' || s_acctbal::INTEGER END) AS line FROM supplier)
 SELECT s_nationkey, (rn // 3)::INTEGER AS chunk, 'Columns: s_name, s_acctbal' || chr(10) || string_agg(line, chr(10) ORDER BY rn) AS content, min(rn)::INTEGER AS row_start, max(rn)::INTEGER AS row_end FROM x GROUP BY ALL""")
def table_chunks(spark, sf_dir):
    """Rows of a table as chunks of three lines "column: value", nulls left out; halves go to the even number, as in SQL."""
    s = table(spark, sf_dir, "supplier").withColumn("rn", F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1)
    bal = F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("s_acctbal: "), F.rint("s_acctbal").cast("int").cast("string")))
    x = s.select("s_nationkey", "rn", F.floor(F.col("rn") / 3).cast("int").alias("chunk"), F.concat_ws(" | ", F.concat(F.lit("s_name: "), "s_name"), bal).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda r: r["line"]), "\n")
    return x.groupBy("s_nationkey", "chunk").agg(F.concat(F.lit("Columns: s_name, s_acctbal\n"), body).alias("content"), F.min("rn").alias("row_start"), F.max("rn").alias("row_end"))


@query("corpus_digest", "SELECT count(*) AS chunks, sha256(string_agg(sha256(text), '' ORDER BY source || '/' || lpad(doc_id::VARCHAR, 12, '0'))) AS digest FROM documents")
def corpus_digest(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), "text")
    return T.corpus_digest(d, "path", "text")


@query("corpus_manifest", "SELECT source, count(*) AS chunks, count(DISTINCT sha256(text)) AS texts, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY source")
def corpus_manifest(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("chunks"), F.count_distinct(F.sha2("text", 256)).alias("texts"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


@query("section_changes", """WITH o AS (SELECT DISTINCT source || '#' || lang AS s FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT DISTINCT source || '#' || CASE WHEN doc_id % 50 = 0 THEN 'new' ELSE lang END AS s FROM documents WHERE doc_id % 4 <> 0)
 SELECT s AS section, 'removed' AS change FROM o WHERE s NOT IN (SELECT s FROM n) UNION ALL SELECT s, 'added' FROM n WHERE s NOT IN (SELECT s FROM o)""")
def section_changes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 3 <> 0").select(F.concat_ws("#", "source", "lang").alias("section"))
    new = d.where("doc_id % 4 <> 0").select(F.concat_ws("#", "source", F.when(F.col("doc_id") % 50 == 0, "new").otherwise(F.col("lang"))).alias("section"))
    return old.subtract(new).withColumn("change", F.lit("removed")).unionByName(new.subtract(old).withColumn("change", F.lit("added")))


@query("token_index", "WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) >= 4))) AS token FROM documents) SELECT token, count(*) AS df, min(doc_id) AS first_doc FROM t GROUP BY token HAVING count(*) >= 5")
def token_index(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    return x.groupBy("token").agg(F.count("*").alias("df"), F.min("doc_id").alias("first_doc")).where("df >= 5")


EVIDENCE = """WITH d AS (SELECT doc_id, length(text) AS n, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) >= 4))) AS token FROM documents),
 b AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) >= 4))) AS token FROM benchmark),
 f AS (SELECT token, count(*) AS df FROM d GROUP BY token),
 a AS (SELECT item_id, token FROM b JOIN f USING (token) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY df, length(token) DESC, token) <= 32)"""


@query("rarest_anchors", EVIDENCE + " SELECT item_id, string_agg(token, ',' ORDER BY token) AS anchors FROM a GROUP BY item_id")
def rarest_anchors(spark, sf_dir):
    a = anchors(spark, sf_dir)
    return a.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("token")), ",").alias("anchors"))


def token_rows(spark, sf_dir, name, key):
    """Lengths are taken before the words are exploded, so that no row of a word carries its text."""
    x = table(spark, sf_dir, name).select(key, F.length("text").alias("n"), T.tokens(F.col("text")).alias("tokens"))
    return x.select(key, "n", F.explode("tokens").alias("token"))


def anchors(spark, sf_dir):
    return T.rarest_anchors(token_rows(spark, sf_dir, "benchmark", "item_id").select("item_id", "token"), token_rows(spark, sf_dir, "documents", "doc_id").select("token"), "item_id")


def hits(spark, sf_dir, a):
    return T.anchor_hits(a, token_rows(spark, sf_dir, "documents", "doc_id"), "item_id", "doc_id")


@query("evidence_topk", EVIDENCE + """, h AS (SELECT item_id, doc_id, any_value(n) AS n, count(*) AS score FROM a JOIN d USING (token) GROUP BY ALL), k AS (SELECT *, row_number() OVER w AS rank FROM h WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id)),
 c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY item_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k WHERE rank <= 12)
 SELECT item_id, doc_id, rank::INTEGER AS rank, score, least(n, 12000 - before)::INTEGER AS taken FROM c WHERE 12000 - before > 0 AND n > 0""")
def evidence_topk(spark, sf_dir):
    h = hits(spark, sf_dir, anchors(spark, sf_dir))
    return T.top_evidence(h, "item_id", F.col("hits"), "doc_id", F.col("n")).select("item_id", "doc_id", "rank", "score", "taken")


@query("source_recovery", EVIDENCE + """, m AS (SELECT item_id, count(*) AS na FROM a GROUP BY item_id), h AS (SELECT item_id, doc_id, count(*) / any_value(na) AS s FROM a JOIN m USING (item_id) JOIN d USING (token) GROUP BY ALL), k AS (SELECT *, row_number() OVER w AS r, lead(s) OVER w AS runner FROM h WINDOW w AS (PARTITION BY item_id ORDER BY s DESC, doc_id))
 SELECT item_id, doc_id, round(s, 4) AS overlap FROM k WHERE r = 1 AND s >= 0.55 AND s - coalesce(runner, 0) >= 0.12""")
def source_recovery(spark, sf_dir):
    """The document that holds an item's anchors, if it is clearly ahead of the next."""
    a = cut(anchors(spark, sf_dir))
    x = T.recovered(hits(spark, sf_dir, a), a.groupBy("item_id").agg(F.count("*").alias("anchors")), "item_id", "doc_id")
    return x.withColumn("overlap", F.round("overlap", 4))


#: Quotes: 60 characters from the middle of every document; every third is changed in its middle words.
QUOTES = """WITH q AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'not in any text at all' ELSE substr(text, greatest(length(text) // 2, 1), 60) END AS quote FROM documents)"""


@query("citation_exact_spans", QUOTES + " SELECT doc_id, CASE WHEN strpos(text, quote) > 0 THEN strpos(text, quote) - 1 END::INTEGER AS start_at, CASE WHEN strpos(text, quote) > 0 THEN strpos(text, quote) - 1 + length(quote) END::INTEGER AS end_at FROM q")
def citation_exact_spans(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    q = F.when(F.col("doc_id") % 3 == 0, "not in any text at all").otherwise(F.substr("text", F.greatest(F.floor(F.length("text") / 2).cast("int"), F.lit(1)), F.lit(60)))
    x = d.withColumn("quote", q).withColumn("s", T.exact_span(F.col("text"), F.col("quote")))
    return x.select("doc_id", F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))


#: Quotes that keep the first and last n words of the first 20, 18 or 14 words of a text, around other words.
ANCHOR = """WITH z AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), w AS (SELECT doc_id, t, string_split(t, ' ') AS ws, 4 + doc_id % 4 AS n FROM z),
 q AS (SELECT doc_id, t, lower(t) AS l, string_split(lower(array_to_string(ws[1:n], ' ') || ' lost ' || array_to_string(ws[15:14 + n], ' ')), ' ') AS ws, n FROM w WHERE len(ws) >= 22),
 k AS (SELECT doc_id, t, l, ws, length(array_to_string(ws, ' ')) AS m, unnest([6, 5, 4]) AS size FROM q),
 h AS (SELECT *, array_to_string(ws[1:size], ' ') AS h, array_to_string(ws[len(ws) - size + 1:], ' ') AS e FROM k WHERE len(ws) >= 2 * size),
 p AS (SELECT *, strpos(l, h) AS a, CASE WHEN strpos(l, h) > 0 THEN strpos(substr(l, strpos(l, h) + length(h)), e) END AS b FROM h),
 r AS (SELECT doc_id, size, substr(t, a, length(h) + b - 1 + length(e)) AS span FROM p WHERE a > 0 AND b > 0 AND length(h) + b - 1 + length(e) <= 2 * m AND length(l) = length(t))"""


@query("citation_anchor_repair", ANCHOR + " SELECT q.doc_id, arg_max(span, size) AS repaired FROM q LEFT JOIN r USING (doc_id) GROUP BY q.doc_id")
def citation_anchor_repair(spark, sf_dir):
    """Quotes whose middle has drifted."""
    n = (F.lit(4) + F.col("doc_id") % 4).cast("int")
    d = table(spark, sf_dir, "documents").withColumn("ws", F.split(N.squeeze(F.col("text")), " ")).where(F.size("ws") >= 22)
    quote = F.concat(F.array_join(F.slice("ws", F.lit(1), n), " "), F.lit(" lost "), F.array_join(F.slice("ws", F.lit(15), n), " "))
    return d.select("doc_id", T.anchor_repair(F.col("text"), quote).alias("repaired"))


@query("word_span_check", "WITH w AS (SELECT doc_id, string_split_regex(trim(text), '\\s+') AS ws FROM documents) SELECT doc_id % 5 AS bucket, count(*) FILTER (WHERE len(ws) >= 9 AND (doc_id % 5 <> 0 OR array_to_string(ws[4:9], ' ') = array_to_string(ws[3:8], ' '))) AS verified, count(*) AS n FROM w GROUP BY ALL")
def word_span_check(spark, sf_dir):
    """Quotes with their word positions; every fifth is off by one."""
    ws = F.split(F.trim("text"), r"\s+")
    off = F.when(F.col("doc_id") % 5 == 0, 2).otherwise(3)
    d = table(spark, sf_dir, "documents").withColumn("quote", F.array_join(F.slice(ws, 4, 6), " "))
    ok = (F.size(ws) >= 9) & T.word_span_matches(F.col("text"), off, off + 6, F.col("quote"))
    return d.groupBy((F.col("doc_id") % 5).alias("bucket")).agg(F.count_if(ok).alias("verified"), F.count("*").alias("n"))


@query("exact_logic_dedup", "SELECT sha256(lang || chr(31) || text) AS fingerprint, min(doc_id) AS doc_id, count(*) AS copies, string_agg(DISTINCT source, ',' ORDER BY source) AS evidence FROM documents GROUP BY ALL")
def exact_logic_dedup(spark, sf_dir):
    return T.exact_dedup(table(spark, sf_dir, "documents"), [F.col("lang"), F.col("text")], "doc_id", "source")


@query("unique_suffixing", "SELECT s_suppkey, CASE WHEN r = 1 THEN n ELSE n || '_v' || r END AS unique_name FROM (SELECT s_suppkey, 'N' || s_nationkey AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier)")
def unique_suffixing(spark, sf_dir):
    from ..operators.relations import with_unique_names

    s = table(spark, sf_dir, "supplier").withColumn("name", F.concat(F.lit("N"), F.col("s_nationkey").cast("string")))
    return with_unique_names(s, "name", "s_suppkey").select("s_suppkey", "unique_name")


NAMES = "SELECT DISTINCT p_type || ' ' || p_name || ' - ' || p_brand AS raw, p_name, p_brand, p_size FROM part"


@query("name_normalisers", f"""WITH x AS ({NAMES}) SELECT DISTINCT raw, lower(trim(raw)) AS plain, CASE WHEN regexp_matches(sid, '^[a-z]') THEN sid ELSE 's_' || sid END AS safe_id,
 upper(regexp_replace(regexp_replace(raw, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS entity_key, left(regexp_replace(regexp_replace(lower(raw), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 100) AS folder,
 regexp_replace(raw, '[^A-Za-z0-9_.-]', '_', 'g') AS xml_id,
 array_to_string(list_transform(list_filter(regexp_split_to_array(raw, '[^A-Za-z0-9]+'), lambda p: p <> ''), lambda p: upper(left(p, 1)) || CASE WHEN p = upper(p) THEN lower(substr(p, 2)) ELSE substr(p, 2) END), '') AS pascal
 FROM (SELECT *, regexp_replace(regexp_replace(lower(trim(raw)), '[^a-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g') AS sid FROM x)""")
def name_normalisers(spark, sf_dir):
    r = F.col("raw")
    x = table(spark, sf_dir, "part").select(F.concat("p_type", F.lit(" "), "p_name", F.lit(" - "), "p_brand").alias("raw")).distinct()
    return x.select("raw", N.name(r).alias("plain"), N.safe_identifier(r).alias("safe_id"), N.entity_key(r).alias("entity_key"), N.folder(r).alias("folder"), N.xml_id(r).alias("xml_id"), N.pascal(r).alias("pascal"))


@query("citation_codes", "SELECT s_suppkey, nullif(regexp_extract(upper('see b' || s_nationkey || '-' || (s_suppkey % 7) || CASE WHEN s_suppkey % 2 = 0 THEN '.3 and c1-2' ELSE ' x' END), '\\b([A-Z][0-9]+(?:-[0-9]+)+(?:\\.[0-9]+)*)\\b', 1), '') AS code FROM supplier")
def citation_codes(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    said = F.concat(F.lit("see b"), F.col("s_nationkey").cast("string"), F.lit("-"), (F.col("s_suppkey") % 7).cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ".3 and c1-2").otherwise(" x"))
    return s.select("s_suppkey", N.citation_code(said).alias("code"))


@query("ascii_text_normalise", "SELECT turn, count(*) AS n, sum(length(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))))::BIGINT AS chars FROM conversations GROUP BY turn")
def ascii_text_normalise(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("turn").agg(F.count("*").alias("n"), F.sum(F.length(N.ascii_text(F.col("text"))).cast("long")).alias("chars"))
