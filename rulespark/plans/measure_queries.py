"""Queries on measures, the information model, version diffs, contracts, logs and emitters."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import logic as L
from ..functions import normalize as N
from ..operators import contract as C
from ..operators import delta as D
from ..operators import infomodel as I
from ..operators import measures as M
from .registry import query, table

#: Claims: one for each event; what went wrong comes from its type and number.
CLAIMS = """WITH c AS (SELECT user_id AS rule_id, event_id, CASE event_type WHEN 'click' THEN 'condition' WHEN 'view' THEN 'scope' WHEN 'error' THEN 'quote' WHEN 'signup' THEN 'outcome' ELSE 'party' END AS claim_type,
  CASE WHEN event_type IN ('click', 'signup') THEN 'core_rule' WHEN event_type = 'error' THEN 'contract' ELSE 'enrichment' END AS dimension,
  CASE WHEN event_id % 17 = 0 THEN 'contradicted' WHEN event_id % 11 = 0 THEN 'insufficient_evidence' ELSE 'supported' END AS verdict FROM events)"""


def claims(spark, sf_dir):
    t, n = F.col("event_type"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("rule_id"), "event_id", N.lookup(t, {"click": "condition", "view": "scope", "error": "quote", "signup": "outcome"}, F.lit("party")).alias("claim_type"),
        F.when(t.isin("click", "signup"), "core_rule").when(t == "error", "contract").otherwise("enrichment").alias("dimension"),
        F.when(n % 17 == 0, "contradicted").when(n % 11 == 0, "insufficient_evidence").otherwise("supported").alias("verdict"),
    )


@query("grounding_dimensions", CLAIMS + " SELECT rule_id, dimension, count(*) FILTER (WHERE verdict = 'supported') AS supported, count(*) FILTER (WHERE verdict = 'contradicted') AS contradicted, count(*) FILTER (WHERE verdict = 'insufficient_evidence') AS insufficient, CASE WHEN bool_or(verdict = 'contradicted') THEN 'failed' WHEN bool_or(verdict = 'insufficient_evidence') THEN 'held' ELSE 'passed' END AS status FROM c GROUP BY ALL")
def grounding_dimensions(spark, sf_dir):
    n = lambda v: F.count_if(F.col("verdict") == v)
    g = claims(spark, sf_dir).groupBy("rule_id", "dimension").agg(n("supported").alias("supported"), n("contradicted").alias("contradicted"), n("insufficient_evidence").alias("insufficient"))
    return g.withColumn("status", F.when(F.col("contradicted") > 0, "failed").when(F.col("insufficient") > 0, "held").otherwise("passed"))


@query("quality_budget", CLAIMS + """, f AS (SELECT rule_id, list(DISTINCT claim_type) AS k FROM c WHERE verdict <> 'supported' GROUP BY rule_id), h AS (SELECT CASE WHEN len(list_filter(k, lambda x: x NOT IN ('quote'))) = 0 THEN 'evidence' WHEN len(list_filter(k, lambda x: x NOT IN ('condition', 'outcome'))) = 0 THEN 'verdict' ELSE 'mixed' END AS cohort FROM f)
 SELECT cohort, count(*) AS rules, floor((SELECT count(DISTINCT rule_id) FROM c) * 10.0 / 100)::BIGINT AS allowed FROM h GROUP BY cohort""")
def quality_budget(spark, sf_dir):
    c = claims(spark, sf_dir)
    x = M.failure_cohorts(c.where("verdict <> 'supported'"), "rule_id", "claim_type", {"evidence": ["quote"], "verdict": ["condition", "outcome"]})
    total = c.agg(F.count_distinct("rule_id").alias("total"))
    return x.groupBy("cohort").agg(F.count("*").alias("rules")).crossJoin(F.broadcast(total)).select("cohort", "rules", M.budget(F.col("total"), 10.0).alias("allowed"))


@query("review_routing", CLAIMS + ", g AS (SELECT rule_id, count(*) FILTER (WHERE verdict <> 'supported') AS b, count(*) FILTER (WHERE verdict = 'contradicted' AND event_id % 2 = 0) AS k FROM c GROUP BY rule_id) SELECT CASE WHEN k > 2 THEN 'human_review' WHEN rule_id % 7 = 0 THEN 'case_management' WHEN rule_id % 3 <> 0 AND b > 0 THEN 'machine_repair' WHEN b > 0 THEN 'human_review' ELSE 'none' END AS route, count(*) AS n FROM g GROUP BY ALL")
def review_routing(spark, sf_dir):
    g = claims(spark, sf_dir).groupBy("rule_id").agg(F.count_if(F.col("verdict") != "supported").alias("b"), F.count_if((F.col("verdict") == "contradicted") & (F.col("event_id") % 2 == 0)).alias("k"))
    r = C.routed(F.col("b"), F.greatest(F.col("k") - 2, F.lit(0)), F.col("rule_id") % 7 == 0, F.col("rule_id") % 3 != 0)
    return g.groupBy(r.alias("route")).agg(F.count("*").alias("n"))


@query("automation_readiness", "SELECT p_partkey, round((40 * p_size / 50.0 + 20 * p_retailprice / 2000 + coalesce(15 * w, 0)) / (60 + CASE WHEN w IS NULL THEN 0 ELSE 15 END) * 100, 4) AS score FROM (SELECT *, CASE WHEN p_size % 4 <> 0 THEN (p_partkey % 10) / 10.0 END AS w FROM part)")
def automation_readiness(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("logic"), (F.col("p_retailprice") / 2000).alias("source"), F.when(F.col("p_size") % 4 != 0, F.col("p_partkey") % 10 / 10.0).alias("links"))
    return p.select("p_partkey", F.round(M.weighted_present({"logic": 40.0, "source": 20.0, "links": 15.0}, 100.0), 4).alias("score"))


SCORED = "WITH s AS (SELECT doc_id, toxic, quality, round((n_chars % 97) / 97.0, 3) AS score, lang FROM labels JOIN documents USING (doc_id))"


def scored(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.round(F.col("n_chars") % 97 / 97.0, 3).alias("score"))
    return table(spark, sf_dir, "labels").join(d, "doc_id")


@query("risk_coverage", SCORED + ", g AS (SELECT score, count(*) AS n, sum(toxic) AS e FROM s GROUP BY score) SELECT score, sum(n) OVER w::BIGINT AS answered, sum(e) OVER w::BIGINT AS errors, round(sum(e) OVER w / sum(n) OVER w, 6) AS risk FROM g WINDOW w AS (ORDER BY score DESC)".replace("sum(n) OVER w::BIGINT", "(sum(n) OVER w)::BIGINT").replace("sum(e) OVER w::BIGINT", "(sum(e) OVER w)::BIGINT"))
def risk_coverage(spark, sf_dir):
    return M.risk_coverage(scored(spark, sf_dir), "score", "toxic").withColumn("risk", F.round("risk", 6))


@query("mann_whitney_auc", SCORED + ", r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s) SELECT round((sum(r) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1) / 2.0) / (count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality = 0)), 8) AS auc FROM r")
def mann_whitney_auc(spark, sf_dir):
    return M.auc(scored(spark, sf_dir), "quality", "score").select(F.round("auc", 8).alias("auc"))


@query("wilson_by_bucket", SCORED + ", g AS (SELECT lang, count(*) AS n, sum(toxic)::BIGINT AS k FROM s GROUP BY lang), p AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM g) SELECT lang, n, k, round(greatest((p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 0), 6) AS low, round(least((p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 1), 6) AS high FROM p")
def wilson_by_bucket(spark, sf_dir):
    g = scored(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").cast("long").alias("k"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    return g.select("lang", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("run_metrics", "SELECT event_type AS stage, strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, round(sum(value), 4) AS cost, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS tokens, CASE WHEN sum((props::JSON ->> 'k')::BIGINT) > 0 THEN round(sum(CASE WHEN user_id % 2 = 0 THEN (props::JSON ->> 'k')::BIGINT ELSE 0 END) / sum((props::JSON ->> 'k')::BIGINT) * 100, 1) END AS cache_hits FROM events GROUP BY ALL")
def run_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])
    g = e.groupBy(F.col("event_type").alias("stage"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("cost"), F.sum("k").alias("tokens"), F.sum(F.when(F.col("user_id") % 2 == 0, F.col("k")).otherwise(0)).alias("c"))
    return g.select("stage", "day", "calls", "cost", "tokens", M.cache_hit_rate(F.col("c"), F.col("tokens")).alias("cache_hits"))


@query("cost_by_model", "WITH p(prefix, price) AS (VALUES ('', 1.0), ('c', 2.0), ('cl', 3.0), ('si', 0.5), ('purchase', 4.0)), e AS (SELECT event_id, event_type, (props::JSON ->> 'k')::BIGINT AS k FROM events), m AS (SELECT event_id, event_type, k, arg_max(price, length(prefix)) AS price FROM e JOIN p ON starts_with(event_type, prefix) GROUP BY ALL) SELECT event_type AS model, max(price) AS price, round(sum(k * price), 4) AS cost FROM m GROUP BY event_type")
def cost_by_model(spark, sf_dir):
    """The price of the longest matching prefix, found once per model name."""
    prices = {"": 1.0, "c": 2.0, "cl": 3.0, "si": 0.5, "purchase": 4.0}
    p = spark.createDataFrame(list(prices.items()), "prefix string, price double")
    g = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(F.sum(F.from_json("props", "k long")["k"]).alias("k"))
    best = g.join(F.broadcast(p), F.startswith("model", "prefix")).groupBy("model", "k").agg(F.max_by("price", F.length("prefix")).alias("price"))
    return best.select("model", "price", F.round(F.col("k") * F.col("price"), 4).alias("cost"))


@query("checkpoint_latest", "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS seq, count(*) AS writes FROM events GROUP BY ALL")
def checkpoint_latest(spark, sf_dir):
    """Last write wins for each key."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("seq"), F.count("*").alias("writes"))


@query("percentile_readiness", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 1) AS p50, round(quantile_cont(l_extendedprice, 0.9), 1) AS p90 FROM lineitem GROUP BY ALL")
def percentile_readiness(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.percentile("l_extendedprice", 0.5), 1).alias("p50"), F.round(F.percentile("l_extendedprice", 0.9), 1).alias("p90"))


@query("histogram", "SELECT least(90, floor(l_quantity * 2 / 10) * 10)::INTEGER AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def histogram(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.least(F.lit(90), F.floor(F.col("l_quantity") * 2 / 10) * 10).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("log_classes", "SELECT CASE WHEN regexp_matches(text, '(?i)(error|failed)') THEN 'error' WHEN regexp_matches(text, '(?i)warn') THEN 'warning' WHEN regexp_matches(text, '(?i)(and|done)') THEN 'success' ELSE 'plain' END AS kind, count(*) AS n FROM conversations GROUP BY ALL")
def log_classes(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").groupBy(F.when(t.rlike("(?i)(error|failed)"), "error").when(t.rlike("(?i)warn"), "warning").when(t.rlike("(?i)(and|done)"), "success").otherwise("plain").alias("kind")).agg(F.count("*").alias("n"))


VARS = """WITH v AS (SELECT p_partkey AS k, 'v' || (p_partkey % 50) || ['_loan_amount', '_interest_rate', '_form_number', '_note', '_signing_date', '_item_count', '_lock_period'][p_partkey % 7 + 1] AS name,
 CASE WHEN p_size % 9 = 0 THEN 'boolean' WHEN p_size % 7 = 0 THEN 'date' WHEN p_size % 17 = 0 THEN 'time' WHEN p_size % 19 = 0 THEN 'list' WHEN p_size % 23 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'number' ELSE 'string' END AS kind,
 CASE WHEN p_size % 5 = 0 THEN 'usd' WHEN p_size % 11 = 0 THEN 'usd_per_month' WHEN p_size % 29 = 0 THEN 'furlong' END AS unit, CASE WHEN p_size % 13 = 0 THEN 3 ELSE 0 END AS n_allowed, p_size % 3 = 0 AS free_text, p_size % 4 = 0 AS integral FROM part),
 b AS (SELECT *, CASE WHEN suffix(name, '_number') THEN 'Identifier' WHEN suffix(name, '_amount') THEN 'Money' WHEN suffix(name, '_rate') THEN 'Percentage' WHEN suffix(name, '_period') THEN 'Duration' WHEN suffix(name, '_count') THEN 'Integer' WHEN suffix(name, '_date') THEN 'Date' END AS byname FROM v),
 u AS (SELECT *, CASE WHEN n_allowed > 0 THEN ['Enumeration', 'declared', ''] WHEN kind = 'boolean' THEN ['Boolean', 'declared', ''] WHEN kind = 'date' THEN ['Date', 'declared', ''] WHEN kind = 'time' THEN ['Time', 'declared', ''] WHEN unit = 'usd' THEN ['Money', 'declared', ''] WHEN unit = 'usd_per_month' THEN ['Money', 'declared', 'y']
  WHEN kind = 'number' AND integral THEN ['Integer', 'derived', ''] WHEN kind = 'number' AND byname IN ('Money', 'Percentage', 'Integer', 'Duration') THEN [byname, 'heuristic', 'y'] WHEN kind = 'number' THEN ['Decimal', 'derived', ''] WHEN kind = 'list' THEN ['String', 'derived', 'y'] WHEN kind = 'string' AND free_text THEN ['Text', 'declared', '']
  WHEN byname IS NOT NULL THEN [byname, 'heuristic', 'y'] ELSE ['String', 'fallback', 'y'] END AS x FROM b),
 t AS (SELECT *, x[1] AS type, x[2] AS basis, x[3] = 'y' AS needs_review FROM u)"""


def variables(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    base = F.element_at(F.array(*map(F.lit, ["_loan_amount", "_interest_rate", "_form_number", "_note", "_signing_date", "_item_count", "_lock_period"])), (k % 7 + 1).cast("int"))
    kind = F.when(s % 9 == 0, "boolean").when(s % 7 == 0, "date").when(s % 17 == 0, "time").when(s % 19 == 0, "list").when(s % 23 == 0, None).when(s % 2 == 0, "number").otherwise("string")
    unit = F.when(s % 5 == 0, "usd").when(s % 11 == 0, "usd_per_month").when(s % 29 == 0, "furlong")
    x = p.select(k.alias("k"), F.concat(F.lit("v"), (k % 50).cast("string"), base).alias("name"), kind.alias("kind"), unit.alias("unit"), F.when(s % 13 == 0, 3).otherwise(0).alias("n_allowed"), (s % 3 == 0).alias("free_text"), (s % 4 == 0).alias("integral"))
    return x.withColumn("t", I.infer_type(F.col("name"), F.col("kind"), F.col("unit"), F.col("n_allowed"), F.col("free_text"), F.col("integral"))).withColumn("type", F.col("t.type"))


@query("type_inference", VARS + " SELECT k, name, type, basis, needs_review FROM t")
def type_inference(spark, sf_dir):
    return variables(spark, sf_dir).select("k", "name", "t.type", "t.basis", "t.needs_review")


@query("type_reconcile", VARS + """, r(a, b) AS (VALUES ('Money','Decimal'),('Percentage','Decimal'),('Quantity','Decimal'),('Integer','Decimal'),('Duration','Decimal'),('Identifier','String'),('Identifier','Text'),('Text','String'),('Enumeration','String'),('Enumeration','Text')), c AS (SELECT DISTINCT name, type FROM t),
 o AS (SELECT x.name, x.type, max(CASE WHEN x.type <> y.type AND r.a IS NULL THEN 1 ELSE 0 END) AS open FROM c x JOIN c y ON x.name = y.name LEFT JOIN r ON r.a = x.type AND r.b = y.type GROUP BY ALL) SELECT name, max(CASE WHEN open = 0 THEN type END) AS type, count(*) AS candidates FROM o GROUP BY name""")
def type_reconcile(spark, sf_dir):
    return I.reconcile(variables(spark, sf_dir), "name", "type")


@query("type_inventory", VARS + " SELECT CASE WHEN type IN ('Money', 'Percentage', 'Integer', 'Decimal', 'Quantity') THEN 'quantity' WHEN type IN ('Date', 'Time', 'Duration') THEN 'temporal' WHEN type = 'Boolean' THEN 'flag' WHEN type = 'Enumeration' THEN 'categorical' WHEN type = 'Identifier' THEN 'identifier' ELSE 'descriptive' END AS category, count(*) AS n, count(DISTINCT name) AS names FROM t GROUP BY ALL")
def type_inventory(spark, sf_dir):
    x = variables(spark, sf_dir)
    return x.groupBy(N.lookup(F.col("type"), I.CATEGORY).alias("category")).agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"))


@query("enum_extraction", "WITH s AS (SELECT 'Brand' || replace(p_brand, '#', '') AS symbol, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS vals FROM part GROUP BY p_brand) SELECT vals AS values, arg_min(symbol, struct_pack(n := length(symbol), s := symbol)) AS enumeration, count(*) AS members FROM s GROUP BY vals".replace("AS values", 'AS "values"'))
def enum_extraction(spark, sf_dir):
    v = table(spark, sf_dir, "part").select(F.concat(F.lit("brand_"), "p_brand").alias("symbol"), "p_type")
    return I.enumerations(v, "symbol", "p_type")


@query("owner_vote", "WITH v AS (SELECT l_partkey AS attribute, o_orderpriority AS owner, count(*) AS votes FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL), k AS (SELECT *, row_number() OVER w AS r, lead(votes) OVER w AS nxt FROM v WINDOW w AS (PARTITION BY attribute ORDER BY votes DESC, owner)) SELECT attribute, CASE WHEN coalesce(nxt = votes, false) THEN NULL ELSE owner END AS owner, votes, coalesce(nxt = votes, false) AS needs_review FROM k WHERE r = 1")
def owner_vote(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("attribute"))
    v = li.join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("owner")), "o_orderkey")
    return I.owners(v, "attribute", "owner")


#: Old and new rules: orders; every 10th id is renumbered, every 13th dropped; some share a citation code.
VERSIONS = """WITH o AS (SELECT o_orderkey::VARCHAR AS id, 'B' || (o_orderkey // 2 * 2 + CASE WHEN o_orderkey % 20 < 18 THEN o_orderkey % 2 ELSE 0 END) AS code FROM orders WHERE o_orderkey % 13 <> 1),
 n AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'N' || o_orderkey ELSE o_orderkey::VARCHAR END AS id, 'B' || (o_orderkey // 2 * 2 + CASE WHEN o_orderkey % 20 < 18 THEN o_orderkey % 2 ELSE 0 END) AS code FROM orders WHERE o_orderkey % 13 <> 0),
 ol AS (SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)), nl AS (SELECT * FROM n WHERE id NOT IN (SELECT id FROM o)),
 m AS (SELECT o.id AS old_id, n.id AS new_id FROM (SELECT code, min(id) AS id FROM ol GROUP BY code HAVING count(*) = 1) o JOIN (SELECT code, min(id) AS id FROM nl GROUP BY code HAVING count(*) = 1) n USING (code)),
 al AS (SELECT id AS old_id, id AS new_id, 'id' AS basis FROM o JOIN n USING (id) UNION ALL SELECT old_id, new_id, 'citation' FROM m UNION ALL SELECT id, NULL, 'removed' FROM ol WHERE id NOT IN (SELECT old_id FROM m) UNION ALL SELECT NULL, id, 'added' FROM nl WHERE id NOT IN (SELECT new_id FROM m))"""


@query("version_alignment", VERSIONS + " SELECT * FROM al")
def version_alignment(spark, sf_dir):
    k = F.col("o_orderkey")
    code = F.concat(F.lit("B"), (F.floor(k / 2) * 2 + F.when(k % 20 < 18, k % 2).otherwise(0)).cast("string"))
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 13 <> 1").select(k.cast("string").alias("id"), code.alias("code"))
    new = o.where("o_orderkey % 13 <> 0").select(F.when(k % 10 == 0, F.concat(F.lit("N"), k.cast("string"))).otherwise(k.cast("string")).alias("id"), code.alias("code"))
    return D.align(old, new)


@query("change_taxonomy", """WITH x AS (SELECT o_orderstatus AS a1, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS a2, o_orderpriority AS b1, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS b2 FROM orders)
 SELECT CASE WHEN a1 IS NOT DISTINCT FROM a2 AND b1 IS NOT DISTINCT FROM b2 THEN 'unchanged' WHEN a1 IS DISTINCT FROM a2 AND b1 IS DISTINCT FROM b2 THEN 'multi_field_change' WHEN a1 IS DISTINCT FROM a2 THEN 'scope_change' ELSE 'condition_change' END AS change, count(*) AS n FROM x GROUP BY ALL""")
def change_taxonomy(spark, sf_dir):
    k = F.col("o_orderkey")
    x = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("old_scope"), F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("new_scope"), F.col("o_orderpriority").alias("old_condition"), F.when(k % 7 != 0, F.col("o_orderpriority")).alias("new_condition"))
    return x.groupBy(D.classify(["scope", "condition"]).alias("change")).agg(F.count("*").alias("n"))


@query("threshold_direction", """WITH x AS (SELECT ['<', '<=', '>', '>=', '=='][o_orderkey % 5 + 1] AS op, o_totalprice AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice + (o_orderkey % 2) * 20 - 10 END AS b FROM orders)
 SELECT op, CASE WHEN a IS NOT DISTINCT FROM b THEN 'none' WHEN a IS NULL OR b IS NULL THEN 'unknown' WHEN op = '==' THEN 'unordered' WHEN (op IN ('<', '<=')) = (b > a) THEN 'weakening' ELSE 'strengthening' END AS direction, count(*) AS n FROM x GROUP BY ALL""")
def threshold_direction(spark, sf_dir):
    k, t = F.col("o_orderkey"), F.col("o_totalprice")
    op = F.element_at(F.array(*map(F.lit, ["<", "<=", ">", ">=", "=="])), (k % 5 + 1).cast("int"))
    x = table(spark, sf_dir, "orders").select(op.alias("op"), t.alias("a"), F.when(k % 3 == 0, t).when(k % 11 == 0, None).otherwise(t + (k % 2) * 20 - 10).alias("b"))
    return x.groupBy("op", D.direction(F.col("op"), F.col("a"), F.col("b")).alias("direction")).agg(F.count("*").alias("n"))


ISSUES = """WITH x AS (SELECT *, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_name END AS nm FROM part), i AS (
 SELECT p_partkey, 'logic' AS section, 'MISSING_NAME' AS code FROM x WHERE nm IS NULL UNION ALL SELECT p_partkey, 'logic', 'BAD_FACT_ID' FROM x WHERE NOT coalesce(regexp_matches(replace(nm, ' ', CASE WHEN p_size % 6 = 0 THEN '__' ELSE '_' END), '^[a-z][a-z0-9]*(?:_[a-z0-9]+)*$'), false)
 UNION ALL SELECT p_partkey, 'scope', 'SCOPE_EMPTY' FROM x WHERE p_size % 8 = 3 UNION ALL SELECT p_partkey, 'parties', 'PARTY_NOT_CANONICAL' FROM x WHERE NOT regexp_matches(p_type, '^(S|P|L|M)'))"""


def found_issues(spark, sf_dir):
    s = F.col("p_size")
    x = table(spark, sf_dir, "part").withColumn("nm", F.when(s % 10 != 0, F.col("p_name")))
    fact = F.replace("nm", F.lit(" "), F.when(s % 6 == 0, "__").otherwise("_"))
    checks = {"MISSING_NAME": ("logic", F.col("nm").isNotNull()), "BAD_FACT_ID": ("logic", fact.rlike("^[a-z][a-z0-9]*(?:_[a-z0-9]+)*$")), "SCOPE_EMPTY": ("scope", s % 8 != 3), "PARTY_NOT_CANONICAL": ("parties", F.col("p_type").rlike("^(S|P|L|M)"))}
    return x, C.issues(x, "p_partkey", checks)


@query("contract_issues", ISSUES + " SELECT * FROM i")
def contract_issues(spark, sf_dir):
    return found_issues(spark, sf_dir)[1]


@query("readiness_sections", ISSUES + " SELECT p_partkey, CASE WHEN bool_or(section = 'logic') THEN 'fail' ELSE 'pass' END AS logic, CASE WHEN bool_or(section = 'scope') THEN 'fail' ELSE 'pass' END AS scope, CASE WHEN bool_or(section = 'parties') THEN 'fail' ELSE 'pass' END AS parties, CASE WHEN count(section) = 0 THEN 'ready' ELSE 'review' END AS readiness FROM part LEFT JOIN i USING (p_partkey) GROUP BY p_partkey")
def readiness_sections(spark, sf_dir):
    x, i = found_issues(spark, sf_dir)
    return C.readiness(x, "p_partkey", i, ["logic", "scope", "parties"])


@query("numeric_consistency", "SELECT x.p_brand, x.p_type, x.p_size, x.p_partkey AS a_id, y.p_partkey AS b_id, x.p_retailprice AS a_value, y.p_retailprice AS b_value FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_type = y.p_type AND x.p_size = y.p_size AND x.p_partkey < y.p_partkey AND x.p_retailprice <> y.p_retailprice")
def numeric_consistency(spark, sf_dir):
    return C.numeric_conflicts(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"], "p_partkey", "p_retailprice")


@query("claim_explosion", "SELECT p_partkey, c.claim_id, c.statement FROM (SELECT p_partkey, unnest([{'claim_id': 'condition:p1', 'statement': p_brand}, {'claim_id': 'scope:state:0', 'statement': p_type}, {'claim_id': 'outcome:0', 'statement': p_size::VARCHAR}]) AS c FROM part)")
def claim_explosion(spark, sf_dir):
    one = lambda i, c: F.struct(F.lit(i).alias("claim_id"), F.col(c).cast("string").alias("statement"))
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(F.array(one("condition:p1", "p_brand"), one("scope:state:0", "p_type"), one("outcome:0", "p_size"))))


@query("duplicate_evidence", "SELECT 'EV-' || left(sha256(source || chr(31) || lang), 16) AS evidence_id, count(*) AS uses, string_agg(DISTINCT (doc_id % 4)::VARCHAR, ',' ORDER BY (doc_id % 4)::VARCHAR) AS fields FROM documents GROUP BY source, lang")
def duplicate_evidence(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    key = F.concat(F.lit("EV-"), F.left(F.sha2(F.concat_ws("\x1f", "source", "lang"), 256), F.lit(16)))
    return d.groupBy("source", "lang").agg(F.count("*").alias("uses"), F.array_join(F.array_sort(F.collect_set((F.col("doc_id") % 4).cast("string"))), ",").alias("fields")).select(key.alias("evidence_id"), "uses", "fields")


@query("bpmn_flows", """WITH s AS (SELECT conv_id, turn, 'task_' || turn AS node FROM conversations), f AS (SELECT conv_id, turn, coalesce(lag(node) OVER w, 'start') AS source, node AS target FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
 SELECT conv_id, source, target FROM f UNION ALL SELECT conv_id, arg_max(node, turn), 'end' FROM s GROUP BY conv_id""")
def bpmn_flows(spark, sf_dir):
    """Ordered steps as sequence flows from start to end."""
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("task_"), F.col("turn").cast("string")).alias("node"))
    f = s.select("conv_id", F.coalesce(F.lag("node").over(W.partitionBy("conv_id").orderBy("turn")), F.lit("start")).alias("source"), F.col("node").alias("target"))
    return f.unionByName(s.groupBy("conv_id").agg(F.max_by("node", "turn").alias("source")).withColumn("target", F.lit("end")))


@query("dmn_unary_tests", """WITH x AS (SELECT p_partkey, ['==', '!=', '<', '>=', 'in', 'not_in', 'contains', 'odd'][p_partkey % 8 + 1] AS op, CASE WHEN p_size % 3 = 0 THEN 'number' WHEN p_size % 3 = 1 THEN 'string' ELSE 'date' END AS kind, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 3 = 0 THEN p_size::VARCHAR ELSE p_name END AS v FROM part),
 l AS (SELECT *, CASE WHEN v IS NULL THEN 'null' WHEN kind = 'number' THEN v WHEN kind = 'date' THEN 'date("' || v || '")' ELSE '"' || v || '"' END AS t FROM x)
 SELECT p_partkey, CASE op WHEN '==' THEN t WHEN '!=' THEN '!= ' || t WHEN '<' THEN '< ' || t WHEN '>=' THEN '>= ' || t WHEN 'in' THEN '[' || t || ']' WHEN 'not_in' THEN 'not([' || t || '])' WHEN 'contains' THEN 'contains(?, ' || t || ')' ELSE 'false' END AS cell FROM l""")
def dmn_unary_tests(spark, sf_dir):
    s = F.col("p_size")
    op = F.element_at(F.array(*map(F.lit, ["==", "!=", "<", ">=", "in", "not_in", "contains", "odd"])), (F.col("p_partkey") % 8 + 1).cast("int"))
    kind = F.when(s % 3 == 0, "number").when(s % 3 == 1, "string").otherwise("date")
    v = F.when(s % 7 == 0, None).when(s % 3 == 0, s.cast("string")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", L.unary_test(op, v, kind).alias("cell"))
