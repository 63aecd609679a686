"""Queries on scores, summaries, samples, batches, answers and graph reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import scores as S
from .measure_queries import SCORED, scored
from .registry import query, table
from .repair_queries import VARIABLES, pick, variables
from .rulebase import EDGES, edges, nodes


@query("catalog_quality", """WITH e AS (SELECT avg(CASE WHEN trim(coalesce(p_name, '')) <> '' AND p_size % 3 > 0 AND p_size % 6 <> 5 THEN 100.0 ELSE 0 END) AS e FROM part), r AS (SELECT avg(CASE WHEN c_custkey % 4 > 0 AND c_acctbal > 0 THEN 100.0 ELSE 0 END) AS r FROM customer)
 SELECT round(e, 1) AS entity_score, round(r, 1) AS relationship_score, round((round(e, 1) + round(r, 1)) / 2, 1) AS overall FROM e, r""")
def catalog_quality(spark, sf_dir):
    s = F.col("p_size")
    e = table(spark, sf_dir, "part").select(F.col("p_name").alias("definition"), F.when(s % 3 > 0, "actor_role").otherwise(" ").alias("concept_kind"), F.when(s % 6 == 5, 4).otherwise(5).alias("n_attributes"), F.lit(1).alias("n_evidence"))
    r = table(spark, sf_dir, "customer").select(F.col("c_name").alias("source_entity"), F.when(F.col("c_custkey") % 4 > 0, "x").alias("target_entity"), F.lit("d").alias("definition"), F.when(F.col("c_acctbal") > 0, 2).otherwise(0).alias("n_evidence"))
    return S.catalog_quality(e, r)


@query("rule_confidence", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN round(p_size * 0.3 + 90 * 0.25 + CASE WHEN p_size % 2 = 0 THEN 80 * 0.2 ELSE 0 END + 70 * 0.15, 2) WHEN p_size % 3 = 1 THEN p_size END AS score, ['derived_from_breakdown', 'model_reported', 'not_scored'][p_size % 3 + 1] AS source, p_size % 3 = 0 AND p_size * 0.3 + 90 * 0.25 + CASE WHEN p_size % 2 = 0 THEN 80 * 0.2 ELSE 0 END + 70 * 0.15 < 60 AS requires_review FROM part""")
def rule_confidence(spark, sf_dir):
    s = F.col("p_size").cast("double")
    base = F.create_map(F.lit("extraction_clarity"), s, F.lit("numeric_precision"), F.lit(90.0), F.lit("source_authority"), F.lit(70.0))
    m = F.when(s % 2 == 0, F.map_concat(base, F.create_map(F.lit("context_completeness"), F.lit(80.0)))).otherwise(base)
    x = table(spark, sf_dir, "part").select("p_partkey", S.rule_confidence(F.when(s % 3 == 0, m), F.when(s % 3 == 1, s), least=60.0).alias("c"))
    return x.select("p_partkey", "c.score", "c.source", "c.requires_review")


@query("dependency_confidence", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN round((p_size * 0.25 + 40 * 0.30) / 0.55, 2) WHEN 1 THEN round((p_size + 7) / 2.0, 2) WHEN 2 THEN 50 ELSE p_size END::DOUBLE AS score FROM part""")
def dependency_confidence(spark, sf_dir):
    s = F.col("p_size").cast("double")
    m = F.when(s % 4 == 0, F.create_map(F.lit("semantic_similarity"), s, F.lit("logical_connection"), F.lit(40.0))).when(s % 4 == 1, F.create_map(F.lit("a"), s, F.lit("b"), F.lit(7.0))).when(s % 4 == 2, F.create_map().cast("map<string,double>")).otherwise(F.create_map(F.lit("domain_relevance"), s))
    return table(spark, sf_dir, "part").select("p_partkey", S.dependency_confidence(m).alias("score"))


@query("confidence_scale", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 100) / 100.0 * 100 WHEN o_orderkey % 3 = 1 THEN (CASE WHEN o_orderkey % 100 <= 1 THEN o_orderkey % 100 * 100 ELSE o_orderkey % 100 END) END::DOUBLE AS confidence FROM orders")
def confidence_scale(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.confidence_scale(F.lit(None).cast("double"), F.when(k % 3 == 0, k % 100 / 100), F.when(k % 3 == 1, (k % 100).cast("double"))).alias("confidence"))


CHECKED = "c AS (SELECT p_partkey AS rule_id, ['passed', 'warning', 'failure'][p_size % 3 + 1] AS outcome, CASE WHEN p_size % 5 > 0 THEN p_size * 2.0 END AS confidence FROM part)"


def checked(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), pick(["passed", "warning", "failure"], s % 3).alias("outcome"), F.when(s % 5 > 0, s * 2.0).alias("confidence"))


@query("validation_summary", "WITH " + CHECKED + " SELECT count(*) FILTER (WHERE outcome = 'passed') AS passed, count(*) FILTER (WHERE outcome = 'warning') AS warnings, count(*) FILTER (WHERE outcome = 'failure') AS failures, count(confidence) AS scored, count(*) - count(confidence) AS unscored, round(avg(confidence), 4) AS avg_confidence FROM c")
def validation_summary(spark, sf_dir):
    return S.validation_summary(checked(spark, sf_dir))


@query("confidence_findings", "WITH " + CHECKED + " SELECT rule_id, CASE WHEN confidence IS NULL THEN 'medium' ELSE 'high' END AS severity FROM c WHERE confidence IS NULL OR confidence < 70")
def confidence_findings(spark, sf_dir):
    return S.confidence_findings(checked(spark, sf_dir))


@query("missing_fields", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN 'a' END, CASE WHEN o_orderkey % 4 = 0 THEN 'o_orderstatus' END) AS missing FROM orders")
def missing_fields(spark, sf_dir):
    k = F.col("o_orderkey")
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 > 0, k).alias("a"), F.when(k % 4 > 0, F.col("o_orderstatus")).otherwise("  ").alias("o_orderstatus"), "o_totalprice")
    return x.select("o_orderkey", F.array_join(S.missing_fields(["a", "o_orderstatus", "o_totalprice"]), ",").alias("missing"))


GROUNDED = "c AS (SELECT user_id AS rule_id, CASE WHEN event_id % 97 = 0 THEN 'contradicted' WHEN event_id % 41 = 0 THEN 'insufficient_evidence' ELSE 'supported' END AS verdict FROM events)"


@query("grounding_report", "WITH " + GROUNDED + ", r AS (SELECT rule_id, bool_or(verdict = 'contradicted') AS bad, bool_or(verdict = 'insufficient_evidence') AS open, count(*) AS n, count(*) FILTER (WHERE verdict = 'supported') AS ok FROM c GROUP BY rule_id) SELECT count(*) AS rules, sum(n)::BIGINT AS claims, sum(ok)::BIGINT AS supported, count(*) FILTER (WHERE NOT bad AND NOT open) AS certified, count(*) FILTER (WHERE bad) AS failed, count(*) FILTER (WHERE open AND NOT bad) AS held, round(count(*) FILTER (WHERE bad OR open) / count(*) * 100, 2) AS hold_rate FROM r")
def grounding_report(spark, sf_dir):
    k = F.col("event_id")
    return S.grounding_report(table(spark, sf_dir, "events").select(F.col("user_id").alias("rule_id"), F.when(k % 97 == 0, "contradicted").when(k % 41 == 0, "insufficient_evidence").otherwise("supported").alias("verdict")))


@query("compile_ladder", """WITH x AS (SELECT event_type AS stage, event_id % 3 > 0 AS compiled, ['TYPE', 'SCOPE'][event_id % 2 + 1] AS code FROM events), b AS (SELECT stage, code, count(*) AS n FROM x WHERE NOT compiled GROUP BY ALL) SELECT stage, count(*) AS total, count(*) FILTER (WHERE compiled) AS compiled, round(count(*) FILTER (WHERE compiled) / count(*) * 100, 1) AS percent, (SELECT string_agg(code || '=' || n, ',' ORDER BY code) FROM b WHERE b.stage = x.stage) AS refusals FROM x GROUP BY stage""")
def compile_ladder(spark, sf_dir):
    k = F.col("event_id")
    return S.compile_ladder(table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), (k % 3 > 0).alias("compiled"), pick(["TYPE", "SCOPE"], k % 2).alias("code")))


@query("bucket_agreement", """WITH r AS (SELECT p_brand AS section, bool_or(p_size % 10 = 0) AS c FROM part WHERE p_partkey % 3 = 0 GROUP BY p_brand), k AS (SELECT p_partkey, CASE WHEN c THEN 'covered' WHEN NOT c THEN 'refused' ELSE 'no_rule' END AS bucket, CASE WHEN p_size % 7 > 0 THEN p_size % 2 END AS answer, p_partkey % 2 AS label FROM part LEFT JOIN r ON section = p_brand || CASE WHEN p_size = 1 THEN 'x' ELSE '' END)
 SELECT bucket, count(answer) AS answered, count(*) FILTER (WHERE answer = label) AS "right", round(count(*) FILTER (WHERE answer = label) / nullif(count(answer), 0) * 100, 2) AS percent FROM k GROUP BY bucket""")
def bucket_agreement(spark, sf_dir):
    p, s = table(spark, sf_dir, "part"), F.col("p_size")
    rules = p.where("p_partkey % 3 = 0").select(F.col("p_brand").alias("section"), (s % 10 == 0).alias("compiled"))
    cases = p.select(F.concat("p_brand", F.when(s == 1, "x").otherwise("")).alias("section"), F.when(s % 7 > 0, s % 2).alias("answer"), (F.col("p_partkey") % 2).alias("label"))
    return S.agreement(S.section_buckets(rules, cases))


@query("parsed_answers", """SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN (event_id % 2)::INTEGER END AS answer, CASE event_id % 4 WHEN 0 THEN least(100, value) WHEN 1 THEN 0 WHEN 2 THEN 5.5 END::DOUBLE AS confidence FROM events""")
def parsed_answers(spark, sf_dir):
    k, bit = F.col("event_id"), (F.col("event_id") % 2).cast("string")
    reply = F.when(k % 4 == 0, F.concat(F.lit('Sure. {"answer": '), bit, F.lit(', "confidence": '), F.col("value").cast("string"), F.lit("}\nBye"))).when(k % 4 == 1, F.concat(F.lit('{"answer": "'), bit, F.lit('", "confidence": -3}'))).when(k % 4 == 2, '{"answer": "maybe", "confidence": "5.5"}').otherwise("no answer")
    return table(spark, sf_dir, "events").select("event_id", S.parse_answer(reply).alias("a")).select("event_id", "a.answer", "a.confidence")


@query("display_texts", """WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 60 WHEN 1 THEN o_orderkey % 4000 WHEN 2 THEN o_totalprice END AS s, o_orderkey % 3 AS m FROM orders), y AS (SELECT *, round_even(s, 0)::BIGINT AS w FROM x)
 SELECT o_orderkey, CASE WHEN s IS NULL THEN '--' WHEN s < 60 THEN printf('%.1fs', s::DOUBLE) WHEN w // 60 < 60 THEN (w // 60) || 'm ' || lpad((w % 60)::VARCHAR, 2, '0') || 's' ELSE (w // 3600) || 'h ' || lpad((w // 60 % 60)::VARCHAR, 2, '0') || 'm' END AS duration,
  CASE m WHEN 0 THEN '$0.00' WHEN 1 THEN '$0.0042' ELSE '$1.50' END AS cost, CASE m WHEN 0 THEN (o_orderkey % 1000)::VARCHAR WHEN 1 THEN '12.5k' ELSE '3.25M' END AS tokens FROM y""")
def display_texts(spark, sf_dir):
    k = F.col("o_orderkey")
    s = F.when(k % 4 == 0, (k % 60).cast("double")).when(k % 4 == 1, (k % 4000).cast("double")).when(k % 4 == 2, F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.duration_text(s).alias("duration"), S.cost_text(pick([0.0, 0.0042, 1.5], k % 3)).alias("cost"), S.token_text(F.when(k % 3 == 0, k % 1000).when(k % 3 == 1, 12500).otherwise(3250000)).alias("tokens"))


@query("decision_variables", "WITH " + VARIABLES + " SELECT name AS variable_id, coalesce(string_agg(DISTINCT type, ',' ORDER BY type) FILTER (WHERE type <> ''), '') AS types, coalesce(string_agg(DISTINCT role, ',' ORDER BY role) FILTER (WHERE role IS NOT NULL), '') AS roles, count(DISTINCT rule_id) AS rules, CASE WHEN count(DISTINCT rule_id) > 1 THEN 'reusable' ELSE 'rule_local' END AS scope FROM v GROUP BY name")
def decision_variables(spark, sf_dir):
    return S.decision_variables(variables(spark, sf_dir))


@query("merge_statistics", "SELECT 'entity' AS by, coalesce(lang, 'unknown') AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'type', source, count(*) FROM documents GROUP BY source")
def merge_statistics(spark, sf_dir):
    return S.merge_statistics(table(spark, sf_dir, "documents"), "lang", "source")


@query("catalog_union", """WITH d AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) ELSE p_brand END AS name, CASE WHEN p_size % 3 > 0 THEN p_name END AS definition, [p_type] AS types FROM part),
 x AS (SELECT *, regexp_replace(upper(name), '[^A-Z0-9]', '', 'g') AS key FROM d), t AS (SELECT key, types[1] AS t, min(pos) AS p FROM x GROUP BY ALL) SELECT key, arg_min(name, pos) AS name, arg_min(definition, pos) FILTER (WHERE definition IS NOT NULL) AS definition, (SELECT string_agg(t, ',' ORDER BY p) FROM t WHERE t.key = x.key) AS types FROM x GROUP BY key""")
def catalog_union(spark, sf_dir):
    k = F.col("p_partkey")
    d = table(spark, sf_dir, "part").select(k.alias("pos"), F.when(k % 2 == 0, F.lower("p_brand")).otherwise(F.col("p_brand")).alias("name"), F.when(F.col("p_size") % 3 > 0, F.col("p_name")).alias("definition"), F.array("p_type").alias("types"))
    return S.catalog_union(d, ["definition"], ["types"]).withColumn("types", F.array_join("types", ","))


@query("concept_union", """WITH c AS (SELECT p_partkey AS pos, p_brand AS id, CASE WHEN p_size % 4 = 0 THEN p_name END AS definition, CASE WHEN p_size % 3 = 0 THEN p_type ELSE 'unresolved' END AS kind FROM part WHERE p_partkey % 2 = 0), f AS (SELECT p_partkey + 1099511627776 AS pos, unnest([p_brand, p_type]) AS id, NULL AS definition, 'business_object' AS kind FROM part WHERE p_partkey % 5 = 0), x AS (SELECT * FROM c UNION ALL SELECT * FROM f)
 SELECT id AS concept_id, arg_min(definition, pos) FILTER (WHERE definition IS NOT NULL) AS definition, coalesce(arg_min(kind, pos) FILTER (WHERE kind <> 'unresolved'), 'unresolved') AS kind FROM x GROUP BY id""")
def concept_union(spark, sf_dir):
    p, s = table(spark, sf_dir, "part"), F.col("p_size")
    c = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("concept_id"), F.when(s % 4 == 0, F.col("p_name")).alias("definition"), F.when(s % 3 == 0, F.col("p_type")).otherwise("unresolved").alias("kind"))
    return S.concept_union(c, p.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("subject"), F.col("p_type").alias("object")))


@query("merged_batches")
def merged_batches(spark, sf_dir):
    """Order-dependent across batches: no SQL, tests compare it with a plain fold."""
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("bucket"), (k % 4).alias("batch"), k.alias("pos"), F.concat(F.lit("R"), (k % 37).cast("string")).alias("rule_id"), F.concat(F.lit("Name "), (k % 53).cast("string")).alias("rule_name"))
    return S.merge_batches(r)


@query("representative_sample", """WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents WHERE source NOT LIKE '%1') SELECT doc_id FROM n WHERE k IN (SELECT least(n - 1, round_even((i * 3 + 1) * (n - 1) / 15.0, 0))::BIGINT FROM (SELECT DISTINCT n FROM n), range(6) t(i))""")
def representative_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    path = F.when(F.col("source").endswith("1"), F.concat(F.lit("a/Table_Of_Contents/"), "source")).otherwise(F.col("source"))
    return S.spaced_sample(d.withColumn("path", path), "doc_id", "path", 6, 1).select("doc_id")


@query("claim_fragments", "SELECT user_id AS rule_id, event_id AS pos, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id)) - 1) // 7 AS fragment FROM events")
def claim_fragments(spark, sf_dir):
    return S.claim_fragments(table(spark, sf_dir, "events").select(F.col("user_id").alias("rule_id"), F.col("event_id").alias("pos")), 7)


@query("packed_fragments")
def packed_fragments(spark, sf_dir):
    """A fold in order of the fragments: no SQL, tests compare it with the limits."""
    c = table(spark, sf_dir, "conversations")
    return S.pack_fragments(c.select((F.col("conv_id") % 10).alias("run"), (F.col("conv_id") * 100 + F.col("turn")).alias("pos"), (F.col("turn") + 1).alias("claims"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars")), 8, 12, 4000)


@query("conflict_batches", """WITH RECURSIVE o AS (SELECT DISTINCT p_partkey AS r, 'v' || p_partkey // 30 || p_brand AS v FROM part UNION SELECT p_partkey, 'w' || p_partkey // 30 || p_type FROM part WHERE p_size % 5 = 0), l AS (SELECT DISTINCT a.r AS a, b.r AS b FROM o a JOIN o b USING (v)), w AS (SELECT a, b FROM l UNION SELECT w.a, l.b FROM w JOIN l ON w.b = l.a), c AS (SELECT a AS rule_id, min(b) AS component FROM w GROUP BY a),
 k AS (SELECT *, count(*) OVER (PARTITION BY component) AS n, row_number() OVER (PARTITION BY component ORDER BY rule_id) - 1 AS i FROM c) SELECT component, i // 3 AS batch, rule_id FROM k WHERE n > 1""")
def conflict_batches(spark, sf_dir):
    k, run = F.col("p_partkey"), F.floor(F.col("p_partkey") / 30).cast("string")
    p = table(spark, sf_dir, "part")
    o = p.select(k.alias("rule_id"), F.concat(F.lit("v"), run, "p_brand").alias("variable")).unionByName(p.where("p_size % 5 = 0").select(k.alias("rule_id"), F.concat(F.lit("w"), run, "p_type").alias("variable")))
    return S.conflict_batches(o, 3)


@query("merged_lists", "SELECT o_orderkey, array_to_string(list_distinct([o_orderstatus, o_orderpriority, o_orderstatus, 'F']), ',') AS merged FROM orders WHERE false UNION ALL SELECT o_orderkey, o_orderstatus || ',' || o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN '' ELSE ',F' END FROM orders")
def merged_lists(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(S.merge_unique(F.array("o_orderstatus", "o_orderpriority"), F.lit(None).cast("array<string>"), F.array(F.col("o_orderstatus"), F.lit("F"))), ",").alias("merged"))


@query("top_concepts", "SELECT p_type AS term, count(DISTINCT p_brand) AS rule_links, count(*) AS fact_links FROM part GROUP BY p_type ORDER BY 2 DESC, 3 DESC, lower(p_type), p_type LIMIT 8")
def top_concepts(spark, sf_dir):
    return S.top_concepts(table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("term")).agg(F.count_distinct("p_brand").alias("rule_links"), F.count("*").alias("fact_links")))


@query("fisher_exact")
def fisher_exact(spark, sf_dir):
    """No SQL: exact binomials; tests compare known tables."""
    g = scored(spark, sf_dir).groupBy("lang").agg(*[F.count_if((F.col("toxic") == t) & (F.col("quality") == q)).alias(f"n{t}{q}") for t in (0, 1) for q in (0, 1)])
    return S.fisher(g, "n00", "n01", "n10", "n11").withColumn("p_value", F.round("p_value", 8))


@query("selective_risk", SCORED + ", p AS (SELECT sum(toxic) OVER w AS e, row_number() OVER w AS k, count(*) OVER () AS n FROM s WINDOW w AS (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)) SELECT round(sum(e / k) / max(n), 8) AS aurc, round(arg_max(e / k, k) FILTER (WHERE k / n <= 0.2 + 1e-9), 8) AS risk_at_20, round(arg_max(e / k, k) FILTER (WHERE k / n <= 0.5 + 1e-9), 8) AS risk_at_50 FROM p")
def selective_risk(spark, sf_dir):
    from ..operators.measures import selective_risk as risk

    x = risk(scored(spark, sf_dir), "score", "toxic", "doc_id", [0.2, 0.5])
    return x.select(*[F.round(c, 8).alias(c) for c in x.columns])


WALK = EDGES + ", bo AS (SELECT source AS u, target AS v FROM e UNION SELECT target, source FROM e UNION SELECT node, node FROM n), w AS (SELECT u, v FROM bo UNION SELECT w.u, bo.v FROM w JOIN bo ON w.v = bo.u), c AS (SELECT u AS node, min(v) AS component FROM w GROUP BY u), d AS (SELECT source AS u, target AS v FROM e UNION SELECT d.u, e.target FROM d JOIN e ON d.v = e.source), y AS (SELECT a.u AS node, min(a.v) AS cycle FROM d a JOIN d b ON a.u = b.v AND a.v = b.u GROUP BY a.u)"


@query("dag_assembly", WALK + " SELECT component, count(*) AS nodes, coalesce((SELECT count(*) FROM e JOIN c q ON q.node = e.source WHERE q.component = c.component), 0) AS edges, count(DISTINCT cycle) AS cycles FROM c LEFT JOIN y USING (node) GROUP BY component")
def dag_assembly(spark, sf_dir):
    return G.assembled(edges(spark, sf_dir).withColumn("kind", F.lit("dataflow")), nodes(spark, sf_dir))


@query("dag_coverage", EDGES + " SELECT (SELECT count(*) FROM n) AS nodes, count(*) AS edges, (SELECT count(*) FROM e) AS used, count(*) FILTER (WHERE source <> target AND target NOT IN (SELECT node FROM n)) AS dangling, count(*) FILTER (WHERE source = target) AS self_loop FROM (SELECT DISTINCT source, target FROM raw)")
def dag_coverage(spark, sf_dir):
    return G.coverage_report(edges(spark, sf_dir), nodes(spark, sf_dir))


@query("topological_order")
def topological_order(spark, sf_dir):
    """Ties go to the smallest ready node, which SQL cannot follow: tests compare with a plain walk."""
    return G.topological_order(edges(spark, sf_dir), nodes(spark, sf_dir))


@query("dependency_chains")
def dependency_chains(spark, sf_dir):
    """Depth first in order, which SQL cannot follow: tests compare with recursion."""
    paths, loops = G.chains(edges(spark, sf_dir).where("source <> target"))
    return spark.createDataFrame([("path", ">".join(map(str, p))) for p in paths] + [("cycle", ">".join(map(str, p))) for p in loops], "kind string, nodes string")


@query("recompute_sets", EDGES + ", s AS (SELECT node FROM n WHERE node % 50 = 7), r AS (SELECT node, true AS start FROM s UNION SELECT e.target, e.target IN (SELECT node FROM s) FROM r JOIN e ON e.source = r.node) SELECT DISTINCT node, CASE WHEN start THEN 'direct' WHEN node % 3 = 0 THEN 'review' ELSE 'recompute' END AS part FROM r")
def recompute_sets(spark, sf_dir):
    n = nodes(spark, sf_dir)
    e = G.clean_edges(edges(spark, sf_dir), n).where("status = 'used'")
    return G.recompute(e, n.where("node % 50 = 7"), n.where("node % 3 = 0"))
