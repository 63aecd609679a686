"""Queries on the information model, emitted models and vocabulary."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import emit as X
from ..operators import model as M
from .lowering_queries import rule_texts
from .measure_queries import VARS, variables
from .registry import query, table
from .repair_queries import pick

ORDER = """r(a, b) AS (VALUES ('Money','Decimal'),('Percentage','Decimal'),('Quantity','Decimal'),('Integer','Decimal'),('Duration','Decimal'),('Identifier','String'),('Identifier','Text'),('Text','String'),('Enumeration','String'),('Enumeration','Text'))"""


def declarations(spark, sf_dir):
    v = variables(spark, sf_dir)
    low = F.when(F.col("integral"), F.lit(1.0)).when(F.col("k") % 4 == 1, 0.5)
    return v.select(
        F.col("k").alias("rule_id"), F.col("k").alias("pos"), F.col("name").alias("symbol"), "kind", "unit", F.when(F.col("n_allowed") > 0, F.array(F.lit("a"), F.concat(F.lit("b"), (F.col("k") % 2).cast("string")))).alias("values"),
        low.alias("low"), F.when(F.col("integral"), 10.0).alias("high"), F.when(F.col("k") % 10 == 0, F.col("k").cast("string")).alias("default"), "free_text",
    )


@query("attribute_collection", VARS + ", " + ORDER + """, d AS (SELECT *, CASE WHEN integral THEN 1.0 WHEN k % 4 = 1 THEN 0.5 END AS low, CASE WHEN integral THEN 10.0 END AS high FROM t), c AS (SELECT DISTINCT name, type FROM d),
 o AS (SELECT x.name, x.type, max(CASE WHEN x.type <> y.type AND r.a IS NULL THEN 1 ELSE 0 END) AS open FROM c x JOIN c y ON x.name = y.name LEFT JOIN r ON r.a = x.type AND r.b = y.type GROUP BY ALL), e AS (SELECT name, max(CASE WHEN open = 0 THEN type END) AS resolved, count(*) AS types FROM o GROUP BY name),
 bb AS (SELECT d.*, e.resolved, e.types, row_number() OVER (PARTITION BY d.name ORDER BY CASE WHEN e.resolved IS NULL OR d.type = e.resolved THEN 0 ELSE 1 END, CASE basis WHEN 'declared' THEN 0 WHEN 'derived' THEN 1 WHEN 'heuristic' THEN 2 ELSE 3 END, k) AS n FROM d JOIN e USING (name)),
 g AS (SELECT name, count(DISTINCT kind) AS kinds, arg_min(unit, k) FILTER (WHERE unit IS NOT NULL) AS unit, arg_min(k, k) FILTER (WHERE k % 10 = 0) AS dflt, arg_min(struct_pack(l := low, h := high), k) FILTER (WHERE low IS NOT NULL OR high IS NOT NULL) AS rg, bool_or(coalesce(kind = 'list', false)) AS many, bool_or(k % 3 = 0) AS rd, count(DISTINCT k) AS rules,
  list_sort(list_distinct(flatten(list(CASE WHEN n_allowed > 0 THEN ['a', 'b' || k % 2] ELSE [] END)))) AS vals FROM d GROUP BY name)
 SELECT g.name AS symbol, bb.type, bb.basis, coalesce(g.unit, '') AS unit, CASE WHEN many THEN '0..*' WHEN rd THEN '1' ELSE '0..1' END AS multiplicity, rd AS required, dflt::VARCHAR AS "default", array_to_string(vals, ',') AS "values", CASE WHEN bb.types > 1 AND bb.resolved IS NULL THEN 'contradiction' WHEN bb.types > 1 THEN 'refinement' WHEN g.kinds > 1 THEN 'declared_type' END AS conflict,
  bb.needs_review OR bb.types > 1 AS needs_review, g.rules, rg.l AS low, rg.h AS high FROM g JOIN bb ON bb.name = g.name AND bb.n = 1""")
def attribute_collection(spark, sf_dir):
    d = declarations(spark, sf_dir)
    a = M.attributes(d, d.where("rule_id % 3 = 0").select("symbol"))
    bound = lambda op: F.nullif(F.regexp_extract("range", op + r" ([0-9.]+)", 1), F.lit("")).cast("double")
    return a.select("symbol", "type", "basis", "unit", "multiplicity", "required", "default", F.array_join("values", ",").alias("values"), "conflict", "needs_review", "rules", bound(">=").alias("low"), bound("<=").alias("high"))


@query("model_relationships", """WITH f AS (SELECT lower(n_name) AS s, r_name AS o, CASE WHEN n_nationkey % 3 > 0 THEN 'lies in' ELSE 'relates to' END AS v, n_regionkey FROM nation JOIN region ON r_regionkey = n_regionkey), c AS (SELECT n_name AS id FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT r_name FROM region),
 p AS (SELECT id, array_to_string(list_transform(list_filter(regexp_split_to_array(id, '[^A-Za-z0-9]+'), lambda x: x <> ''), lambda x: CASE WHEN x = upper(x) THEN upper(x[1]) || lower(x[2:]) ELSE upper(x[1]) || x[2:] END), '') AS class FROM c) SELECT DISTINCT a.class AS source, b.class AS target, v AS verb, true AS needs_review FROM f JOIN p a ON lower(a.id) = s JOIN p b ON b.id = o WHERE a.class <> b.class""")
def model_relationships(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    facts = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.lower("n_name").alias("subject"), F.when(F.col("n_nationkey") % 3 > 0, "lies in").otherwise(" ").alias("verb"), F.col("r_name").alias("object"))
    from ..functions import normalize as N

    c = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("concept_id")).union(r.select("r_name")).distinct()
    return M.relationships(facts, c.withColumn("class", N.pascal(F.col("concept_id"))))


@query("model_classes", """WITH c AS (SELECT DISTINCT p_type AS id, 'd' AS def, CASE p_type WHEN 'PROMO' THEN 'decision_variable' WHEN 'ECONOMY' THEN 'business_object' END AS kind FROM part WHERE p_type <> 'MEDIUM'), o AS (SELECT p_partkey AS symbol, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN lower(p_type) ELSE p_type END AS owner FROM part), e AS (SELECT 'medium' AS id, NULL AS def, 'event' AS kind),
 k AS (SELECT * FROM c UNION ALL SELECT * FROM e) SELECT k.id AS concept_id, upper(k.id[1]) || CASE WHEN k.id = upper(k.id) THEN lower(k.id[2:]) ELSE k.id[2:] END AS class, coalesce(def, '') AS definition, coalesce(kind, '') AS kind, count(DISTINCT symbol) AS attributes, def IS NULL AS needs_review FROM k JOIN o ON lower(owner) = lower(id) WHERE kind IS NULL OR kind <> 'decision_variable' GROUP BY ALL""")
def model_classes(spark, sf_dir):
    p, t, s = table(spark, sf_dir, "part"), F.col("p_type"), F.col("p_size")
    concepts = p.where("p_type <> 'MEDIUM'").select(t.alias("concept_id"), F.lit("d").alias("definition"), F.when(t == "PROMO", "decision_variable").when(t == "ECONOMY", "business_object").alias("kind")).distinct()
    entities = spark.createDataFrame([("medium", None, "event"), ("promo", None, "event")], "concept_id string, definition string, kind string")
    return M.assembled(concepts, entities, p.select(F.col("p_partkey").alias("symbol"), F.when(s % 3 == 1, F.lower(t)).when(s % 3 == 2, t).alias("owner")))


MEMBERS = """m AS (SELECT CASE WHEN p_partkey % 6 > 0 THEN 'C' || p_partkey // 8 END AS class, 's' || p_partkey AS symbol, 'n' || p_partkey AS name, CASE WHEN p_partkey // 8 % 3 = 0 THEN 'Boolean' ELSE ['Money', 'Date', 'Grade', 'Text'][p_size % 4 + 1] END AS type, ['declared', 'derived', 'heuristic', 'fallback'][p_size % 4 + 1] AS basis,
 CASE WHEN p_size % 5 = 0 THEN 3 ELSE 0 END AS n_values, false AS constrained, ['contradiction', 'refinement', NULL][p_size % 3 + 1] AS conflict, p_size % 2 = 0 AS needs_review FROM part WHERE p_size > 2), k AS (SELECT DISTINCT 'C' || p_partkey // 8 AS class FROM part), b AS (SELECT class, count(*) AS n, count(*) FILTER (WHERE type = 'Boolean') AS f FROM m WHERE class IS NOT NULL GROUP BY class)"""


@query("model_checks", "WITH " + MEMBERS + """, x AS (SELECT 'concept_representation' AS c, 'review' AS s, p_brand AS j FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT 'attribute_presence', 'error', class FROM k WHERE class NOT IN (SELECT class FROM b) UNION ALL SELECT 'attribute_presence', 'review', class FROM b WHERE n > 3 AND f = n
 UNION ALL SELECT 'type_defensibility', 'review', class || '.' || name FROM m WHERE class IS NOT NULL AND basis IN ('fallback', 'heuristic') UNION ALL SELECT 'type_consistency', CASE WHEN conflict = 'contradiction' THEN 'error' ELSE 'review' END, symbol FROM m WHERE conflict IS NOT NULL UNION ALL SELECT 'relationship_direction_and_multiplicity', 'review', 'A -> B'
 UNION ALL SELECT 'enumeration_usage', 'error', class || '.' || name FROM m WHERE class IS NOT NULL AND n_values > 0 AND type IN ('Money', 'Date', 'Text', 'Boolean') UNION ALL SELECT 'constraint_coverage', 'error', 'model' UNION ALL SELECT 'no_superfluous_elements', 'review', 'E1' UNION ALL SELECT 'no_superfluous_elements', 'review', class FROM b WHERE n = 1 AND f = 1
 UNION ALL SELECT 'source_consistency', 'error', 'model' WHERE EXISTS (SELECT 1 FROM part WHERE p_size <= 2) UNION ALL SELECT 'source_consistency', 'review', 'model' WHERE EXISTS (SELECT 1 FROM m WHERE class IS NULL) UNION ALL SELECT 'ambiguity_flagged', 'review', name FROM m WHERE class IS NULL AND needs_review) SELECT c AS "check", s AS severity, j AS subject FROM x""")
def model_checks(spark, sf_dir):
    p, k, s = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    run = F.floor(k / 8)
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    members = p.where("p_size > 2").select(
        F.when(k % 6 > 0, text("C", run)).alias("class"), text("s", k).alias("symbol"), text("n", k).alias("name"), F.when(run % 3 == 0, "Boolean").otherwise(pick(["Money", "Date", "Grade", "Text"], s % 4)).alias("type"), pick(["declared", "derived", "heuristic", "fallback"], s % 4).alias("basis"),
        F.when(s % 5 == 0, 3).otherwise(0).alias("n_values"), F.lit(False).alias("constrained"), pick(["contradiction", "refinement", None], s % 3).alias("conflict"), (s % 2 == 0).alias("needs_review"),
    )
    classes = p.select(text("C", run).alias("class")).distinct().withColumn("concept_id", F.col("class"))
    concepts = p.select(F.col("p_brand").alias("concept_id"), F.lit("event").alias("kind")).distinct()
    relations = spark.createDataFrame([("A", "B", True), ("B", "A", False)], "source string, target string, needs_review boolean")
    enums = spark.createDataFrame([("E1", 1), ("E2", 2)], "enumeration string, n int")
    return M.model_findings(concepts, classes, members, relations, enums, p.select(text("S", k).alias("symbol")))


@query("model_proposals")
def model_proposals(spark, sf_dir):
    """Outcomes depend on one another: no SQL, a test goes through cases."""
    p, k, s = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    symbol = F.concat(F.lit("S"), (k - k % 2).cast("string"))
    proposals = p.select(k.alias("pos"), symbol.alias("symbol"), F.when(s % 5 == 0, pick(["Loan", "Nobody"], k % 2)).alias("owner"), F.when(s % 5 > 1, F.concat(F.lit("new "), F.floor(k / 12).cast("string"))).alias("new_class"), F.when(s % 11 == 0, "Pair").alias("value_object"), pick(["high", "Low", "unclear", "sure"], s % 4).alias("confidence"))
    unassigned = p.where("p_partkey % 7 > 0").select(F.concat(F.lit("s"), k.cast("string")).alias("symbol"), F.when(F.floor(k / 12) % 2 == 0, "Boolean").otherwise("Money").alias("type"))
    return M.accepted_proposals(proposals, unassigned, spark.createDataFrame([("Loan",)], "class string"))


@query("attribute_catalog", VARS + " SELECT 'C' || k % 4 AS class, name AS attribute, type, CASE WHEN type IN ('Money', 'Percentage', 'Decimal', 'Quantity', 'Duration') THEN 'decimal(38,10)' WHEN type = 'Integer' THEN 'bigint' WHEN type = 'Boolean' THEN 'boolean' WHEN type = 'Date' THEN 'date' WHEN type = 'DateTime' THEN 'timestamp' ELSE 'string' END AS stored_as FROM t")
def attribute_catalog(spark, sf_dir):
    return M.catalog_rows(variables(spark, sf_dir).select(F.concat(F.lit("C"), (F.col("k") % 4).cast("string")).alias("class"), "name", "type"))


def emitted_rules(spark, sf_dir):
    """The rules that are JSON at all, with routes and workflows."""
    r = rule_texts(spark, sf_dir).where("ordinal % 16 <> 8")
    flow = json.dumps({"trigger_event": "receipt", "actor_role": "CLERK", "ordered_steps": [{"step_id": "a", "name": "Check", "kind": "user_task"}, {"step_id": "b", "name": "Decide", "kind": "business_rule_task"}]})
    route = pick(["none", "human_review", "case_management"], F.col("ordinal") % 3)
    more = F.concat(F.lit('{"route": "'), route, F.lit('", "bpmn_eligible": '), (F.col("ordinal") % 4 == 0).cast("string"), F.lit(f', "workflow_semantics": {flow}, '))
    return r.select(F.concat(F.lit("R"), F.col("ordinal").cast("string")).alias("rule_id"), F.concat(more, F.expr("substring(rule, 2)")).alias("rule"))


@query("dmn_cells", "SELECT 'R' || p_partkey AS rule_id, string_agg(t, '; ' ORDER BY i) AS cells FROM (SELECT p_partkey, unnest([0, 1, 2, 3, 4, 5]) AS i, unnest([CASE WHEN f = 10 THEN 'weight' ELSE 'amount' END, 'grade', CASE f WHEN 2 THEN 'false' WHEN 3 THEN '>= \"ten\"' ELSE '>= 10' END, CASE WHEN f = 9 THEN '[]' ELSE '[\"a\", \"b\"]' END, 'true', NULL]) AS t FROM (SELECT *, p_partkey % 16 AS f FROM part) WHERE f <> 8) WHERE t IS NOT NULL GROUP BY p_partkey")
def dmn_cells(spark, sf_dir):
    """Decision tables made, read back, and their texts in order."""
    e = X.read_models(X.emitted(emitted_rules(spark, sf_dir), X.decision), X.DMN).where("tag = 'text'")
    return e.groupBy("rule_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "; ").alias("cells"))


@query("bpmn_elements", "SELECT 'R' || p_partkey AS rule_id, 'CLERK' AS role, 3 AS flows, 'start_R' || p_partkey || '>step_R' || p_partkey || '_a>step_R' || p_partkey || '_b>end_R' || p_partkey AS path FROM part WHERE p_partkey % 16 IN (0, 4, 12)")
def bpmn_elements(spark, sf_dir):
    e = X.read_models(X.emitted(emitted_rules(spark, sf_dir), X.process), X.BPMN)
    g = e.where("tag = 'sequenceFlow'").groupBy("rule_id").agg(F.count("*").cast("int").alias("flows"), F.array_sort(F.collect_list(F.struct("pos", "source", "target"))).alias("f"))
    return g.select("rule_id", F.lit("CLERK").alias("role"), "flows", F.concat_ws(">", F.col("f")[0]["source"], F.transform("f", lambda x: x["target"])).alias("path"))


@query("emission_faults", "SELECT 'R' || p_partkey AS rule_id, 'missing' AS fault FROM part WHERE p_partkey % 16 = 8 AND p_partkey % 3 > 0 UNION ALL SELECT 'R' || p_partkey, 'unexpected' FROM part WHERE p_partkey % 16 <> 8 AND p_partkey % 3 > 0 AND p_partkey % 5 = 0")
def emission_faults(spark, sf_dir):
    """Review cases against the rules that must have one (every fifth is left out of the list)."""
    cases = X.emitted(emitted_rules(spark, sf_dir), X.case)
    p = table(spark, sf_dir, "part")
    want = p.where("p_partkey % 3 > 0 and (p_partkey % 5 > 0 or p_partkey % 16 = 8)").select(F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("rule_id"))
    return X.model_faults(cases, want, X.read_models(cases, X.CMMN))


@query("emission_report", "WITH r AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 16 <> 8), x AS (SELECT 'bpmn' AS model, count(*) FILTER (WHERE k % 4 = 0) AS emitted, count(*) AS rules FROM r UNION ALL SELECT 'cmmn', count(*) FILTER (WHERE k % 3 > 0), count(*) FROM r UNION ALL SELECT 'dmn', count(*), count(*) FROM r) SELECT model, emitted, rules, round(emitted / rules * 100, 1) AS percent FROM x")
def emission_report(spark, sf_dir):
    r = emitted_rules(spark, sf_dir)
    return X.emission_report(r, {"dmn": X.emitted(r, X.decision), "bpmn": X.emitted(r, X.process), "cmmn": X.emitted(r, X.case)})


@query("vocabulary", "SELECT DISTINCT p_brand AS id, 'concept' AS part, coalesce(CASE WHEN p_brand LIKE '%1' THEN 'event' WHEN p_brand LIKE '%2' THEN 'mood' END, 'unresolved') AS kind, p_brand NOT LIKE '%1' AS open FROM part WHERE p_brand IS NOT NULL UNION ALL SELECT n_name, 'fact', CASE WHEN n_nationkey % 2 = 0 THEN 'supported' ELSE 'unverified' END, false FROM nation")
def vocabulary(spark, sf_dir):
    b = F.col("p_brand")
    e = table(spark, sf_dir, "part").where("p_brand is not null").select(b.alias("name"), F.lit(None).cast("string").alias("definition"), F.when(b.endswith("1"), "event").when(b.endswith("2"), "mood").alias("kind")).distinct()
    r = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("a").alias("source_entity"), F.lit("b").alias("target_entity"), F.when(F.col("n_nationkey") % 2 == 0, "supported").alias("status"))
    c, f = X.vocabulary(e, r)
    return c.select(F.col("concept_id").alias("id"), F.lit("concept").alias("part"), F.col("concept_kind").alias("kind"), F.col("unresolved").alias("open")).unionByName(f.select(F.col("fact_type_id").alias("id"), F.lit("fact").alias("part"), F.col("grounding_status").alias("kind"), F.lit(False).alias("open")))
