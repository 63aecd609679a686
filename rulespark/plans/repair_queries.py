"""Queries on the repairs of extracted rules; rules, their items and their faults are derived from parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import repair as R
from .registry import query, table


def pick(values: list, at):
    """The value at a place counted from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


#: Predicates of the rules: one to four each, with missing and repeated ids.
PREDS = """p AS (SELECT p_partkey AS rule_id, pos::INTEGER AS pos, CASE WHEN (p_partkey + pos) % 5 = 0 THEN NULL WHEN (p_partkey + pos) % 7 = 0 THEN 'p1' ELSE 'q' || pos END AS predicate_id,
 ['Loan_Amount', 'term', 'State', 'ltv'][(p_partkey + 3 * pos) % 4 + 1] AS variable, ['==', '>=', 'in', '<='][(p_size + pos) % 4 + 1] AS operator, ['true', '12.5', '["a"]', '"2024-01-01"', '"x"'][(p_size + pos) % 5 + 1] AS value,
 CASE WHEN p_size % 3 = 0 THEN 'text' WHEN p_size % 3 = 1 THEN 'date' END AS declared FROM part, range(0, 4) t(pos) WHERE pos <= p_partkey % 4)"""


def predicates(spark, sf_dir):
    k, s, i = F.col("p_partkey"), F.col("p_size"), F.col("pos")
    x = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), (k % 4).cast("int"))).alias("pos"))
    return x.select(
        k.alias("rule_id"), "pos", F.when((k + i) % 5 == 0, None).when((k + i) % 7 == 0, "p1").otherwise(F.concat(F.lit("q"), i.cast("string"))).alias("predicate_id"),
        pick(["Loan_Amount", "term", "State", "ltv"], (k + 3 * i) % 4).alias("variable"), pick(["==", ">=", "in", "<="], (s + i) % 4).alias("operator"), pick(["true", "12.5", '["a"]', '"2024-01-01"', '"x"'], (s + i) % 5).alias("value"),
        F.when(s % 3 == 0, "text").when(s % 3 == 1, "date").alias("declared"),
    )


#: Variables of the rules: three each, some of the same name but for case, some without a role.
VARIABLES = """v AS (SELECT p_partkey AS rule_id, pos::INTEGER AS pos, ['loan_amount', 'LOAN AMOUNT', 'Term', 'rate'][(p_size + pos * (1 + p_partkey % 2)) % 4 + 1] AS name, [NULL, 'input', 'output', 'odd'][(p_partkey + pos) % 4 + 1] AS role,
 CASE WHEN (p_size + pos) % 3 = 0 THEN 'usd' END AS unit, CASE WHEN (p_size + pos) % 2 = 0 THEN '' ELSE 'number' END AS type FROM part, range(0, 3) t(pos))"""


def variables(spark, sf_dir):
    k, s, i = F.col("p_partkey"), F.col("p_size"), F.col("pos")
    x = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos"))
    return x.select(
        k.alias("rule_id"), "pos", pick(["loan_amount", "LOAN AMOUNT", "Term", "rate"], (s + i * (1 + k % 2)) % 4).alias("name"), pick([None, "input", "output", "odd"], (k + i) % 4).alias("role"),
        F.when((s + i) % 3 == 0, "usd").alias("unit"), F.when((s + i) % 2 == 0, "").otherwise("number").alias("type"),
    )


#: Outcomes of the rules: one each, some on a variable that predicates test.
OUTCOMES = """o AS (SELECT p_partkey AS rule_id, ['decision', 'TERM', 'rate'][p_partkey % 3 + 1] AS variable, ['=', '=', 'assign', '<='][p_size % 4 + 1] AS operator, ['"yes"', '["a"]', 'true'][p_size % 3 + 1] AS value FROM part)"""


def outcomes(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(k.alias("rule_id"), pick(["decision", "TERM", "rate"], k % 3).alias("variable"), pick(["=", "=", "assign", "<="], s % 4).alias("operator"), pick(['"yes"', '["a"]', "true"], s % 3).alias("value"))


@query("party_unwrap", """WITH x AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '{"entity_type": "' || o_orderpriority || '", "role": "a"}' WHEN 1 THEN '{"entity": "E' || o_orderstatus || '"}' WHEN 2 THEN '{"name_ref": " N "}' WHEN 3 THEN ' ' || o_orderpriority END AS p FROM orders)
 SELECT o_orderkey, CASE WHEN p LIKE '{%' THEN coalesce(nullif(trim(p ->> '$.entity_type'), ''), nullif(trim(p ->> '$.entity'), ''), nullif(trim(p ->> '$.name_ref'), '')) ELSE nullif(trim(p), '') END AS party FROM x""")
def party_unwrap(spark, sf_dir):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    raw = F.when(k % 5 == 0, F.concat(F.lit('{"entity_type": "'), p, F.lit('", "role": "a"}'))).when(k % 5 == 1, F.concat(F.lit('{"entity": "E'), "o_orderstatus", F.lit('"}'))).when(k % 5 == 2, '{"name_ref": " N "}').when(k % 5 == 3, F.concat(F.lit(" "), p))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.unwrap_party(raw).alias("party"))


KINDS = [("1-urgent", "actor_role"), ("2-HIGH ", "business_object"), ("3-MEDIUM", "process"), ("5-LOW", None)]


@query("counterparty_quarantine", """SELECT o_orderkey, o_orderpriority AS party, o_orderpriority NOT IN ('2-HIGH', '3-MEDIUM') AS kept, CASE o_orderpriority WHEN '2-HIGH' THEN 'concept_kind business_object cannot bear a party role' WHEN '3-MEDIUM' THEN 'concept_kind process cannot bear a party role' END AS reason FROM orders""")
def counterparty_quarantine(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("party"))
    return R.quarantine_parties(x, spark.createDataFrame(KINDS, "name string, kind string"))


@query("unconditional_sources", """WITH x AS (SELECT doc_id, ['A lender must keep this. ', 'If late, a lender shall pay. ', 'It requires care: ', 'Musty rooms. '][doc_id % 4 + 1] || left(text, 40) AS t FROM documents)
 SELECT doc_id, coalesce(regexp_matches(t, '(?i)(^|[^\\p{L}\\p{N}_])(must|shall|is\\s+required\\s+to|are\\s+required\\s+to|requires?)($|[^\\p{L}\\p{N}_])') AND NOT regexp_matches(t, '(?i)(^|[^\\p{L}\\p{N}_])(if|when|whenever|unless|provided\\s+that|only\\s+if|in\\s+the\\s+event\\s+that)($|[^\\p{L}\\p{N}_])'), false) AS unconditional FROM x""")
def unconditional_sources(spark, sf_dir):
    t = F.concat(pick(["A lender must keep this. ", "If late, a lender shall pay. ", "It requires care: ", "Musty rooms. "], F.col("doc_id") % 4), F.left("text", F.lit(40)))
    return table(spark, sf_dir, "documents").select("doc_id", R.unconditional_source(t).alias("unconditional"))


@query("empty_rules", "SELECT p_partkey, p_size % 4 = 0 AND p_partkey % 3 = 0 AS unusable FROM part")
def empty_rules(spark, sf_dir):
    s, k = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", R.unusable([F.when(s % 4 == 0, " ").otherwise(F.col("p_name")), F.lit(None).cast("string")], [F.when(k % 3 != 0, k % 3), F.lit(0)]).alias("unusable"))


@query("literal_types", "WITH " + PREDS + """ SELECT rule_id, pos, CASE WHEN value = 'true' THEN 'boolean' WHEN value = '12.5' THEN 'number' WHEN value LIKE '[%' THEN 'list' WHEN declared = 'text' THEN 'string' WHEN declared = 'date' THEN 'date' WHEN operator = 'in' THEN 'enum' ELSE 'string' END AS value_type FROM p""")
def literal_types(spark, sf_dir):
    return predicates(spark, sf_dir).select("rule_id", "pos", R.literal_type(F.col("value"), F.col("declared"), F.col("operator")).alias("value_type"))


ENTITIES = """e AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_type ELSE upper(left(p_type, 1)) || lower(substr(p_type, 2)) || 'Part' END AS name FROM part), f AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN lower(p_type) WHEN p_size % 3 = 1 THEN p_type ELSE lower(p_type) || ' goods' END AS name FROM part)"""
SNAKE = "upper(regexp_replace(regexp_replace(regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g'), '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))"


@query("entity_name_map", "WITH " + ENTITIES + f""", k AS (SELECT name, {SNAKE} AS canonical, regexp_full_match(name, '[A-Z][A-Z0-9]*(_[A-Z0-9]+)*') AS fine FROM e), r AS (SELECT name, {SNAKE} AS canonical FROM f WHERE NOT regexp_full_match(name, '[A-Z][A-Z0-9]*(_[A-Z0-9]+)*'))
 SELECT name, canonical FROM k WHERE NOT fine AND name <> canonical UNION SELECT name, canonical FROM r WHERE canonical IN (SELECT CASE WHEN fine THEN name ELSE canonical END FROM k)""")
def entity_name_map(spark, sf_dir):
    p, t, s = table(spark, sf_dir, "part"), F.col("p_type"), F.col("p_size")
    e = p.select(F.when(s % 2 == 0, t).otherwise(F.concat(F.initcap(F.lower(t)), F.lit("Part"))).alias("name"))
    r = p.select(F.when(s % 3 == 0, F.lower(t)).when(s % 3 == 1, t).otherwise(F.concat(F.lower(t), F.lit(" goods"))).alias("name"))
    return R.entity_names(e, r)


@query("rename_collisions", """WITH d AS (SELECT DISTINCT p_brand AS name, p_size % 2 = 0 AS ph FROM part WHERE p_brand IS NOT NULL), x AS (SELECT CASE WHEN name IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'BRAND' ELSE name END AS canonical, ph FROM d)
 SELECT canonical, count(*) AS n, count(*) FILTER (WHERE NOT ph) <= 1 AS merges FROM x GROUP BY canonical HAVING count(*) > 1""")
def rename_collisions(spark, sf_dir):
    d = table(spark, sf_dir, "part").where("p_brand is not null").select(F.col("p_brand").alias("name"), (F.col("p_size") % 2 == 0).alias("placeholder")).distinct()
    return R.collisions(d, spark.createDataFrame([(f"Brand#{k}", "BRAND") for k in (1, 2, 3)], "name string, canonical string"))


@query("unresolved_basis", """WITH x AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'explicit' WHEN 1 THEN 'inferred' WHEN 2 THEN 'free words ' || o_orderstatus END AS b, CASE WHEN o_orderkey % 3 = 0 THEN 'noted' WHEN o_orderkey % 3 = 1 THEN ' ' END AS r FROM orders)
 SELECT o_orderkey, CASE WHEN b IN ('explicit', 'inferred') THEN b ELSE 'unresolved' END AS basis, CASE WHEN b IN ('explicit', 'inferred') THEN r ELSE coalesce(nullif(trim(r), ''), b, 'No valid scope_basis was produced by extraction or evidence completion.') END AS reason FROM x""")
def unresolved_basis(spark, sf_dir):
    k = F.col("o_orderkey")
    b = F.when(k % 4 == 0, "explicit").when(k % 4 == 1, "inferred").when(k % 4 == 2, F.concat(F.lit("free words "), "o_orderstatus"))
    x = table(spark, sf_dir, "orders").select("o_orderkey", R.coerce_basis(b, F.when(k % 3 == 0, "noted").when(k % 3 == 1, " "), ["explicit", "inferred"], "unresolved", "scope_basis").alias("x"))
    return x.select("o_orderkey", "x.basis", "x.reason")


@query("compact_aliases", "WITH " + PREDS + ", " + VARIABLES + """, c AS (SELECT DISTINCT rule_id, name, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS c FROM v), u AS (SELECT rule_id, c, min(name) AS name FROM c GROUP BY ALL HAVING count(*) = 1)
 SELECT p.rule_id, p.pos, p.variable, coalesce(u.name, p.variable) AS resolved FROM p LEFT JOIN u ON u.rule_id = p.rule_id AND u.c = regexp_replace(lower(p.variable), '[^a-z0-9]+', '', 'g')""")
def compact_aliases(spark, sf_dir):
    return R.resolve_references(predicates(spark, sf_dir).select("rule_id", "pos", "variable"), variables(spark, sf_dir))


@query("canonical_fact_ids", "WITH " + VARIABLES + """, b AS (SELECT rule_id, pos, regexp_replace(lower(trim(CASE WHEN unit = 'usd' THEN 'amount_usd' ELSE name END)), '[^a-z0-9]+', '_', 'g') AS b FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY rule_id, b ORDER BY pos) AS k FROM b)
 SELECT rule_id, pos, b || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS canonical FROM r""")
def canonical_fact_ids(spark, sf_dir):
    v = variables(spark, sf_dir).withColumn("fact_id", F.when(F.col("unit") == "usd", "amount_usd").otherwise("No Id!"))
    return R.canonical_fact_ids(v).select("rule_id", "pos", "canonical")


@query("predicate_ids", "WITH " + PREDS + """, u AS (SELECT rule_id, list(DISTINCT predicate_id) FILTER (WHERE predicate_id IS NOT NULL) AS used FROM p GROUP BY rule_id), n AS (SELECT p.*, coalesce(used, []) AS used, row_number() OVER (PARTITION BY p.rule_id, predicate_id IS NULL ORDER BY pos) AS k FROM p JOIN u USING (rule_id))
 SELECT rule_id, pos, coalesce(predicate_id, list_filter(list_transform(range(1, 9), lambda i: 'p' || i), lambda x: NOT list_contains(used, x))[k]) AS predicate_id FROM n""")
def predicate_ids(spark, sf_dir):
    return R.predicate_ids(predicates(spark, sf_dir).select("rule_id", "pos", "predicate_id"))


@query("positional_references", "WITH " + PREDS + """, n AS (SELECT rule_id, predicate_id, row_number() OVER (PARTITION BY rule_id ORDER BY pos) AS n FROM p), r AS (SELECT p_partkey AS rule_id, ['p1', 'p2', 'q1', 'p9'][p_size % 4 + 1] AS ref FROM part)
 SELECT r.rule_id, r.ref, coalesce((SELECT min(predicate_id) FROM n WHERE n.rule_id = r.rule_id AND n.predicate_id = r.ref), (SELECT min(predicate_id) FROM n WHERE n.rule_id = r.rule_id AND 'p' || n.n = r.ref)) AS resolved FROM r""")
def positional_references(spark, sf_dir):
    refs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), pick(["p1", "p2", "q1", "p9"], F.col("p_size") % 4).alias("ref"))
    return R.positional_references(refs, predicates(spark, sf_dir)).select("rule_id", "ref", "resolved")


@query("restored_operators", "WITH " + OUTCOMES + ", b AS (SELECT p_partkey AS rule_id, ['>=', '='][p_partkey % 2 + 1] AS op FROM part WHERE p_partkey % 5 <> 0) SELECT rule_id, variable, o.operator IN ('=', 'assign') AND b.op IS NOT NULL AS restored, CASE WHEN o.operator IN ('=', 'assign') AND b.op IS NOT NULL THEN b.op ELSE o.operator END AS operator FROM o LEFT JOIN (SELECT * FROM b WHERE op = '>=') b USING (rule_id)")
def restored_operators(spark, sf_dir):
    o = outcomes(spark, sf_dir).select("rule_id", "variable", "operator")
    return R.restore_operators(o, o.where("rule_id % 5 <> 0").withColumn("operator", pick([">=", "="], F.col("rule_id") % 2)))


@query("flat_exceptions", """WITH f AS (SELECT p_partkey AS rule_id, 0 AS pos, 'e1' AS id, 'state' AS variable FROM part UNION ALL SELECT p_partkey, 1, 'e1', 'term' FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 2, CASE WHEN p_size % 3 = 0 THEN 'e1' ELSE 'x' END, 'ltv' FROM part WHERE p_size % 2 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY rule_id, id ORDER BY pos) AS k FROM f) SELECT rule_id, pos, id || CASE WHEN k > 1 THEN '_copy_' || k ELSE '' END AS predicate_id, variable FROM r""")
def flat_exceptions(spark, sf_dir):
    """One plain exception, and on every other rule a nested one whose parts may lack ids."""
    s, text = F.col("p_size"), F.lit(None).cast("string")
    part = lambda i, v: F.struct(i.alias("id"), F.lit(v).alias("variable"))
    none = F.array().cast("array<struct<id:string,variable:string>>")
    plain = F.struct(F.lit("e1").alias("id"), F.lit("state").alias("variable"), none.alias("parts"))
    nested = F.struct(F.lit("e1").alias("id"), text.alias("variable"), F.array(part(text, "term"), part(F.when(s % 3 != 0, "x"), "ltv")).alias("parts"))
    rules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), F.when(s % 2 == 0, F.array(plain, nested)).otherwise(F.array(plain)).alias("exceptions"))
    return R.exception_ids(R.flatten_exceptions(rules, "exceptions")).select("rule_id", "pos", "predicate_id", "variable")


@query("exception_effects", "WITH " + PREDS + ", " + OUTCOMES + " SELECT p.rule_id, p.pos, CASE WHEN lower(o.variable) = lower(p.variable) THEN 'effect' ELSE 'condition' END AS part FROM p JOIN o USING (rule_id)")
def exception_effects(spark, sf_dir):
    conditions, effects = R.split_exceptions(predicates(spark, sf_dir).select("rule_id", "pos", "variable"), outcomes(spark, sf_dir))
    return conditions.withColumn("part", F.lit("condition")).unionByName(effects.withColumn("part", F.lit("effect"))).select("rule_id", "pos", "part")


@query("undeclared_variables", "WITH " + PREDS + ", " + VARIABLES + """, m AS (SELECT p.*, row_number() OVER (PARTITION BY rule_id, lower(variable) ORDER BY pos) AS k FROM p WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.rule_id = p.rule_id AND lower(trim(v.name)) = lower(p.variable)))
 SELECT rule_id, variable AS name, CASE WHEN value = 'true' THEN 'boolean' WHEN value = '12.5' THEN 'number' WHEN value LIKE '[%' THEN 'list' WHEN operator = 'in' THEN 'enum' ELSE 'string' END AS type, 'input' AS role FROM m WHERE k = 1""")
def undeclared_variables(spark, sf_dir):
    return R.undeclared(predicates(spark, sf_dir), variables(spark, sf_dir))


@query("repaired_roles", "WITH " + PREDS + ", " + VARIABLES + ", " + OUTCOMES + """ SELECT rule_id, pos, CASE WHEN role IN ('input', 'output') THEN role WHEN lower(name) IN (SELECT lower(o.variable) FROM o WHERE o.rule_id = v.rule_id) AND lower(name) NOT IN (SELECT lower(p.variable) FROM p WHERE p.rule_id = v.rule_id) THEN 'output'
 WHEN lower(name) IN (SELECT lower(p.variable) FROM p WHERE p.rule_id = v.rule_id) AND lower(name) NOT IN (SELECT lower(o.variable) FROM o WHERE o.rule_id = v.rule_id) THEN 'input' ELSE 'derived' END AS role FROM v""")
def repaired_roles(spark, sf_dir):
    return R.repair_roles(variables(spark, sf_dir), outcomes(spark, sf_dir), predicates(spark, sf_dir)).select("rule_id", "pos", "role")


@query("merged_variables", "WITH " + VARIABLES + """ SELECT rule_id, min(pos) AS pos, arg_min(name, pos) AS name, CASE WHEN bool_or(coalesce(role = 'output', false)) THEN 'output' WHEN count(*) > 1 AND bool_or(coalesce(role = 'input', false)) THEN 'input' ELSE arg_min(role, pos) FILTER (WHERE role IS NOT NULL) END AS role,
 arg_min(unit, pos) FILTER (WHERE unit IS NOT NULL) AS unit, arg_min(type, pos) FILTER (WHERE type <> '') AS type, count(*) AS declared FROM v GROUP BY rule_id, lower(name)""")
def merged_variables(spark, sf_dir):
    return R.merge_variables(variables(spark, sf_dir), ["unit", "type"])


@query("evidence_pointers", """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE source END AS a, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE ' s' || doc_id % 9 END AS b, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE left(text, 20) END AS c, CASE WHEN doc_id % 6 = 0 THEN 'quoted' END AS q FROM documents),
 y AS (SELECT *, coalesce(c, q) AS t FROM x) SELECT doc_id, CASE WHEN trim(a) <> '' AND trim(b) <> '' AND trim(t) <> '' THEN trim(a) || '#' || trim(b) || '#' || length(trim(t)) END AS pointer FROM y""")
def evidence_pointers(spark, sf_dir):
    k = F.col("doc_id")
    p = R.evidence_pointer(F.when(k % 5 == 0, " ").otherwise(F.col("source")), F.when(k % 7 != 0, F.concat(F.lit(" s"), (k % 9).cast("string"))), F.when(k % 3 != 0, F.left("text", F.lit(20))), F.when(k % 6 == 0, "quoted"))
    x = table(spark, sf_dir, "documents").select("doc_id", p.alias("p"))
    return x.select("doc_id", F.when(F.col("p").isNotNull(), F.concat_ws("#", "p.chunk_path", "p.section_id", F.length("p.source_text").cast("string"))).alias("pointer"))


@query("evidence_backfill", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'f' END, CASE WHEN o_orderkey % 2 = 0 THEN 'e' END, o_orderstatus) AS scope, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 WHEN o_orderkey % 6 > 0 THEN o_orderkey % 6 END AS best FROM orders")
def evidence_backfill(spark, sf_dir):
    k = F.col("o_orderkey")
    some = lambda n: F.sequence(F.lit(1), n.cast("int"))
    lists = lambda n: F.when(n > 0, some(n)).otherwise(F.array().cast("array<int>"))
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 == 0, "f").alias("scope"), F.when(k % 2 == 0, "e").alias("exceptions"), F.col("o_orderstatus").alias("source"), F.size(R.best_evidence(lists(k % 4), lists(k % 6))).cast("long").alias("best"))
    return R.backfill(x, ["scope"], ["exceptions", "source"]).select("o_orderkey", "scope", F.when(F.col("best") > 0, F.col("best")).alias("best"))


@query("synced_evidence", """WITH r AS (SELECT doc_id % 50 AS rule_id, lang AS field, CASE WHEN doc_id % 11 = 0 THEN '' ELSE source END AS path, 's' || doc_id % 3 AS section, 't' || doc_id % 2 AS t, doc_id % 4 <> 0 AS verified FROM documents WHERE lang IS NOT NULL), u AS (SELECT DISTINCT rule_id, field, path, section, t FROM r WHERE verified AND path <> '')
 SELECT rule_id, field, count(*) AS records, min(path) AS first_path FROM u GROUP BY ALL""")
def synced_evidence(spark, sf_dir):
    k, text = F.col("doc_id"), lambda p, n: F.concat(F.lit(p), (F.col("doc_id") % n).cast("string"))
    r = table(spark, sf_dir, "documents").where("lang is not null").select((k % 50).alias("rule_id"), F.col("lang").alias("field"), F.when(k % 11 == 0, "").otherwise(F.col("source")).alias("chunk_path"), text("s", 3).alias("section_id"), text("t", 2).alias("source_text"), (k % 4 != 0).alias("verified"))
    return R.sync_evidence(r)


@query("evidence_states", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 IN (0, 1) AND o_orderkey % 5 <> 0 AND o_orderpriority <> '1-URGENT' THEN 'no_exception_cue_found_in_complete_search' ELSE ['explicit_in_source', 'unresolved_after_full_document_search', 'explicitly_none_in_source', 'other'][o_orderkey % 4 + 1] END AS exception_basis,
 CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 THEN 'explicit_in_source' WHEN o_orderkey % 2 = 0 THEN 'inferred' ELSE 'genuinely_unscoped' END AS scope_basis FROM orders""")
def evidence_states(spark, sf_dir):
    k = F.col("o_orderkey")
    basis = pick(["explicit_in_source", "unresolved_after_full_document_search", "explicitly_none_in_source", "other"], k % 4)
    text = F.when(F.col("o_orderpriority") == "1-URGENT", "Fees, UNLESS waived").otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.evidence_state(basis, k % 3, k % 5 != 0, text).alias("exception_basis"), R.scope_state(F.when(k % 2 == 0, "inferred").otherwise("genuinely_unscoped"), k % 3, k % 5).alias("scope_basis"))


@query("rule_patches", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'patched' ELSE p_brand END AS p_brand, p_type, CASE WHEN p_partkey % 3 = 0 AND p_size % 2 = 0 THEN -p_size ELSE p_size END AS p_size FROM part")
def rule_patches(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    patches = p.where("p_partkey % 3 = 0").select("p_partkey", F.lit("patched").alias("p_brand"), F.lit("never").alias("p_type"), F.when(F.col("p_size") % 2 == 0, -F.col("p_size")).alias("p_size"))
    return R.patched(p, patches, "p_partkey", ["p_brand", "p_size"])


@query("list_outputs", "WITH " + OUTCOMES + ", l AS (SELECT DISTINCT variable FROM o WHERE value LIKE '[%') SELECT rule_id, variable, CASE WHEN variable IN (SELECT variable FROM l) AND value NOT LIKE '[%' THEN '[' || value || ']' ELSE value END AS value, CASE WHEN variable IN (SELECT variable FROM l) THEN 'list' ELSE 'string' END AS value_type, CASE WHEN variable IN (SELECT variable FROM l) THEN 'COLLECT' ELSE 'UNIQUE' END AS hit_policy FROM o")
def list_outputs(spark, sf_dir):
    o = outcomes(spark, sf_dir).select("rule_id", "variable", "value", F.lit("string").alias("value_type"), F.lit("UNIQUE").alias("hit_policy"))
    return R.list_outputs(o)


@query("malformed_candidates", """WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN 'no json' WHEN 2 THEN '[1]' END AS raw FROM events) SELECT event_id, CASE WHEN event_id % 4 = 0 THEN (raw ->> '$.k')::BIGINT END AS k, event_id % 4 <> 0 AS requires_review, CASE WHEN event_id % 4 <> 0 THEN raw END AS raw FROM x""")
def malformed_candidates(spark, sf_dir):
    k = F.col("event_id")
    raw = F.when(k % 4 == 0, F.col("props")).when(k % 4 == 1, "no json").when(k % 4 == 2, "[1]")
    x = table(spark, sf_dir, "events").select("event_id", R.checked_candidates(raw, "k long").alias("c"))
    return x.select("event_id", F.col("c.rule.k").alias("k"), "c.requires_review", "c.raw")
