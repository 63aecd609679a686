"""Queries on rule JSON: lowering, symbols, tables, and a policy run from its JSON."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import lowering as L
from .registry import query, table
from .repair_queries import pick

NUMBER = {"name": "Amount", "type": "number", "role": "input", "unit": "usd"}
GRADE = {"name": "grade", "type": "enum", "role": "input", "allowed_values": ["a", "b", "c"]}
DECISION = {"name": "decision", "type": "boolean", "role": "output"}
RULE = {
    "schema_version": "2.0", "rule_id": "@ID", "variables": [NUMBER, GRADE, DECISION], "source_reference": {"chunk_path": "a/b.txt", "section_id": "1", "source_text": "t"},
    "condition_predicates": [{"predicate_id": "p1", "variable": "amount", "operator": ">=", "value": 10, "value_type": "number"}, {"predicate_id": "p2", "variable": "grade", "operator": "in", "value": ["a", "b"], "value_type": "enum"}],
    "condition_logic": {"all": [{"predicate_ref": "p1"}, {"predicate_ref": "p2"}]}, "outcomes": [{"variable": "decision", "operator": "=", "value": True, "value_type": "boolean"}], "recommended_hit_policy": "UNIQUE",
}
#: What each fault replaces in the rule's text, and the code of its refusal.
FAULTS = [
    (None, None, None), ('"predicate_ref": "p2"', '"predicate_ref": "p9"', "UNKNOWN_PREDICATE_REFERENCE"), ('">="', '"like"', "UNSUPPORTED_OPERATOR"), ('"value": 10,', '"value": "ten",', "TYPE_MISMATCH"),
    ('["a", "b", "c"]', "[]", "MISSING_ENUM_DOMAIN"), ('"operator": "="', '"operator": "<="', "UNSUPPORTED_OUTCOME_OPERATOR"), ('"UNIQUE"', '"FIRST"', "UNSUPPORTED_HIT_POLICY"), ('"role": "output"', '"role": "input"', "INVALID_OUTCOME_TARGET"),
    ('"chunk_path"', '"', "INVALID_RULE"), ('["a", "b"]', "[]", "EMPTY_SET"), ('"variable": "amount"', '"variable": "weight"', "UNDEFINED_VARIABLE"), ('"UNIQUE"', '"UNIQUE", "superseded_by": "R1"', "UNREPRESENTABLE_VERSIONING"),
    ('"UNIQUE"', '"UNIQUE", "applicability_scope": {"moods": ["x"]}', "UNREPRESENTABLE_SCOPE"), ('"UNIQUE"', '"ANY", "applicability_scope": {"loan_types": ["x", "y"]}', None), ('"usd"', '"eur"', "SYMBOL_CONFLICT"), ('"name": "decision"', '"name": "verdict"', "INVALID_OUTCOME_TARGET"),
]


def rule_texts(spark, sf_dir):
    """A rule for each part, most with a fault."""
    text, fault = json.dumps(RULE), F.col("p_partkey") % len(FAULTS)
    out = F.lit(text)
    for k, (old, new, _) in enumerate(FAULTS):
        if old:
            assert old in text
            out = F.when(fault == k, text.replace(old, new)).otherwise(out)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.replace(out, F.lit("@ID"), F.concat(F.lit("R"), F.col("p_partkey").cast("string"))).alias("rule"))


CODES = "[" + ", ".join(f"'{c}'" if c else "NULL" for _, _, c in FAULTS) + f"][p_partkey % {len(FAULTS)} + 1]"


@query("rule_lowering", f"SELECT CASE WHEN {CODES} = 'INVALID_RULE' THEN NULL ELSE 'R' || p_partkey END AS rule_id, p_partkey AS ordinal, {CODES} AS code FROM part")
def rule_lowering(spark, sf_dir):
    return L.unified(L.lowered(rule_texts(spark, sf_dir)))[0].select("rule_id", "ordinal", "code")


@query("compilation_report", f"SELECT coalesce({CODES}, 'COMPILED') AS code, count(*) AS rules FROM part GROUP BY ALL")
def compilation_report(spark, sf_dir):
    return L.compile_report(L.unified(L.lowered(rule_texts(spark, sf_dir)))[0])


@query("unified_symbols", "SELECT * FROM (VALUES ('amount', 'real', 'usd', 'input'), ('grade', 'enum', NULL, 'input'), ('decision', 'bool', NULL, 'output'), ('loan_type', 'string', NULL, 'input')) t(id, theory, unit, role)")
def unified_symbols(spark, sf_dir):
    return L.unified(L.lowered(rule_texts(spark, sf_dir)))[1].select("id", "theory", "unit", "role")


@query("table_formation", f"WITH r AS (SELECT 'R' || p_partkey AS id, CASE p_partkey % {len(FAULTS)} WHEN 0 THEN 'UNIQUE' WHEN 13 THEN 'ANY' END AS policy FROM part) SELECT 'table_' || row_number() OVER (ORDER BY policy) AS table_id, 'decision' AS targets, policy, string_agg(id, ',' ORDER BY id) AS rules FROM r WHERE policy IS NOT NULL GROUP BY policy")
def table_formation(spark, sf_dir):
    return L.tables(L.unified(L.lowered(rule_texts(spark, sf_dir)))[0]).select("table_id", "targets", "policy", "rules")


def policy_rule(rule_id, logic, value, scope=None, exceptions=()):
    """One rule of the policy over orders, as JSON has it."""
    variables = [
        {"name": "price", "type": "number", "role": "input"}, {"name": "priority", "type": "enum", "role": "input", "allowed_values": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]},
        {"name": "status", "type": "enum", "role": "input", "allowed_values": ["F", "O", "P"]}, {"name": "review", "type": "enum", "role": "output", "allowed_values": ["senior", "fast", "none"]},
    ]
    predicates = [
        {"predicate_id": "dear", "variable": "price", "operator": ">=", "value": 200000, "value_type": "number"}, {"predicate_id": "pressing", "variable": "priority", "operator": "in", "value": ["1-URGENT", "2-HIGH"], "value_type": "enum"},
        {"predicate_id": "open", "variable": "status", "operator": "==", "value": "O", "value_type": "enum"}, {"predicate_id": "slow", "variable": "priority", "operator": "not_in", "value": ["1-URGENT", "2-HIGH"], "value_type": "enum"},
    ]
    return {
        "schema_version": "2.0", "rule_id": rule_id, "variables": variables, "condition_predicates": predicates, "condition_logic": logic, "outcomes": [{"variable": "review", "operator": "=", "value": value, "value_type": "enum"}],
        "recommended_hit_policy": "ANY", "source_reference": {"chunk_path": "p/1.txt", "section_id": "1", "source_text": "t"}, "applicability_scope": scope or {}, "exceptions": list(exceptions),
    }


ref = lambda i: {"predicate_ref": i}
POLICY = [
    policy_rule("J1", {"all": [ref("dear"), ref("open")]}, "senior"),
    policy_rule("J2", {"any": [{"all": [ref("pressing"), ref("dear")]}, ref("pressing")]}, "fast", exceptions=[{"predicate_id": "x", "variable": "status", "operator": "==", "value": "P", "value_type": "enum"}]),
    policy_rule("J3", {"all": [ref("slow"), ref("dear")]}, "senior", scope={"loan_types": ["F", "P"]}),
]


@query("policy_from_json", """WITH f AS (SELECT o_orderkey, o_totalprice AS price, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS priority, o_orderstatus AS status, CASE WHEN o_orderkey % 9 > 0 THEN o_orderstatus END AS lt FROM orders),
 r AS (SELECT o_orderkey, price >= 200000 AND status = 'O' AS j1, CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN NOT (status = 'P') ELSE priority IN ('1-URGENT', '2-HIGH') END AS j2,
  CASE WHEN (lt IN ('F', 'P')) IS FALSE THEN false WHEN lt IS NULL THEN NULL ELSE NOT (priority IN ('1-URGENT', '2-HIGH')) AND price >= 200000 END AS j3 FROM f),
 d AS (SELECT CASE WHEN j1 IS NULL OR j2 IS NULL OR j3 IS NULL THEN 'unknown' WHEN j2 AND (j1 OR j3) THEN 'conflict' WHEN j1 OR j2 OR j3 THEN 'matched' ELSE 'no_match' END AS s, CASE WHEN j2 THEN 'fast' ELSE 'senior' END AS v FROM r)
 SELECT s AS decision_status, CASE WHEN s = 'matched' THEN v END AS decision, count(*) AS n FROM d GROUP BY ALL""")
def policy_from_json(spark, sf_dir):
    """Rule JSON, lowered, compiled to Columns and run over all orders."""
    rules, sig = L.executable([L.lower(json.loads(json.dumps(r))) for r in POLICY])
    k = F.col("o_orderkey")
    facts = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("price"), F.when(k % 5 > 0, F.col("o_orderpriority")).alias("priority"), F.col("o_orderstatus").alias("status"), F.when(k % 9 > 0, F.col("o_orderstatus")).alias("loan_type"))
    return E.decide(facts, rules, sig, "review", "ANY").groupBy("decision_status", "decision").agg(F.count("*").alias("n"))


@query("rule_diff_statuses", """WITH f AS (SELECT CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS p, o_totalprice AS t, o_orderstatus AS s, CASE WHEN o_orderkey % 9 > 0 THEN o_orderstatus END AS lt FROM orders)
 SELECT CASE WHEN lt IS NULL THEN 'unknown' WHEN lt NOT IN ('F', 'P') THEN 'no_match' WHEN (NOT (p IN ('1-URGENT', '2-HIGH')) AND t >= 200000) IS FALSE THEN 'no_match' WHEN (NOT (p IN ('1-URGENT', '2-HIGH')) AND t >= 200000) THEN 'matched' ELSE 'unknown' END AS status, count(*) AS n FROM f GROUP BY ALL""")
def rule_diff_statuses(spark, sf_dir):
    """As version comparison reads a rule: out of scope is no match."""
    (rule,), sig = L.executable([L.lower(POLICY[2])])
    k = F.col("o_orderkey")
    facts = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("price"), F.when(k % 5 > 0, F.col("o_orderpriority")).alias("priority"), F.col("o_orderstatus").alias("status"), F.when(k % 9 > 0, F.col("o_orderstatus")).alias("loan_type"))
    return facts.groupBy(E.status(rule, sig, "no_match").alias("status")).agg(F.count("*").alias("n"))


@query("table_proofs", "SELECT * FROM (VALUES ('review', 'ANY', 'unknown'), ('seal', 'UNIQUE', 'proved'), ('stamp', 'UNIQUE', 'refused')) t(targets, policy, status)")
def table_proofs(spark, sf_dir):
    """Prices have no end, so their table stays unknown; closed lists are gone through."""
    flags = [{"name": "status", "type": "enum", "role": "input", "allowed_values": ["F", "O", "P"]}, {"name": "stamp", "type": "boolean", "role": "output"}, {"name": "seal", "type": "boolean", "role": "output"}]

    def rule(i, op, value, target):
        p = [{"predicate_id": "p", "variable": "status", "operator": op, "value": value, "value_type": "enum"}]
        return L.lower({"rule_id": i, "variables": flags, "condition_predicates": p, "condition_logic": ref("p"), "outcomes": [{"variable": target, "operator": "=", "value": True, "value_type": "boolean"}], "source_reference": {"chunk_path": "a", "section_id": "1", "source_text": "t"}})

    irs = [*map(L.lower, POLICY), rule("S1", "==", "F", "stamp"), rule("S2", "!=", "O", "stamp"), rule("T1", "==", "F", "seal"), rule("T2", "==", "O", "seal")]
    return spark.createDataFrame([(t, p, s) for (t, p), s in L.proved(spark, irs).items()], "targets string, policy string, status string")


@query("test_vectors", "SELECT p_partkey AS ordinal, p_partkey % 4 IN (0, 1) AS derived FROM part")
def test_vectors(spark, sf_dir):
    logic = pick(['{"all": [{"predicate_ref": "a"}, {"predicate_ref": "b"}]}', '"AND"', '{"any": [{"predicate_ref": "a"}]}', '{"predicate_ref": "c"}'], F.col("p_partkey") % 4)
    head = '{"condition_predicates": [{"predicate_id": "a", "variable": "x", "operator": "==", "value": 1}, {"predicate_id": "b", "variable": "y", "operator": "==", "value": "z"}], "outcomes": [{"variable": "o", "value": true}], "condition_logic": '
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.concat(F.lit(head), logic, F.lit("}")).alias("rule"))

    def run(batches):
        for b in batches:
            yield b.assign(derived=[L.test_vector(json.loads(t)) is not None for t in b["rule"]])[["ordinal", "derived"]]

    return x.mapInPandas(run, "ordinal long, derived boolean")
