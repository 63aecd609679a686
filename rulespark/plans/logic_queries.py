"""Queries on rule evaluation, decision tables, arithmetic and proofs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logic as L
from ..operators import evaluate as E
from ..operators import prove as P
from .registry import query, table

LINE = L.Signature({"l_quantity": "real", "l_discount": "real", "l_returnflag": "enum", "l_linestatus": "enum", "tax": "real", "o_orderpriority": "string"})


def line_rules() -> list[E.Rule]:
    return [
        E.Rule("bulk", L.all_of(L.ge("l_quantity", 30, "real"), L.lt("tax", 0.05, "real")), {"handling": "bulk"}, exceptions=[L.eq("l_returnflag", "R", "enum")]),
        E.Rule("discounted", L.any_of(L.gt("l_discount", 0.07, "real"), L.negate(L.ge("tax", 0.02, "real"))), {"handling": "promo"}, scope=L.ne("l_linestatus", "F", "enum")),
        E.Rule("urgent", L.contains("o_orderpriority", "URGENT", "string"), {"handling": "fast"}, exceptions=[L.lt("l_quantity", 5, "real"), {"op": "is_null", "arg": {"symbol": "tax"}}]),
        E.Rule("range", {"op": "in_binned_range", "left": {"symbol": "l_quantity"}, "right": {"literal": "[10,20)", "type": "string"}}, {"handling": "mid"}),
        E.Rule("missing", L.gt("no_such_fact", 1, "real"), {"handling": "none"}),
        E.Rule("refused", L.gt("l_returnflag", 1, "real"), {"handling": "none"}),
    ]


def facts(spark, sf_dir):
    """Tax is unknown on every seventh order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax")).alias("tax"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return li.join(o, "l_orderkey")


FACTS = "WITH f AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag, l_linestatus, CASE WHEN l_orderkey % 7 <> 0 THEN l_tax END AS tax, o_orderpriority FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def case_of(cond: str, exc: str = "false", scope: str = "true") -> str:
    return f"""CASE WHEN NOT ({scope}) THEN 'out_of_scope' WHEN ({scope}) IS NULL THEN 'unknown' WHEN NOT ({cond}) THEN 'no_match' WHEN ({cond}) IS NULL THEN 'unknown'
      WHEN ({exc}) THEN 'defeated' WHEN ({exc}) IS NULL THEN 'unknown' ELSE 'matched' END"""


RULES_SQL = {
    "bulk": case_of("l_quantity >= 30 AND tax < 0.05", "l_returnflag = 'R'"),
    "discounted": case_of("l_discount > 0.07 OR NOT (tax >= 0.02)", scope="l_linestatus <> 'F'"),
    "urgent": case_of("contains(o_orderpriority, 'URGENT')", "l_quantity < 5 OR tax IS NULL"),
    "range": case_of("l_quantity >= 10 AND l_quantity < 20"),
    "missing": "'unknown'",
}


@query("kleene_rule_eval", FACTS + ", s AS (" + " UNION ALL ".join(f"SELECT '{k}' AS rule_id, {v} AS status FROM f" for k, v in RULES_SQL.items()) + ") SELECT rule_id, status, count(*) AS n FROM s GROUP BY ALL")
def kleene_rule_eval(spark, sf_dir):
    x, _ = E.evaluate(facts(spark, sf_dir), line_rules(), LINE)
    ids = [r.rule_id for r in line_rules() if r.rule_id in x.columns]
    long = x.select(F.explode(F.array(*[F.struct(F.lit(i).alias("rule_id"), F.col(i).alias("status")) for i in ids])).alias("r"))
    return long.groupBy("r.rule_id", "r.status").agg(F.count("*").alias("n"))


@query("rule_refusals", "SELECT * FROM (VALUES ('refused', 'TYPE_MISMATCH', 'enum gt real')) t(rule_id, code, reason)")
def rule_refusals(spark, sf_dir):
    """Lowering refuses a rule as data, not as an error."""
    _, refused = E.evaluate(facts(spark, sf_dir), line_rules(), LINE)
    return spark.createDataFrame(refused, "rule_id string, code string, reason string")


ORDER = L.Signature({"o_totalprice": "real", "o_orderstatus": "enum", "priority": "enum"})


def order_rules(threshold: float = 250000.0) -> list[E.Rule]:
    return [
        E.Rule("A1", L.ge("o_totalprice", threshold, "real"), {"review": "senior"}),
        E.Rule("A2", L.all_of(L.eq("priority", "1-URGENT", "enum"), L.lt("o_totalprice", 300000, "real")), {"review": "fast"}),
        E.Rule("A3", L.all_of(L.eq("o_orderstatus", "O", "enum"), L.ge("o_totalprice", 200000, "real"), L.negate(L.eq("priority", "1-URGENT", "enum"))), {"review": "senior"}),
    ]


def order_facts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"))


def decision_sql(policy: str, t: float = 250000.0) -> str:
    head = f"""WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority, o_totalprice, o_orderstatus FROM orders),
    r AS (SELECT o_orderkey, unnest([{{'id': 'A1', 'v': 'senior', 'm': o_totalprice >= {t}}}, {{'id': 'A2', 'v': 'fast', 'm': priority = '1-URGENT' AND o_totalprice < 300000}},
      {{'id': 'A3', 'v': 'senior', 'm': o_orderstatus = 'O' AND o_totalprice >= 200000 AND NOT (priority = '1-URGENT')}}]) AS x FROM f),
    g AS (SELECT o_orderkey, count(*) FILTER (WHERE x.m) AS n, count(*) FILTER (WHERE x.m IS NULL) AS u, count(DISTINCT x.v) FILTER (WHERE x.m) AS nv,
      min(x.v) FILTER (WHERE x.m) AS v, coalesce(string_agg(x.id, ',' ORDER BY x.id) FILTER (WHERE x.m), '') AS matched FROM r GROUP BY o_orderkey),"""
    if policy == "UNIQUE":
        s = "CASE WHEN n > 1 THEN 'conflict' WHEN u > 0 THEN 'unknown' WHEN n = 1 THEN 'matched' ELSE 'no_match' END"
    else:
        s = "CASE WHEN u > 0 THEN 'unknown' WHEN nv > 1 THEN 'conflict' WHEN nv = 1 THEN 'matched' ELSE 'no_match' END"
    return head + f" d AS (SELECT *, {s} AS decision_status FROM g)"


DECIDED = " SELECT decision_status, CASE WHEN decision_status = 'matched' THEN v END AS decision, matched, count(*) AS n FROM d GROUP BY ALL"


def decided(spark, sf_dir, policy):
    return E.decide(order_facts(spark, sf_dir), order_rules(), ORDER, "review", policy).groupBy("decision_status", "decision", "matched").agg(F.count("*").alias("n"))


@query("decision_table_unique", decision_sql("UNIQUE") + DECIDED)
def decision_table_unique(spark, sf_dir):
    return decided(spark, sf_dir, "UNIQUE")


@query("decision_table_any", decision_sql("ANY") + DECIDED)
def decision_table_any(spark, sf_dir):
    return decided(spark, sf_dir, "ANY")


@query("rule_status_funnel", decision_sql("ANY") + " SELECT c_mktsegment, decision_status, count(*) AS n, sum(CASE WHEN decision_status = 'matched' THEN 1 ELSE 0 END)::BIGINT AS decided FROM d JOIN orders USING (o_orderkey) JOIN customer ON c_custkey = o_custkey GROUP BY ALL")
def rule_status_funnel(spark, sf_dir):
    x = E.decide(order_facts(spark, sf_dir), order_rules(), ORDER, "review", "ANY").select("o_custkey", "decision_status")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return x.join(c, "o_custkey").groupBy("c_mktsegment", "decision_status").agg(F.count("*").alias("n"), F.count_if(F.col("decision_status") == "matched").alias("decided"))


@query("scenario_replay", decision_sql("ANY", 250000.0) + ", a AS (SELECT o_orderkey, decision_status AS os, CASE WHEN decision_status = 'matched' THEN v END AS od FROM d), " + decision_sql("ANY", 180000.0)[5:].replace("f AS (", "f2 AS (", 1).replace("FROM f)", "FROM f2)").replace("r AS (SELECT", "r2 AS (SELECT", 1).replace("FROM r GROUP", "FROM r2 GROUP").replace("g AS (", "g2 AS (", 1).replace("FROM g)", "FROM g2)").replace(" d AS (", " d2 AS (", 1)
       + ", b AS (SELECT o_orderkey, decision_status AS ns, CASE WHEN decision_status = 'matched' THEN v END AS nd FROM d2) SELECT os AS old_status, ns AS new_status, od AS old_decision, nd AS new_decision, (os IS DISTINCT FROM ns OR od IS DISTINCT FROM nd) AS differs, count(*) AS n FROM a JOIN b USING (o_orderkey) GROUP BY ALL")
def scenario_replay(spark, sf_dir):
    """The table before and after its first threshold is lowered."""
    x = E.replay(order_facts(spark, sf_dir), order_rules(), order_rules(180000.0), ORDER, "review")
    return x.groupBy("old_status", "new_status", "old_decision", "new_decision", "differs").agg(F.count("*").alias("n"))


@query("feel_arithmetic", """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) / nullif(l_tax, 0), 6) AS per_tax,
  round(least(l_quantity * 100, l_extendedprice), 6) AS capped, CASE WHEN l_quantity - 25 <> 0 THEN round(l_extendedprice - (l_quantity - 25) * floor(l_extendedprice / (l_quantity - 25)), 6) END AS rest FROM lineitem""")
def feel_arithmetic(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    names = set(li.columns)
    ex = lambda t: F.round(L.arithmetic(t, names), 6)
    return li.select("l_orderkey", "l_linenumber", ex("l_extendedprice multiplied by (1 minus l_discount) divided by l_tax").alias("per_tax"), ex("lesser of(l_quantity * 100, l_extendedprice)").alias("capped"), ex("l_extendedprice % (l_quantity - 25)").alias("rest"))


DOMAINS = [P.Domain("age", "int", (0, 1, 2, 3)), P.Domain("kind", "enum", ("x", "y", "z")), P.Domain("ok", "bool", (False, True)), P.Domain("vip", "bool", (False, True))]
FORMULAS = {
    "P1": L.all_of(L.ge("age", 2, "int"), L.eq("kind", "x", "enum")),
    "P2": L.any_of(L.eq("ok", True, "bool"), L.lt("age", 1, "int")),
    "P3": L.all_of(L.negate(L.eq("kind", "x", "enum")), L.eq("vip", True, "bool")),
}
OUTPUTS = {"P1": "yes", "P2": "no", "P3": "yes"}
PRODUCT = """WITH a AS (SELECT row_number() OVER (ORDER BY a.i, k.i, o.i, v.i) - 1 AS o, a.v AS age, k.v AS kind, o.v AS ok, v.v AS vip,
  concat_ws(',', 'age=' || coalesce(a.v::VARCHAR, 'null'), 'kind=' || coalesce(k.v, 'null'), 'ok=' || coalesce(o.v::VARCHAR, 'null'), 'vip=' || coalesce(v.v::VARCHAR, 'null')) AS w
  FROM (VALUES (0, NULL), (1, 0), (2, 1), (3, 2), (4, 3)) a(i, v), (VALUES (0, NULL), (1, 'x'), (2, 'y'), (3, 'z')) k(i, v), (VALUES (0, NULL), (1, false), (2, true)) o(i, v), (VALUES (0, NULL), (1, false), (2, true)) v(i, v)),
  t AS (SELECT o, w, age >= 2 AND kind = 'x' AS p1, ok = true OR age < 1 AS p2, NOT (kind = 'x') AND vip = true AS p3 FROM a)"""


@query("bounded_sat", PRODUCT + " SELECT q AS question, CASE WHEN min(o) IS NULL THEN 'unsat' ELSE 'sat' END AS status, arg_min(w, o) AS witness FROM (SELECT 'both' AS q UNION ALL SELECT 'never') LEFT JOIN t ON (q = 'both' AND p1 AND p2) OR (q = 'never' AND p1 AND p3) GROUP BY q")
def bounded_sat(spark, sf_dir):
    ask = {"both": L.all_of(FORMULAS["P1"], FORMULAS["P2"]), "never": L.all_of(FORMULAS["P1"], FORMULAS["P3"])}
    a, b = (P.satisfiable(spark, f, DOMAINS).withColumn("question", F.lit(q)) for q, f in ask.items())
    return a.unionByName(b).select("question", "status", "witness")


@query("prover_limits", "SELECT * FROM (VALUES ('timeout', NULL), ('unknown', NULL)) t(status, witness)")
def prover_limits(spark, sf_dir):
    big = [P.Domain(f"s{k}", "int", tuple(range(50))) for k in range(3)]
    return P.satisfiable(spark, L.gt("s0", 1, "int"), big).unionByName(P.satisfiable(spark, L.gt("x", 1, "real"), [P.Domain("x", "real", None)]))


PAIR_SQL = PRODUCT + """, h AS (SELECT o, w, 'P1' AS id, 'yes' AS out FROM t WHERE p1 UNION ALL SELECT o, w, 'P2', 'no' FROM t WHERE p2 UNION ALL SELECT o, w, 'P3', 'yes' FROM t WHERE p3),
  pairs AS (SELECT x.id AS rule_a, y.id AS rule_b, arg_min(x.w, x.o) AS witness, count(*) AS assignments, bool_or(x.out <> y.out) AS conflict FROM h x JOIN h y ON x.o = y.o AND x.id < y.id GROUP BY ALL)"""


@query("rule_overlap", PAIR_SQL + " SELECT * FROM pairs")
def rule_overlap(spark, sf_dir):
    return P.overlaps(spark, FORMULAS, OUTPUTS, DOMAINS)


@query("hit_policy_proof", PAIR_SQL + """ SELECT p AS policy, CASE WHEN p = 'COLLECT' THEN 'unknown' WHEN p = 'PRIORITY' OR n > 0 THEN 'refused' ELSE 'proved' END AS status, n AS offending FROM (
  SELECT 'UNIQUE' AS p, count(*) AS n FROM pairs UNION ALL SELECT 'ANY', count(*) FILTER (WHERE conflict) FROM pairs UNION ALL SELECT 'COLLECT', 0 UNION ALL SELECT 'PRIORITY', 0)""")
def hit_policy_proof(spark, sf_dir):
    pairs = P.overlaps(spark, FORMULAS, OUTPUTS, DOMAINS)
    a, b, c, d = (P.hit_policy(pairs, p) for p in ("UNIQUE", "ANY", "COLLECT", "PRIORITY"))
    return a.unionByName(b).unionByName(c).unionByName(d)


@query("coverage_gap", PRODUCT + ", f AS (SELECT o, w, p1 OR p2 OR p3 AS f FROM t) SELECT CASE WHEN count(*) FILTER (WHERE NOT f) > 0 THEN 'counterexample' WHEN count(*) FILTER (WHERE f IS NULL) > 0 THEN 'unknown' ELSE 'proved' END AS status, arg_min(w, o) FILTER (WHERE NOT f) AS witness FROM f")
def coverage_gap(spark, sf_dir):
    return P.coverage(spark, FORMULAS, DOMAINS)
