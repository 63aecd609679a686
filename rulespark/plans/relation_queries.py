"""Queries on relations between rules and on the graphs they form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import relations as R
from .registry import query, table
from .rulebase import BINDINGS, EDGES, RESIDUAL, bindings, edges, nodes

PAIR = "SELECT x.rule_id AS source, y.rule_id AS target, '{kind}' AS kind, {directed} AS directed, string_agg(DISTINCT x.fact, ',' ORDER BY x.fact) AS symbols, count(DISTINCT x.fact) AS strength FROM {x} x JOIN {y} y ON x.fact = y.fact AND x.rule_id {cmp} y.rule_id AND x.role = '{rx}' AND y.role = '{ry}' WHERE {residual} GROUP BY ALL"


def pair(kind, directed, cmp, rx, ry, x="b", y="b"):
    return PAIR.format(kind=kind, directed=directed, cmp=cmp, rx=rx, ry=ry, x=x, y=y, residual=RESIDUAL)


@query("dataflow_edges", BINDINGS + pair("dataflow", "true", "<>", "write", "read"))
def dataflow_edges(spark, sf_dir):
    return R.dataflow(bindings(spark, sf_dir))


@query("conflict_candidates", BINDINGS + pair("conflict", "false", "<", "write", "write"))
def conflict_candidates(spark, sf_dir):
    return R.conflicts(bindings(spark, sf_dir))


@query("association_shared_input", BINDINGS + ", r AS (SELECT * FROM b WHERE role = 'read' AND fact NOT IN (SELECT fact FROM b WHERE role = 'write' AND right(fact, 1) <> '3')), k AS (SELECT fact FROM r GROUP BY fact HAVING count(DISTINCT rule_id) <= 20), c AS (SELECT * FROM r WHERE fact IN (SELECT fact FROM k))" + pair("shared_input", "false", "<", "read", "read", "c", "c"))
def association_shared_input(spark, sf_dir):
    """Facts whose number ends in 3 lose their writers, so their readers are associated."""
    b = bindings(spark, sf_dir).where("role = 'read' OR right(fact, 1) <> '3'")
    return R.shared_inputs(b)


@query("association_shared_passage", "WITH p AS (SELECT DISTINCT 'R' || p_partkey AS rule_id, p_brand || '#' || p_size || p_type AS fact FROM part), k AS (SELECT fact FROM p GROUP BY fact HAVING count(*) <= 120), c AS (SELECT * FROM p WHERE fact IN (SELECT fact FROM k)) SELECT x.rule_id AS source, y.rule_id AS target, 'shared_passage' AS kind, false AS directed, string_agg(DISTINCT x.fact, ',' ORDER BY x.fact) AS symbols, count(DISTINCT x.fact) AS strength FROM c x JOIN c y ON x.fact = y.fact AND x.rule_id < y.rule_id GROUP BY ALL")
def association_shared_passage(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("rule_id"), F.col("p_brand").alias("chunk_path"), F.concat(F.col("p_size").cast("string"), "p_type").alias("section_id"))
    return R.shared_passages(p)


@query("fact_registry", BINDINGS + """ SELECT fact, coalesce(string_agg(DISTINCT type, ',' ORDER BY type), '') AS types, coalesce(string_agg(DISTINCT unit, ',' ORDER BY unit), '') AS units,
  count(DISTINCT rule_id) FILTER (WHERE role = 'write') AS producers, count(DISTINCT rule_id) FILTER (WHERE role = 'read') AS consumers,
  concat_ws(',', CASE WHEN count(DISTINCT type) > 1 AND count(DISTINCT type) FILTER (WHERE type NOT IN ('integer', 'number')) > 0 THEN 'type_conflict' END, CASE WHEN count(DISTINCT unit) > 1 THEN 'unit_conflict' END) AS issues FROM b GROUP BY fact""")
def fact_registry(spark, sf_dir):
    return R.fact_registry(bindings(spark, sf_dir))


FLOW = pair("dataflow", "true", "<>", "write", "read")


@query("relation_revalidation", BINDINGS + f", f AS ({FLOW}), s AS (SELECT 'R' || p_partkey AS source, 'R' || (p_partkey + p_size % 12) AS target, CASE WHEN p_size % 3 = 0 THEN 'gating' ELSE 'dataflow' END AS kind FROM part) SELECT s.source, s.target, 'dataflow' AS kind, CASE WHEN f.source IS NULL THEN 'dropped' WHEN s.kind = 'gating' THEN 'downgraded' ELSE 'kept' END AS status FROM s LEFT JOIN f USING (source, target)")
def relation_revalidation(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rule = lambda c: F.concat(F.lit("R"), c.cast("string"))
    stored = p.select(rule(F.col("p_partkey")).alias("source"), rule(F.col("p_partkey") + F.col("p_size") % 12).alias("target"), F.when(F.col("p_size") % 3 == 0, "gating").otherwise("dataflow").alias("kind"))
    return R.revalidated(stored, bindings(spark, sf_dir))


@query("dangling_refs", "SELECT l_partkey AS ref, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <> 7) GROUP BY ALL")
def dangling_refs(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ref"))
    return R.dangling(refs, table(spark, sf_dir, "part").where("p_size <> 7"), "ref", "p_partkey").groupBy("ref").agg(F.count("*").alias("n"))


@query("referential_integrity", """SELECT 'lineitem.part' AS path, count(*) AS missing FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <> 7)
  UNION ALL SELECT 'orders.customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3) UNION ALL SELECT 'supplier.nation', count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)""")
def referential_integrity(spark, sf_dir):
    def miss(path, child, col, parent, key, where="true"):
        return table(spark, sf_dir, child).join(table(spark, sf_dir, parent).where(where), F.col(col) == F.col(key), "left_anti").agg(F.count("*").alias("missing")).select(F.lit(path).alias("path"), "missing")

    return miss("lineitem.part", "lineitem", "l_partkey", "part", "p_partkey", "p_size <> 7").unionByName(miss("orders.customer", "orders", "o_custkey", "customer", "c_custkey", "c_nationkey <> 3")).unionByName(miss("supplier.nation", "supplier", "s_nationkey", "nation", "n_nationkey"))


@query("relationship_admission", BINDINGS + f", f AS ({FLOW}), v AS (SELECT source, target, CASE substr(target, length(target), 1) WHEN '1' THEN 'contradicted' WHEN '2' THEN NULL ELSE 'supported' END AS verdict FROM f) SELECT CASE WHEN verdict = 'supported' THEN 'canonical' WHEN verdict IS NULL THEN 'unverified' ELSE 'rejected' END AS status, count(*) AS n FROM v GROUP BY ALL")
def relationship_admission(spark, sf_dir):
    e = R.dataflow(bindings(spark, sf_dir))
    last = F.substring("target", -1, 1)
    v = e.where(last != "2").select("source", "target", F.when(last == "1", "contradicted").otherwise("supported").alias("verdict"))
    return R.admitted(e, v).groupBy("status").agg(F.count("*").alias("n"))


@query("edge_hygiene", EDGES + " SELECT CASE WHEN source = target THEN 'self_loop' WHEN target NOT IN (SELECT node FROM n) THEN 'dangling' ELSE 'used' END AS status, count(*) AS n FROM (SELECT DISTINCT source, target FROM raw) GROUP BY ALL")
def edge_hygiene(spark, sf_dir):
    return G.clean_edges(edges(spark, sf_dir), nodes(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


def used(spark, sf_dir):
    return G.clean_edges(edges(spark, sf_dir), nodes(spark, sf_dir)).where("status = 'used'").select("source", "target")


@query("dag_components", EDGES + ", u AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e), r AS (SELECT node, node AS other FROM n UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.other) SELECT node, min(other) AS component FROM r GROUP BY node")
def dag_components(spark, sf_dir):
    return G.components(used(spark, sf_dir), nodes(spark, sf_dir))


REACH = ", r AS (SELECT node, 0 AS level FROM n WHERE node % 40 = 1 UNION SELECT e.target, r.level + 1 FROM r JOIN e ON e.source = r.node WHERE r.level < 45)"


@query("bfs_levels", EDGES + REACH + " SELECT node, min(level)::INTEGER AS level FROM r GROUP BY node")
def bfs_levels(spark, sf_dir):
    return G.reach(used(spark, sf_dir), nodes(spark, sf_dir).where("node % 40 = 1"))


PLAIN_REACH = ", r AS (SELECT node FROM n WHERE node % 40 = 1 UNION SELECT e.target FROM r JOIN e ON e.source = r.node)"


@query("impact_closure", EDGES + PLAIN_REACH + " SELECT node FROM r")
def impact_closure(spark, sf_dir):
    return G.reach(used(spark, sf_dir), nodes(spark, sf_dir).where("node % 40 = 1")).select("node")


@query("impact_statuses", EDGES + PLAIN_REACH + """ SELECT p_partkey AS node, CASE WHEN p_size % 23 = 0 THEN 'refused-unsupported-construct' WHEN p_partkey % 40 = 1 THEN 'changed' WHEN r.node IS NULL THEN 'unaffected'
  WHEN p_size % 5 = 0 THEN 'unresolved-review' ELSE 'recomputed' END AS status FROM part LEFT JOIN r ON r.node = p_partkey""")
def impact_statuses(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_size")
    hit = G.reach(used(spark, sf_dir), nodes(spark, sf_dir).where("node % 40 = 1")).select("node", F.lit(True).alias("hit"))
    x = p.join(hit, "node", "left")
    s = F.when(F.col("p_size") % 23 == 0, "refused-unsupported-construct").when(F.col("node") % 40 == 1, "changed").when(F.col("hit").isNull(), "unaffected").when(F.col("p_size") % 5 == 0, "unresolved-review").otherwise("recomputed")
    return x.select("node", s.alias("status"))


@query("scc_groups", EDGES + ", r AS (SELECT source, target FROM e UNION SELECT r.source, e.target FROM r JOIN e ON e.source = r.target) SELECT a.source AS node, least(min(a.target), a.source) AS cycle FROM r a JOIN r b ON a.source = b.target AND a.target = b.source GROUP BY a.source HAVING count(DISTINCT a.target) > 1")
def scc_groups(spark, sf_dir):
    return G.cycles(used(spark, sf_dir))


@query("topological_levels", EDGES + ", d AS (SELECT source, target FROM e WHERE source < target), r AS (SELECT node, 0 AS level FROM n UNION SELECT d.target, r.level + 1 FROM r JOIN d ON d.source = r.node) SELECT node, max(level)::INTEGER AS level FROM r GROUP BY node")
def topological_levels(spark, sf_dir):
    return G.longest_levels(used(spark, sf_dir).where("source < target"), nodes(spark, sf_dir))


@query("degree_buckets", EDGES + ", d AS (SELECT node, count(x) AS k FROM n LEFT JOIN (SELECT source AS x FROM e UNION ALL SELECT target FROM e) ON x = node GROUP BY node) SELECT CASE WHEN k = 0 THEN '0' WHEN k <= 2 THEN '1-2' WHEN k <= 5 THEN '3-5' WHEN k <= 10 THEN '6-10' ELSE '11+' END AS bucket, count(*) AS n FROM d GROUP BY ALL")
def degree_buckets(spark, sf_dir):
    return G.degrees(used(spark, sf_dir), nodes(spark, sf_dir)).groupBy("bucket").agg(F.count("*").alias("n"))


@query("most_connected", EDGES + " SELECT node, count(*)::BIGINT AS degree FROM (SELECT source AS node FROM e UNION ALL SELECT target FROM e) GROUP BY node ORDER BY degree DESC, node LIMIT 10")
def most_connected(spark, sf_dir):
    return G.degrees(used(spark, sf_dir), nodes(spark, sf_dir)).select("node", "degree").orderBy(F.desc("degree"), "node").limit(10)
