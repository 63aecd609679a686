"""Queries on order-dependent folds and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import packing as P
from .registry import query, table


def sized(spark, sf_dir):
    """Turns of each conversation in order, with their sizes."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("t"))
    return t.select("conv_id", F.transform("t", lambda x: x["turn"]).alias("turns"), F.transform("t", lambda x: x["n"].cast("long")).alias("sizes"))


def unfolded(df, name):
    z = F.arrays_zip("turns", name)
    return df.select("conv_id", F.explode(z).alias("z")).select("conv_id", F.col("z.turns").alias("turn"), F.col(f"z.{name}").alias(name))


ORDERED = "WITH RECURSIVE t AS (SELECT conv_id, turn, length(text)::BIGINT AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)"


@query("word_balanced_bins", ORDERED + ", r AS (SELECT conv_id, turn, k, 0 AS bin, n AS s, 1 AS m FROM t WHERE k = 1 UNION ALL SELECT t.conv_id, t.turn, t.k, CASE WHEN r.s + t.n > 900 OR r.m >= 3 THEN bin + 1 ELSE bin END, CASE WHEN r.s + t.n > 900 OR r.m >= 3 THEN t.n ELSE r.s + t.n END, CASE WHEN r.s + t.n > 900 OR r.m >= 3 THEN 1 ELSE m + 1 END FROM r JOIN t ON t.conv_id = r.conv_id AND t.k = r.k + 1) SELECT conv_id, turn, bin FROM r")
def word_balanced_bins(spark, sf_dir):
    return unfolded(sized(spark, sf_dir).withColumn("bin", P.greedy_bins(F.col("sizes"), 900, 3)), "bin")


@query("merge_small_neighbours", ORDERED + ", r AS (SELECT conv_id, turn, k, 0 AS grp, n AS o FROM t WHERE k = 1 UNION ALL SELECT t.conv_id, t.turn, t.k, CASE WHEN o > 0 AND o < 300 AND o + t.n <= 1200 THEN grp ELSE grp + 1 END, CASE WHEN o > 0 AND o < 300 AND o + t.n <= 1200 THEN 0 ELSE t.n END FROM r JOIN t ON t.conv_id = r.conv_id AND t.k = r.k + 1) SELECT conv_id, turn, grp FROM r")
def merge_small_neighbours(spark, sf_dir):
    return unfolded(sized(spark, sf_dir).withColumn("grp", P.merged_neighbours(F.col("sizes"), 300, 1200)), "grp")


@query("fixed_batches", "SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2)::INTEGER AS batch FROM conversations")
def fixed_batches(spark, sf_dir):
    return P.fixed_batches(table(spark, sf_dir, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn", "batch")


@query("operator_aliases", "SELECT p_partkey, CASE op WHEN '=' THEN '==' WHEN 'gte' THEN '>=' WHEN 'lt' THEN '<' ELSE op END AS op, CASE op WHEN '=' THEN '!=' WHEN 'gte' THEN '<' WHEN 'lt' THEN '>=' ELSE 'in' END AS negated, CASE op WHEN 'gte' THEN 'minimum_required_' ELSE '' END || 'size' AS output FROM (SELECT p_partkey, ['=', 'gte', 'lt', 'not_in'][p_size % 4 + 1] AS op FROM part)")
def operator_aliases(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, ["=", "gte", "lt", "not_in"])), F.col("p_size") % 4 + 1)
    x = table(spark, sf_dir, "part").select("p_partkey", N.lookup(raw, N.OPERATOR_ALIASES).alias("op"))
    return x.select("p_partkey", "op", N.lookup(F.col("op"), N.NEGATED).alias("negated"), N.threshold_name(F.lit("size"), F.col("op")).alias("output"))


@query("camel_keys", "SELECT DISTINCT p_type AS raw, upper(regexp_replace(regexp_replace(upper(left(p_type, 1)) || lower(substr(p_type, 2)) || 'RuleID', '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS entity FROM part")
def camel_keys(spark, sf_dir):
    c = F.concat(F.initcap(F.lower("p_type")), F.lit("RuleID"))
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("raw"), N.camel_to_key(c).alias("entity")).distinct()


@query("orphan_concepts", "SELECT p_type AS concept, count(DISTINCT p_brand) AS brands, count(l_partkey) AS uses, count(l_partkey) = 0 AS orphan FROM part LEFT JOIN (SELECT l_partkey FROM lineitem) ON l_partkey = p_partkey GROUP BY p_type")
def orphan_concepts(spark, sf_dir):
    u = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("u"))
    g = table(spark, sf_dir, "part").join(u, "p_partkey", "left").groupBy(F.col("p_type").alias("concept")).agg(F.count_distinct("p_brand").alias("brands"), F.coalesce(F.sum("u"), F.lit(0)).alias("uses"))
    return g.withColumn("orphan", F.col("uses") == 0)


@query("role_repair", "SELECT fact, CASE WHEN w AND r THEN 'derived' WHEN w THEN 'output' ELSE 'input' END AS role FROM (SELECT fact, bool_or(role = 'write') AS w, bool_or(role = 'read') AS r FROM (SELECT 'fact_' || (p_partkey // 10) AS fact, 'write' AS role FROM part UNION ALL SELECT 'fact_' || (p_partkey // 10 + 1), 'read' FROM part UNION ALL SELECT 'fact_' || (p_partkey // 10 + p_size % 3), 'read' FROM part) GROUP BY fact)")
def role_repair(spark, sf_dir):
    from .rulebase import bindings

    g = bindings(spark, sf_dir).groupBy("fact").agg(F.max(F.col("role") == "write").alias("w"), F.max(F.col("role") == "read").alias("r"))
    return g.select("fact", F.when(F.col("w") & F.col("r"), "derived").when(F.col("w"), "output").otherwise("input").alias("role"))


@query("stage_windows", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS stage, count(*) AS calls, round(sum(value), 4) AS cost, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS tokens FROM events GROUP BY ALL")
def stage_windows(spark, sf_dir):
    """The streaming aggregation over a table."""
    from ..streaming.metrics import stage_metrics

    m = stage_metrics(table(spark, sf_dir, "events"))
    return m.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "stage", "calls", "cost", "tokens")
