"""A rule base derived from the star schema, for queries that need rules.

Each part is a rule.  It writes one fact and reads two, in buckets of ten parts,
so the number of relations grows as the number of rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table


def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    k, s = F.col("p_partkey"), F.col("p_size")
    bucket = F.floor(k / 10)
    fact = lambda b: F.concat(F.lit("fact_"), b.cast("string"))
    kind = F.when(s % 11 == 0, F.lit(None).cast("string")).when(s % 5 == 0, "integer").when(s % 7 == 0, "string").otherwise("number")
    unit = F.when(s % 3 == 0, "usd").when(s % 13 == 0, "percent")
    values = F.array(F.concat(F.lit("z"), (s % 4).cast("string")), F.concat(F.lit("z"), (k % 4).cast("string")))
    scope = F.when(s % 6 == 0, F.create_map().cast("map<string,array<string>>")).when(s % 6 == 1, F.create_map(F.lit("state"), F.array().cast("array<string>"))).otherwise(F.create_map(F.lit("state"), values))
    one = lambda role, b: F.struct(F.lit(role).alias("role"), fact(b).alias("fact"))
    rows = F.array(one("write", bucket), one("read", bucket + 1), one("read", bucket + s % 3))
    return p.select(F.concat(F.lit("R"), k.cast("string")).alias("rule_id"), F.explode(rows).alias("b"), kind.alias("type"), unit.alias("unit"), scope.alias("scope")).select("rule_id", "b.role", "b.fact", "type", "unit", "scope")


BINDINGS = """
WITH base AS (
  SELECT 'R' || p_partkey AS rule_id, p_partkey // 10 AS bucket, p_size AS s,
    CASE WHEN p_size % 11 = 0 THEN NULL WHEN p_size % 5 = 0 THEN 'integer' WHEN p_size % 7 = 0 THEN 'string' ELSE 'number' END AS type,
    CASE WHEN p_size % 3 = 0 THEN 'usd' WHEN p_size % 13 = 0 THEN 'percent' END AS unit,
    CASE WHEN p_size % 6 IN (0, 1) THEN [] ELSE ['z' || p_size % 4, 'z' || p_partkey % 4] END AS scope
  FROM part
), b AS (
  SELECT rule_id, 'write' AS role, 'fact_' || bucket AS fact, type, unit, scope FROM base
  UNION ALL SELECT rule_id, 'read', 'fact_' || (bucket + 1), type, unit, scope FROM base
  UNION ALL SELECT rule_id, 'read', 'fact_' || (bucket + s % 3), type, unit, scope FROM base
)"""

#: Whether rows x and y of b agree in type, unit and scope.
RESIDUAL = """(x.type IS NULL OR y.type IS NULL OR x.type = y.type OR (x.type IN ('number', 'integer') AND y.type IN ('number', 'integer')))
  AND (x.unit IS NULL OR y.unit IS NULL OR x.unit = y.unit) AND (len(x.scope) = 0 OR len(y.scope) = 0 OR list_has_any(x.scope, y.scope))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directed graph over parts: three steps of a fixed rule within runs of 40 parts, with cycles, self loops and dangling ends."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    k, s = F.col("p_partkey"), F.col("p_size")
    run = k - k % 40
    to = F.array(F.when(s % 4 != 0, run + (k + s) % 40), F.when(s % 9 == 0, k), F.when(s % 17 == 0, k + 10_000_000))
    return p.select(k.alias("source"), F.explode(F.array_compact(to)).alias("target"))


EDGES = """
WITH RECURSIVE n AS (SELECT p_partkey AS node FROM part), raw AS (
  SELECT p_partkey AS source, unnest(list_filter([CASE WHEN p_size % 4 <> 0 THEN p_partkey - p_partkey % 40 + (p_partkey + p_size) % 40 END,
    CASE WHEN p_size % 9 = 0 THEN p_partkey END, CASE WHEN p_size % 17 = 0 THEN p_partkey + 10000000 END], lambda t: t IS NOT NULL)) AS target FROM part
), e AS (SELECT DISTINCT source, target FROM raw WHERE source <> target AND source IN (SELECT node FROM n) AND target IN (SELECT node FROM n))"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
