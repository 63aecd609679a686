"""Relations between rules, derived as joins on the facts they read and write.

bindings: (rule_id, role 'read' | 'write', fact, type, unit, scope map<string,array<string>>).
Every join is on the fact; type, unit and scope are residual conditions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A symbol or passage that more rules share than this says nothing about any two of them.
FANOUT = 120


def types_agree(a: Column, b: Column) -> Column:
    numeric = a.isin("number", "integer") & b.isin("number", "integer")
    return a.isNull() | b.isNull() | (a == b) | numeric


def units_agree(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (a == b)


def scopes_overlap(a: Column, b: Column) -> Column:
    """Rejected only by a dimension that both populate with disjoint values."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    apart = F.exists(shared, lambda d: (F.size(F.try_element_at(a, d)) > 0) & (F.size(F.try_element_at(b, d)) > 0) & ~F.arrays_overlap(F.try_element_at(a, d), F.try_element_at(b, d)))
    return ~F.coalesce(apart, F.lit(False))


def _side(b: DataFrame, role: str, p: str) -> DataFrame:
    return b.where(F.col("role") == role).select("fact", F.col("rule_id").alias(f"{p}_id"), F.col("type").alias(f"{p}_type"), F.col("unit").alias(f"{p}_unit"), F.col("scope").alias(f"{p}_scope"))


def _residual(a: str, b: str) -> Column:
    return types_agree(F.col(f"{a}_type"), F.col(f"{b}_type")) & units_agree(F.col(f"{a}_unit"), F.col(f"{b}_unit")) & scopes_overlap(F.col(f"{a}_scope"), F.col(f"{b}_scope"))


def _pairs(df: DataFrame, kind: str, directed: bool) -> DataFrame:
    return df.groupBy(F.col("a_id").alias("source"), F.col("b_id").alias("target")).agg(F.array_join(F.array_sort(F.collect_set("fact")), ",").alias("symbols"), F.count_distinct("fact").alias("strength")).select("source", "target", F.lit(kind).alias("kind"), F.lit(directed).alias("directed"), "symbols", "strength")


def dataflow(bindings: DataFrame) -> DataFrame:
    """Writer -> reader of the same fact."""
    j = _side(bindings, "write", "a").join(_side(bindings, "read", "b"), "fact").where("a_id <> b_id").where(_residual("a", "b"))
    return _pairs(j, "dataflow", True)


def conflicts(bindings: DataFrame) -> DataFrame:
    """Two writers of the same fact whose scopes may overlap."""
    j = _side(bindings, "write", "a").join(_side(bindings, "write", "b"), "fact").where("a_id < b_id").where(_residual("a", "b"))
    return _pairs(j, "conflict", False)


def _within(df: DataFrame, keys: list[str], fanout: int) -> DataFrame:
    """Rows whose key no more than `fanout` rules share; counted before any pair is made."""
    n = df.groupBy(*keys).agg(F.count_distinct("rule_id").alias("_n")).where(F.col("_n") <= fanout).select(*keys)
    return df.join(n, keys, "left_semi")


def shared_inputs(bindings: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Two readers of a fact that no rule writes."""
    reads = bindings.where("role = 'read'").join(bindings.where("role = 'write'").select("fact").distinct(), "fact", "left_anti")
    r = _within(reads, ["fact"], fanout)
    j = _side(r, "read", "a").join(_side(r, "read", "b"), "fact").where("a_id < b_id").where(_residual("a", "b"))
    return _pairs(j, "shared_input", False)


def shared_passages(passages: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(rule_id, chunk_path, section_id): rules that cite the same passage; type and scope do not matter."""
    p = _within(passages.select("rule_id", F.concat_ws("#", "chunk_path", "section_id").alias("fact")).distinct(), ["fact"], fanout)
    j = p.select("fact", F.col("rule_id").alias("a_id")).join(p.select("fact", F.col("rule_id").alias("b_id")), "fact").where("a_id < b_id")
    return _pairs(j, "shared_passage", False)


def fact_registry(bindings: DataFrame) -> DataFrame:
    """Per fact its types, units, producers and consumers, and what is wrong with it."""
    g = bindings.groupBy("fact").agg(
        F.array_sort(F.collect_set("type")).alias("types"), F.array_sort(F.collect_set("unit")).alias("units"),
        F.count_distinct(F.when(F.col("role") == "write", F.col("rule_id"))).alias("producers"), F.count_distinct(F.when(F.col("role") == "read", F.col("rule_id"))).alias("consumers"),
    )
    clash = (F.size("types") > 1) & (F.size(F.array_except("types", F.array(F.lit("integer"), F.lit("number")))) > 0)
    issue = F.array_join(F.array_compact(F.array(F.when(clash, "type_conflict"), F.when(F.size("units") > 1, "unit_conflict"))), ",")
    return g.select("fact", F.array_join("types", ",").alias("types"), F.array_join("units", ",").alias("units"), "producers", "consumers", issue.alias("issues"))


def revalidated(edges: DataFrame, bindings: DataFrame) -> DataFrame:
    """Stored (source, target, kind) edges that still follow from the bindings; gating edges fall back to dataflow."""
    flows = dataflow(bindings).select("source", "target", F.lit(True).alias("_ok"))
    j = edges.join(flows, ["source", "target"], "left")
    status = F.when(F.col("_ok").isNull(), "dropped").when(F.col("kind") == "gating", "downgraded").otherwise("kept")
    return j.select("source", "target", F.when(F.col("kind") == "gating", "dataflow").otherwise(F.col("kind")).alias("kind"), status.alias("status"))


def dangling(refs: DataFrame, ids: DataFrame, ref: str, key: str) -> DataFrame:
    """References whose target does not exist."""
    return refs.join(ids.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


def with_unique_names(df: DataFrame, name: str, order: str, suffix: str = "_v") -> DataFrame:
    """The first of equal names keeps it, later ones get _v2, _v3 in order."""
    n = F.row_number().over(W.partitionBy(name).orderBy(order))
    return df.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(suffix), n.cast("string"))))


def admitted(edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Edges by verdict: supported ones are canonical, the others go to the rejected ledger with the reason."""
    j = edges.join(verdicts, ["source", "target"], "left")
    return j.withColumn("status", F.when(F.col("verdict") == "supported", "canonical").when(F.col("verdict").isNull(), "unverified").otherwise("rejected"))


def first_present(df: DataFrame, catalogs: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """Left joins in order of precedence; the first catalog that knows the key wins."""
    out, found = df, []
    for label, cat in catalogs:
        out = out.join(cat.select(F.col(key), F.struct(F.col(value).alias(value), F.lit(label).alias("matched_as")).alias(f"_{label}")), key, "left")
        found.append(F.col(f"_{label}"))
    hit = F.coalesce(*found)
    return out.select(*df.columns, hit[value].alias(value), hit["matched_as"].alias("matched_as"))
