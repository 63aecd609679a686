"""Report measures: grounding, quality budgets, statistics of selectors, run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Score interval of a share, within [0, 1]; (0, 0) for no trials."""
    p, zz = successes / n, z * z
    mid = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    none = n == 0
    return F.when(none, 0.0).otherwise(F.greatest(mid - half, F.lit(0.0))), F.when(none, 0.0).otherwise(F.least(mid + half, F.lit(1.0)))


def running(df: DataFrame, order: list, sums: list[str], most: int = 1 << 20) -> DataFrame:
    """df with place (1, 2, .. in the order of all rows) and the running sum `run_x` of each column x.

    Rows are dealt by range; sums of the parts before, a row a part, are added to those within a part, so no task holds all rows.
    """
    parts = max(1, -(-df.count() // most))
    x = cut(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    upto = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = x.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    zero = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    before = totals.select("_part", zero("_n").alias("_b"), *[zero(f"_s_{c}").alias(f"_b_{c}") for c in sums])
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    y = x.withColumns({"place": F.row_number().over(W.partitionBy("_part").orderBy(*order)), **{f"run_{c}": F.sum(c).over(within) for c in sums}}).join(F.broadcast(before), "_part")
    return y.withColumns({"place": F.col("place") + F.col("_b"), **{f"run_{c}": F.col(f"run_{c}") + F.col(f"_b_{c}") for c in sums}}).drop("_part", "_b", *[f"_b_{c}" for c in sums])


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Mann-Whitney AUC with average ranks for ties, from counts per distinct score."""
    g = df.groupBy(score).agg(F.sum(label).cast("double").alias("p"), F.sum(1 - F.col(label)).cast("double").alias("q"))
    x = running(g, [score], ["q"])
    return x.select("p", "q", (F.col("p") * (F.col("run_q") - F.col("q") / 2)).alias("u")).agg((F.sum("u") / (F.sum("p") * F.sum("q"))).alias("auc"))


def risk_coverage(df: DataFrame, score: str, wrong: str) -> DataFrame:
    """Cumulative coverage and risk, surest first, one row for each distinct score."""
    g = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n"), F.sum(wrong).alias("e"))
    x = running(g, [F.desc(score)], ["n", "e"])
    return x.select(score, F.col("run_n").alias("answered"), F.col("run_e").alias("errors"), (F.col("run_e") / F.col("run_n")).alias("risk"))


def selective_risk(df: DataFrame, score: str, wrong: str, tie: str, targets: list[float]) -> DataFrame:
    """aurc, and risk at the largest coverage within each target: answers one by one, surest first, equal scores in order of tie."""
    x = running(df.where(F.col(score).isNotNull()), [F.desc(score), F.col(tie)], [wrong])
    n, risk = F.max("place"), F.col(f"run_{wrong}") / F.col("place")
    total = x.agg(n.alias("n"))
    y = x.crossJoin(F.broadcast(total)).withColumn("risk", risk)
    at = [F.max_by("risk", F.when(F.col("place") / F.col("n") <= t + 1e-9, F.col("place"))).alias(f"risk_at_{round(t * 100)}") for t in targets]
    return y.agg((F.sum("risk") / F.max("n")).alias("aurc"), *at)


def weighted_present(weights: dict[str, float], scale: float = 1.0) -> Column:
    """Weighted mean of the columns that are not null; null if none is."""
    top = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    low = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return F.when(low > 0, top / low * scale)


def failure_cohorts(claims: DataFrame, rule: str, kind: str, families: dict[str, list[str]]) -> DataFrame:
    """Rules by what their failed claims are: only of one family, mixed, or other."""
    x = claims.groupBy(rule).agg(F.array_sort(F.collect_set(kind)).alias("kinds"))
    out = F.lit("mixed")
    for name, kinds in reversed(families.items()):
        out = F.when(F.size(F.array_except("kinds", F.array(*map(F.lit, kinds)))) == 0, name).otherwise(out)
    return x.select(rule, out.alias("cohort"))


def budget(total: Column, rate: float) -> Column:
    """The most failures that a rate in percent allows: rounded down."""
    return F.floor(total * rate / 100).cast("long")


def cache_hit_rate(cached: Column, prompt: Column) -> Column:
    return F.when(prompt > 0, F.round(cached / prompt * 100, 1))
