"""Bounded proofs: formulas over the product of finite domains.

A domain is (symbol, theory, values); null is always a candidate and comes first.
The number of assignments is known before any is made; beyond the budget the
answer is `timeout`.  A symbol without a finite domain makes it `unknown`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.logic import THEORIES, Refused, Signature

BUDGET = 10_000


@dataclass(frozen=True)
class Domain:
    symbol: str
    theory: str
    values: tuple | None


def assignments(spark: SparkSession, domains: list[Domain]) -> DataFrame:
    """All assignments with their ordinal `o`: symbols in order of name, the last one fastest."""
    domains = sorted(domains, key=lambda d: d.symbol)
    total = math.prod(len(d.values) + 1 for d in domains)
    out, below = spark.range(total).withColumnRenamed("id", "o"), total
    for d in domains:
        size = len(d.values) + 1
        below //= size
        options = F.array(F.lit(None).cast(THEORIES[d.theory]), *[F.lit(v).cast(THEORIES[d.theory]) for v in d.values])
        out = out.withColumn(d.symbol, F.element_at(options, (F.floor(F.col("o") / below) % size + 1).cast("int")))
    return out


def guard(domains: list[Domain], budget: int) -> str | None:
    if any(d.values is None for d in domains):
        return "unknown"
    return "timeout" if math.prod(len(d.values) + 1 for d in domains) > budget else None


def witness(symbols: list[str]) -> Column:
    return F.concat_ws(",", *[F.concat(F.lit(f"{s}="), F.coalesce(F.col(s).cast("string"), F.lit("null"))) for s in sorted(symbols)])


def satisfiable(spark: SparkSession, formula: dict, domains: list[Domain], budget: int = BUDGET) -> DataFrame:
    """One row: status sat | unsat | unknown | timeout, and the first witness."""
    state = guard(domains, budget)
    if state:
        return spark.range(1).select(F.lit(state).alias("status"), F.lit(None).cast("string").alias("witness"))
    f = Signature({d.symbol: d.theory for d in domains}).compile(formula)
    a = assignments(spark, domains).where(f).agg(F.min_by(witness([d.symbol for d in domains]), "o").alias("witness"))
    return a.select(F.when(F.col("witness").isNull(), "unsat").otherwise("sat").alias("status"), "witness")


def coverage(spark: SparkSession, formulas: dict[str, dict], domains: list[Domain], budget: int = BUDGET) -> DataFrame:
    """Is some formula true under every assignment?  status proved | counterexample | unknown | timeout."""
    state = guard(domains, budget)
    if state:
        return spark.range(1).select(F.lit(state).alias("status"), F.lit(None).cast("string").alias("witness"))
    sig = Signature({d.symbol: d.theory for d in domains})
    any_ = F.lit(False)
    for f in formulas.values():
        any_ = any_ | sig.compile(f)
    a = assignments(spark, domains).withColumn("f", any_)
    w = F.min_by(F.when(F.col("f") == F.lit(False), witness([d.symbol for d in domains])), F.when(F.col("f") == F.lit(False), F.col("o")))
    out = a.agg(w.alias("witness"), F.count_if(F.col("f").isNull()).alias("open"))
    return out.select(F.when(F.col("witness").isNotNull(), "counterexample").when(F.col("open") > 0, "unknown").otherwise("proved").alias("status"), "witness")


def overlaps(spark: SparkSession, formulas: dict[str, dict], outputs: dict[str, str], domains: list[Domain]) -> DataFrame:
    """Every pair of rules: whether both can hold, the first witness, and whether their outputs then conflict.  Refused beyond the budget."""
    state = guard(domains, BUDGET)
    if state:
        raise Refused("UNBOUNDED_DOMAIN" if state == "unknown" else "BUDGET_EXCEEDED", ", ".join(d.symbol for d in domains))
    sig = Signature({d.symbol: d.theory for d in domains})
    rows = F.array(*[F.struct(F.lit(k).alias("id"), sig.compile(f).alias("f"), F.lit(outputs[k]).alias("out")) for k, f in sorted(formulas.items())])
    a = assignments(spark, domains).select("o", witness([d.symbol for d in domains]).alias("w"), F.filter(rows, lambda r: r["f"]).alias("r"))
    pairs = a.select("o", "w", F.explode("r").alias("x"), "r").select("o", "w", "x", F.explode("r").alias("y")).where("x.id < y.id")
    return pairs.groupBy(F.col("x.id").alias("rule_a"), F.col("y.id").alias("rule_b")).agg(F.min_by("w", "o").alias("witness"), F.count("*").alias("assignments"), F.max(F.col("x.out") != F.col("y.out")).alias("conflict"))


def hit_policy(pairs: DataFrame, policy: str) -> DataFrame:
    """UNIQUE: proved if nothing overlaps.  ANY: proved if what overlaps agrees.  COLLECT: unknown.  PRIORITY: refused."""
    bad = {"UNIQUE": F.lit(True), "ANY": F.col("conflict")}.get(policy)
    if bad is None:
        return pairs.sparkSession.range(1).select(F.lit(policy).alias("policy"), F.lit("unknown" if policy == "COLLECT" else "refused").alias("status"), F.lit(0).cast("long").alias("offending"))
    return pairs.agg(F.count_if(bad).alias("offending")).select(F.lit(policy).alias("policy"), F.when(F.col("offending") > 0, "refused").otherwise("proved").alias("status"), "offending")


def proof(spark: SparkSession, formulas: dict[str, dict], outputs: dict[str, str], domains: list[Domain], policy: str) -> DataFrame:
    """hit_policy of the rules' overlaps; unknown or timeout where they cannot be gone through."""
    state = guard(domains, BUDGET)
    if state and policy in ("UNIQUE", "ANY"):
        return spark.range(1).select(F.lit(policy).alias("policy"), F.lit(state).alias("status"), F.lit(None).cast("long").alias("offending"))
    return hit_policy(overlaps(spark, formulas, outputs, domains), policy)


def counterexample(spark: SparkSession, left: dict, right: dict, domains: list[Domain], budget: int = BUDGET) -> DataFrame:
    """An assignment under which the two formulas differ (one true, the other false): status counterexample | equivalent | unknown | timeout."""
    state = guard(domains, budget)
    if state:
        return spark.range(1).select(F.lit(state).alias("status"), F.lit(None).cast("string").alias("witness"))
    sig = Signature({d.symbol: d.theory for d in domains})
    a = assignments(spark, domains).where(sig.compile(left) != sig.compile(right)).agg(F.min_by(witness([d.symbol for d in domains]), "o").alias("witness"))
    return a.select(F.when(F.col("witness").isNull(), "equivalent").otherwise("counterexample").alias("status"), "witness")


def entails(spark: SparkSession, condition: dict, symbol: str, value, domains: list[Domain], budget: int = BUDGET) -> bool | None:
    """Does the condition hold only where the symbol has the value?  None if that cannot be decided."""
    kind = {d.symbol: d.theory for d in domains}.get(symbol)
    if kind is None or guard(domains, budget):
        return None
    other = {"op": "and", "args": [condition, {"op": "ne", "left": {"symbol": symbol}, "right": {"literal": value, "type": kind}}]}
    return satisfiable(spark, other, domains, budget).first()["status"] == "unsat"
