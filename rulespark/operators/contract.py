"""The rule contract: checks that give one row for each violation, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(df: DataFrame, key: str, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """(key, section, code) of every check that fails; an unknown result fails."""
    rows = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(s).alias("section"), F.lit(c).alias("code"))) for c, (s, ok) in checks.items()]))
    return df.select(key, F.explode(rows).alias("i")).select(key, "i.section", "i.code")


def readiness(df: DataFrame, key: str, found: DataFrame, sections: list[str]) -> DataFrame:
    """Status of each section, and ready or review."""
    bad = found.groupBy(key).agg(F.collect_set("section").alias("bad"))
    x = df.select(key).join(bad, key, "left").withColumn("bad", F.coalesce("bad", F.array().cast("array<string>")))
    return x.select(key, *[F.when(F.array_contains("bad", s), "fail").otherwise("pass").alias(s) for s in sections], F.when(F.size("bad") == 0, "ready").otherwise("review").alias("readiness"))


def numeric_conflicts(df: DataFrame, group: list[str], key: str, value: str) -> DataFrame:
    """Pairs of rules that assign different numbers to the same thing."""
    a, b = (df.select(*group, F.col(key).alias(f"{p}_id"), F.col(value).alias(f"{p}_value")) for p in "ab")
    return a.join(b, group).where("a_id < b_id and a_value <> b_value")


def routed(blocking: Column, contradicted: Column, case: Column, repairable: Column) -> Column:
    return F.when(contradicted > 0, "human_review").when(case, "case_management").when(repairable & (blocking > 0), "machine_repair").when(blocking > 0, "human_review").otherwise("none")
