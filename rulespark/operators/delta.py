"""Two versions of a rule set: alignment, kinds of change, directions of thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operators whose rule holds for more facts when the threshold rises.
WIDENS_UP = ("<", "<=")


def align(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id, basis): same id, then a citation code that exactly one leftover on each side has; the rest is added or removed."""
    same = old.select("id").join(new.select("id"), "id").select(F.col("id").alias("old_id"), F.col("id").alias("new_id"), F.lit("id").alias("basis"))
    left = lambda a, b: a.join(b.select("id"), "id", "left_anti")
    o, n = left(old, new), left(new, old)
    alone = lambda df, name: df.where("code is not null").groupBy("code").agg(F.count("*").alias("k"), F.min("id").alias(name)).where("k = 1").select("code", name)
    cited = alone(o, "old_id").join(alone(n, "new_id"), "code").select("old_id", "new_id", F.lit("citation").alias("basis"))
    none = F.lit(None).cast("string")
    removed = o.select(F.col("id").alias("old_id")).join(cited.select("old_id"), "old_id", "left_anti").select("old_id", none.alias("new_id"), F.lit("removed").alias("basis"))
    added = n.select(F.col("id").alias("new_id")).join(cited.select("new_id"), "new_id", "left_anti").select(none.alias("old_id"), "new_id", F.lit("added").alias("basis"))
    return same.unionByName(cited).unionByName(removed).unionByName(added)


def classify(fields: list[str]) -> Column:
    """unchanged, <field>_change or multi_field_change, from old_<field> and new_<field>."""
    changed = F.array_compact(F.array(*[F.when(~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}")), F.lit(f)) for f in fields]))
    return F.when(F.size(changed) == 0, "unchanged").when(F.size(changed) > 1, "multi_field_change").otherwise(F.concat(F.get(changed, F.lit(0)), F.lit("_change")))


def direction(op: Column, old: Column, new: Column) -> Column:
    """Whether a moved threshold lets more facts match (weakening) or fewer (strengthening)."""
    up = new > old
    return F.when(old.eqNullSafe(new), "none").when(old.isNull() | new.isNull(), "unknown").when(~op.isin("<", "<=", ">", ">="), "unordered").when(op.isin(*WIDENS_UP) == up, "weakening").otherwise("strengthening")
