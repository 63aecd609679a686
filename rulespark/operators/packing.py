"""Order-dependent folds: batches by caps, neighbour merging, greedy bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fixed_batches(df: DataFrame, part: str, order: str, size: int) -> DataFrame:
    """Batches of `size` rows within each part."""
    return df.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(part).orderBy(order)) - 1) / size).cast("int"))


def greedy_bins(sizes: Column, cap: int, most: int) -> Column:
    """For an ordered array of sizes, the bin of each: a bin closes when `cap` or `most` would be passed; an oversized item is alone."""
    zero = F.struct(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        new = (s["n"] > 0) & ((s["sum"] + x > cap) | (s["n"] >= most))
        b = F.when(new, s["bin"] + 1).otherwise(s["bin"])
        return F.struct(b.alias("bin"), F.when(new, x).otherwise(s["sum"] + x).cast("long").alias("sum"), F.when(new, 1).otherwise(s["n"] + 1).alias("n"), F.concat(s["out"], F.array(b)).alias("out"))

    return F.aggregate(sizes, zero, step, lambda s: s["out"])


def merged_neighbours(sizes: Column, least: int, most: int) -> Column:
    """For an ordered array of sizes, the group of each: an undersized item joins the next one if both fit, in one pass from left to right."""
    zero = F.struct(F.lit(-1).alias("g"), F.lit(0).cast("long").alias("open"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        join = (s["open"] > 0) & (s["open"] < least) & (s["open"] + x <= most)
        g = F.when(join, s["g"]).otherwise(s["g"] + 1)
        return F.struct(g.alias("g"), F.when(join, 0).otherwise(x).cast("long").alias("open"), F.concat(s["out"], F.array(g)).alias("out"))

    return F.aggregate(sizes, zero, step, lambda s: s["out"])
