"""Connected components of a table of links, labelled by their smallest node.

Each round takes the smallest label among a node's neighbours and then the
label of that label, so long chains shorten by half at least.  Every round is
written out: no lineage grows, and both sides of each join are plain tables,
which lets Spark split a component that holds many nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) of every node that has a link."""
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = written(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = written(edges.groupBy("u").agg(F.min("v").alias("l")).select(F.col("u").alias("node"), F.least("u", "l").alias("label")))
    while True:
        near = edges.join(label.toDF("v", "l"), "v").groupBy("u").agg(F.min("l").alias("l"))
        low = written(label.join(near.withColumnRenamed("u", "node"), "node").select("node", F.least("label", "l").alias("label"), F.col("label").alias("was")))
        jump = low.join(low.select(F.col("node").alias("label"), F.col("label").alias("l")), "label")
        new = written(jump.select("node", F.least("label", "l").alias("label"), "was"))
        changed = new.where("label < was").limit(1).count()
        for old in (low, label):
            dropped(old)
        label = new.select("node", "label")
        label._written = new._written
        if not changed:
            dropped(edges)
            return label
