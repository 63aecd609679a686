"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast.
MOST_BROADCAST = 1 << 20


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from spark.checkpoint.dir (a temporary folder only where that is unset, as in tests)."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="rulespark")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df to be broadcast if it has `most` rows at most, as it is otherwise; give it a written table, for its rows are counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
