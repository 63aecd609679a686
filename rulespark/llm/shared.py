"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where it is unset and there is one machine, as in tests."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="shared")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def free(name: str, taken: list[str]) -> str:
    """The name, with as many underscores before it as make it one that no column has (upper and lower case are alike)."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a Parquet table of the shared folder: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets Spark delete the shuffle files of what has just been written
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing will read it."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
