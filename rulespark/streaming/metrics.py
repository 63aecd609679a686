"""Run metrics over a stream of events, with late data bounded by a watermark."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_metrics(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Calls, cost and tokens of each stage in tumbling windows; works on streams and on tables."""
    k = F.from_json("props", "k long")["k"]
    g = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), F.col("event_type").alias("stage"))
    return g.agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("cost"), F.sum(k).alias("tokens")).select(F.col("w.start").alias("window_start"), "stage", "calls", "cost", "tokens")


def once(events: DataFrame, key: str = "event_id", late: str = "2 days") -> DataFrame:
    """Events without repeats: a rerun skips what was done."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def new_items(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key (a fingerprint of all that their result depends on) is in no checkpoint: what a rerun still has to do."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def checkpointed(items: DataFrame, path: str, key: str, work) -> DataFrame:
    """work over the new items, appended to JSON lines at path; returns the last result of every key.

    Usable as a foreachBatch sink: a batch that comes again finds its keys done.
    """
    spark = items.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    made = work(new_items(items, spark.read.json(path), key) if there else items)
    made.withColumn("_at", F.lit(time.time_ns())).write.mode("append").json(path)
    rows = spark.read.json(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "_at").alias("r")).select(key, "r.*").drop("_at")


LIMIT = "`key` string, ts timestamp, id long, current_limit long, backoff_s double"


def limits(results: DataFrame, key: str, start: int = 8, least: int = 1, most: int = 16, window: int = 5) -> DataFrame:
    """The concurrency limit after each result (key, ts, id, ok, penalize) of a key, in order of ts and id.

    After `window` successes in a row it grows by one, a penalty halves it and backs off for 2, 4, 8 .. 32 seconds by
    failures in a row.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        limit, good, bad, out = start, 0, 0, []
        for r in rows.sort_values(["ts", "id"]).itertuples(index=False):
            wait = 0.0
            if r.ok:
                good, bad = good + 1, 0
                if good >= window and limit < most:
                    limit, good = limit + 1, 0
            else:
                good, bad = 0, bad + 1
                if r.penalize:
                    limit, wait = max(least, limit // 2), min(60.0, float(2 ** min(bad, 5)))
            out.append((r.key, r.ts, r.id, limit, wait))
        return pd.DataFrame(out, columns=["key", "ts", "id", "current_limit", "backoff_s"])

    return results.select(F.col(key).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "id", "ok", "penalize").groupBy("key").applyInPandas(run, LIMIT)
