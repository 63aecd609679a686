"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A key falls into the arc of the next virtual node clockwise and belongs to that
node's shard.  No shard takes more than its share of rows: keys that overflow a
full shard continue clockwise to the next node whose shard has room.  With
`slack` 0 the shares are the whole numbers next to rows / shards, so counts are
at most one apart; a larger slack moves fewer keys when shards are added.

Only the number of keys in each arc reaches the driver (shards * nodes figures,
however many rows there are).  It walks the ring once over these counts and
says, for each arc, which ranks go to which shard from which slot on; the rows
then need one rank within their arc.

A null key hashes like any other value.  Repeated keys stay in one arc and are
ranked next to each other.  Empty table: no rows.  Null text counts no bytes
and has no checksum.  Other columns are carried along, whatever their names;
ones named shard or slot are replaced.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions on the ring: 0 to 2**32 - 1.
RING = 1 << 32


def ring(spark, shards: int, nodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise."""
    rows = spark.range(shards * nodes).select(
        F.pmod(F.xxhash64(F.lit("node"), F.floor(F.col("id") / nodes), F.col("id") % nodes), F.lit(RING)).alias("at"), F.floor(F.col("id") / nodes).cast("int").alias("shard")
    )
    return sorted((r["at"], r["shard"]) for r in rows.collect())


def flow(counts: list[int], owner: list[int], shares: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) after the overflow has gone round."""
    left, used, out = list(shares), [0] * len(shares), []
    over: list[list[int]] = []
    rank = [0] * len(counts)

    def take(arc: int, n: int, shard: int) -> int:
        n = min(n, left[shard])
        if n:
            out.append((arc, rank[arc], rank[arc] + n, shard, used[shard]))
            rank[arc] += n
            used[shard] += n
            left[shard] -= n
        return n

    for arc, n in enumerate(counts):
        if rest := n - take(arc, n, owner[arc]):
            over.append([arc, rest])
    nexts: dict[int, int] = {}
    n_arcs = len(counts)

    def clockwise(arc: int) -> int:
        """The next arc from here on whose shard has room."""
        seen = []
        while not left[owner[arc]]:
            seen.append(arc)
            arc = nexts.get(arc, (arc + 1) % n_arcs)
        for x in seen:
            nexts[x] = arc
        return arc

    for arc, rest in over:
        while rest:
            rest -= take(arc, rest, owner[clockwise((arc + 1) % n_arcs)])
    return out


def shard_rows(df: DataFrame, key: Column, shards: int = 40, nodes: int = 128, slack: float = 0.0) -> DataFrame:
    """df with shard int and slot long (gapless from 0 in each shard)."""
    spark = df.sparkSession
    places = ring(spark, shards, nodes)
    owner = [s for _, s in places]
    n = len(places)
    # A position's arc: bounds are found by a coarse table of equal cells, then the few nodes of the cell.
    cells = 1 << max(1, (n - 1).bit_length())
    width = RING // cells
    at = [p for p, _ in places]
    cell_first = [bisect_left(at, c * width) for c in range(cells)]
    cell_nodes = [at[cell_first[c] : (cell_first[c + 1] if c + 1 < cells else n)] for c in range(cells)]
    table = spark.createDataFrame([(c, cell_first[c], cell_nodes[c]) for c in range(cells)], "_cell int, _first int, _nodes array<long>")
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    whole = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.struct(F.lit(None).alias("none"))
    placed = df.select(whole.alias("_row"), key.alias("_key")).withColumn("_at", F.pmod(F.xxhash64(F.lit("key"), "_key"), F.lit(RING))).withColumn("_cell", F.floor(F.col("_at") / width).cast("int"))
    placed = placed.join(F.broadcast(table), "_cell")
    arc = F.pmod(F.col("_first") + F.size(F.filter("_nodes", lambda x: x < F.col("_at"))), F.lit(n))
    placed = placed.withColumn("_arc", arc.cast("int")).drop("_cell", "_first", "_nodes")
    found = {r["_arc"]: r["count"] for r in placed.groupBy("_arc").count().collect()}
    counts = [found.get(k, 0) for k in range(n)]
    total = sum(counts)
    if slack:
        shares = [int(total * (1 + slack) / shards) + 1] * shards
    else:
        shares = [total // shards + (s < total % shards) for s in range(shards)]
    runs: dict[int, list] = {}
    for a, lo, hi, shard, slot in flow(counts, owner, shares):
        runs.setdefault(a, []).append((lo, hi, shard, slot))
    plan = spark.createDataFrame([(a, r) for a, r in runs.items()] or [(-1, [])], "_arc int, _runs array<struct<lo:long,hi:long,shard:int,slot:long>>")
    ranked = placed.withColumn("_rank", F.row_number().over(W.partitionBy("_arc").orderBy("_at", "_key")) - 1)
    out = ranked.join(F.broadcast(plan), "_arc")
    run = F.filter("_runs", lambda r: (r["lo"] <= F.col("_rank")) & (F.col("_rank") < r["hi"]))[0]
    out = out.withColumn("_run", run)
    return out.select(*(F.col(f"_row.`{c}`") for c in kept), F.col("_run.shard").alias("shard"), (F.col("_run.slot") + F.col("_rank") - F.col("_run.lo")).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"))
    out = shard_rows(rows, F.col("doc_id"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
