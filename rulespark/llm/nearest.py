"""Approximate nearest neighbours: inverted lists with an adaptive dimension scan.

Vectors are dealt into lists by k-means centres and rotated at random, so that a
part of the dimensions tells about the whole.  Within each probed list a block
of columns is multiplied for all candidates; a candidate is dropped as soon as a
test says that, at `z` standard errors, its inner product cannot reach the
query's current k-th best.  The others go on to the next block of columns.  What
is left is scored in double precision on the original vectors.

The centres, the number of probed lists (the smallest with `target` recall) and
each query's first threshold come from a sample of at most `sample` vectors,
chosen by a hash of the id; every vector is indexed.  (The threshold is a
little below the sample's k-th best, so that k are left even where a test
abandons a good one; the centres are fitted on a part of the sample.)  Lists are split into
blocks of about `block` vectors and queries into chunks of about `chunk`, by a
hash of the id, so that neither a hot list nor many queries meet in one task.

Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part.  Ties go to the smaller id.  Rows that
share an id with the query are not its candidates.  Empty table: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Ranks below the sample's k-th best at which a query's first threshold lies; vectors that the centres are fitted on.
SPARE, FITTED = 12, 4096


def rotation(dim: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centres(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """k-means; an empty centre keeps its place."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:lists]].copy()
    for _ in range(rounds):
        own = order_of(x, c)[:, 0]
        for k in np.unique(own):
            c[k] = x[own == k].mean(axis=0)
    return c


def order_of(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Centres, nearest first."""
    return np.argsort((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1, kind="stable")


def probes(x: np.ndarray, c: np.ndarray, k: int, target: float) -> int:
    """The fewest lists that hold `target` of the k nearest within the sample."""
    q = x[: min(len(x), 256)]
    scores = q @ x.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : max(1, min(k, len(x) - 1))]
    order, own = order_of(q, c), order_of(x, c)[:, 0]
    place = np.argsort(order, axis=1)
    need = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(need[min(len(need) - 1, math.ceil(target * len(need)) - 1)]) + 1


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def adaptive(q: np.ndarray, c: np.ndarray, floor: np.ndarray, columns: int, z: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) of rotated vectors that no test has abandoned."""
    dim = q.shape[1]
    nq, nc = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    d = min(columns, dim)
    part = q[:, :d] @ c[:, :d].T
    spread = lambda d: z * math.sqrt((dim - d) / (d * dim))
    slack = 1e-5 * nq * (nc.max() if len(nc) else 0)
    qi, ci = np.nonzero(part * (dim / d) + spread(d) * nq[:, None] * nc[None, :] >= (floor - slack)[:, None])
    part = part[qi, ci]
    while d < dim:
        e = min(dim, d + columns)
        part = part + np.einsum("ij,ij->i", q[qi, d:e], c[ci, d:e])
        d = e
        live = part * (dim / d) + spread(d) * nq[qi] * nc[ci] >= (floor - slack)[qi]
        qi, ci, part = qi[live], ci[live], part[live]
    return qi, ci


def best(qi: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, qi))
    begin = np.flatnonzero(np.diff(qi[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[rank < k]


def scan(qid: np.ndarray, q: np.ndarray, floor: np.ndarray, cid: np.ndarray, c: np.ndarray, turn: np.ndarray, k: int, columns: int, z: float, step: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of the k best within one block."""
    floor = floor.copy()
    turned, found = (q @ turn).astype(np.float32), []
    have = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for a in range(0, len(c), step):
        part, ids = c[a : a + step], cid[a : a + step]
        rot = (part @ turn).astype(np.float32)
        for b in range(0, len(q), 256):
            qi, ci = adaptive(turned[b : b + 256], rot, floor[b : b + 256], columns, z)
            qi = qi + b
            other = qid[qi] != ids[ci]
            qi, ci = qi[other], ci[other]
            found.append((qi, ids[ci], (q[qi] * part[ci]).sum(axis=1)))
        have = tuple(np.concatenate(x) for x in zip(have, *found, strict=True))
        found = []
        keep = best(*have, k)
        have = tuple(x[keep] for x in have)
        count = np.bincount(have[0], minlength=len(q))
        last = np.cumsum(count) - 1
        full = count >= k
        floor[full] = np.maximum(floor[full], have[2][last[full]])
    return have


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, sample: int = 16384, target: float = 0.98, columns: int = 16, z: float = 2.6, block: int = 4096, chunk: int = 8192) -> DataFrame:
    """query_id, rank, id_col, score."""
    spark = df.sparkSession
    out = "query_id long, vec_id long, score double"
    ok = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    x = df.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("q")).where(F.col("i").isNotNull()).where(F.coalesce(ok, F.lit(False)))
    dims = x.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if("q").alias("nq")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    dim, n, nq = dims[0]["d"], dims[0]["n"], dims[0]["nq"]
    x = x.where(F.size("v") == dim)
    got = x.select("i", "v").orderBy(F.xxhash64(F.lit("sample"), "i"), "i").limit(sample).collect()
    known, ids = np.array([r.v for r in got]), np.array([r.i for r in got])
    lists = max(1, min(1024, int(math.sqrt(n) / 4), len(known) // 8 or 1))
    c = centres(known[:FITTED], lists)
    n_probe = probes(known[:FITTED], c, k, target) if len(known) > 1 else 1
    turn = rotation(dim)
    held = spark.sparkContext.broadcast((known, ids, c, turn))

    def deal(batches):
        known, ids, c, _ = held.value
        for b in batches:
            if not b.num_rows:
                continue
            own, isq, v = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), matrix(b.column(1), dim)
            order = order_of(v, c)
            floor, probed = np.full(len(v), -np.inf), [None] * len(v)
            at = np.flatnonzero(isq)
            for a in range(0, len(at), 512):
                some = at[a : a + 512]
                score = v[some] @ known.T
                score[own[some][:, None] == ids[None, :]] = -np.inf
                if score.shape[1] >= k + SPARE:
                    floor[some] = np.partition(score, -k - SPARE, axis=1)[:, -k - SPARE]
                for r in some.tolist():
                    probed[r] = order[r, :n_probe].tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(order[:, 0].astype(np.int32)), pa.array(probed, pa.list_(pa.int32())), pa.array(floor)], names=["i", "v", "q", "list", "probed", "floor"])

    dealt = x.withColumn("q", F.coalesce("q", F.lit(False))).mapInArrow(deal, "i long, v array<double>, q boolean, list int, probed array<int>, floor double")
    sizes = {r["list"]: r["count"] for r in dealt.groupBy("list").count().collect()}
    blocks = spark.createDataFrame([(a, max(1, math.ceil(m / block))) for a, m in sizes.items()], "list int, blocks int")
    chunks = max(1, math.ceil(nq / chunk))
    cand = dealt.select("list", "i", "v").join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "i"), F.col("blocks")).cast("int"))
    cand = cand.select("list", "block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "i", "v")
    asks = dealt.where("q").select("i", "v", "floor", F.explode("probed").alias("list")).join(F.broadcast(blocks), "list")
    asks = asks.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64(F.lit("chunk"), "i"), F.lit(chunks)).cast("int").alias("chunk"), "i", "v", "floor").toDF("qlist", "qblock", "qchunk", "qi", "qv", "floor")
    key = ["list", "block", "chunk"]

    def both(_, a: pa.Table, b: pa.Table) -> pa.Table:
        turn = held.value[3]
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        qid = a.column("qi").to_numpy()
        row, found, score = scan(qid, matrix(a.column("qv"), dim), a.column("floor").to_numpy(), b.column("i").to_numpy(), matrix(b.column("v"), dim), turn, k, columns, z)
        return pa.table({"query_id": qid[row], "vec_id": found, "score": score})

    pairs = asks.groupBy("qlist", "qblock", "qchunk").cogroup(cand.groupBy(*key)).applyInArrow(both, out)
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
