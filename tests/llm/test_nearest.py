import numpy as np
from pyspark.sql import functions as F

from rulespark.llm import nearest


def recall(rows, ids, x, queries, k):
    hit = total = 0
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    for q in queries:
        a = x[ids.index(q)]
        want = sorted(((-float(np.dot(a, b)), i) for i, b in zip(ids, x) if i != q))[:k]
        got = sorted(by.get(q, []), key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, len(want) + 1))
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        assert all(abs(r.score - float(np.dot(a, x[ids.index(r.vec_id)]))) < 1e-12 for r in got)
        hit += len({i for _, i in want} & {r.vec_id for r in got})
        total += len(want)
    assert set(by) <= set(queries)
    return hit / total


def test_sample(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], [np.array(r.embedding, float) for r in rows]
    assert recall(nearest.query(spark, d).collect(), ids, x, [i for i in ids if i % 20 == 0], 20) >= 0.95


def test_many_lists_and_blocks(spark):
    r = np.random.default_rng(2)
    mid = r.standard_normal((40, 32)) * 2
    x = (mid[r.integers(0, 40, 6000)] + r.standard_normal((6000, 32)) * 0.4).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1000:1600] = x[1000]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, score int")
    rows = nearest.search(df, F.col("vec_id") % 50 == 0, sample=1500, block=200, chunk=50).collect()
    x = [v.astype(float) for v in x]
    assert recall(rows, list(range(6000)), x, list(range(0, 6000, 50)), 20) >= 0.95
    near = sorted((r for r in rows if r.query_id == 1050), key=lambda r: r.rank)
    assert [r.vec_id for r in near] == list(range(1000, 1020))


def test_cases(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 1.0]), (7, [1.0]), (20, [1.0, 0.0]), (40, None), (8, [2.0, -1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in nearest.search(df, F.col("vec_id") % 20 == 0).collect()}
    assert got == {(0, 1): (8, 2.0), (0, 2): (6, 1.0), (0, 3): (20, 1.0), (20, 1): (8, 2.0), (20, 2): (0, 1.0), (20, 3): (6, 1.0)}
    assert nearest.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest.search(df.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0
