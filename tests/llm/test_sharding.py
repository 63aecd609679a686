import zlib
from collections import Counter

from pyspark.sql import functions as F

from rulespark.llm import sharding


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sharding.query(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    n = Counter(r.shard for r in rows)
    assert set(n) == set(range(40)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))


def test_movement(spark):
    """With slack, one more shard moves little more than the share it takes."""
    df = spark.range(20000)
    a = sharding.shard_rows(df, F.col("id"), 10, 128, 0.25).select("id", F.col("shard").alias("a"))
    b = sharding.shard_rows(df, F.col("id"), 11, 128, 0.25).select("id", F.col("shard").alias("b"))
    moved = a.join(b, "id").where("a <> b").count()
    assert 1000 < moved < 5000
    assert max(r["count"] for r in a.groupBy("a").count().collect()) <= 2501


def test_cases(spark, tmp_path):
    docs = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "é", 3)] + [(7, "x", 4)] * 100
    spark.createDataFrame(docs, "doc_id long, text string, shard int").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sharding.query(spark, str(tmp_path)).collect()
    assert len(rows) == 104 and {r["count"] for r in sharding.query(spark, str(tmp_path)).groupBy("shard").count().collect()} == {2, 3}
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id is None} == {(16, None)}
    assert sharding.shard_rows(spark.createDataFrame([], "id long"), F.col("id")).count() == 0


def test_clashing_columns(spark):
    out = sharding.shard_rows(spark.createDataFrame([(1, 5, 6)], "id long, shard int, slot int"), F.col("id"), 3)
    assert out.columns == ["id", "shard", "slot"] and out.first()["slot"] == 0


def test_names_used_inside_are_carried_along(spark):
    names = ["id", "_at", "_cell", "_arc", "_rank", "_run", "_runs", "_first", "_nodes", "_row", "_key", "Shard"]
    out = sharding.shard_rows(spark.createDataFrame([tuple(range(12))], ", ".join(f"{n} long" for n in names)), F.col("id"), 3)
    assert out.columns == [*names[:-1], "shard", "slot"]
    assert out.first()[:11] == tuple(range(11))


def test_walk_of_the_ring(spark):
    """Against a walk from node to node: own arcs first, then what overflows goes on clockwise."""
    places = sharding.ring(spark, 5, 8)
    at = {r.id: r.at for r in spark.range(500).select("id", F.pmod(F.xxhash64(F.lit("key"), "id"), F.lit(sharding.RING)).alias("at")).collect()}
    left, want, over = {s: 100 for s in range(5)}, {}, []
    of_arc = {k: [] for k in range(len(places))}
    for i in sorted(at, key=lambda i: (at[i], i)):
        of_arc[next((k for k, (p, _) in enumerate(places) if p >= at[i]), 0)].append(i)
    for k, ids in of_arc.items():
        for i in ids:
            if left[places[k][1]]:
                left[places[k][1]] -= 1
                want[i] = places[k][1]
            else:
                over.append((k, i))
    for k, i in over:
        while not left[places[k][1]]:
            k = (k + 1) % len(places)
        left[places[k][1]] -= 1
        want[i] = places[k][1]
    got = {r.id: r.shard for r in sharding.shard_rows(spark.range(500), F.col("id"), 5, 8).collect()}
    assert got == want
