import hashlib
import re

from pyspark.sql import functions as F

from rulespark.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, leak string, item_id string"


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, n=10):
    wins = []
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        wins += [(i, tuple(w[j : j + k])) for j in range(len(w) - k + 1) if k]
    out = {}
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        by = {}
        for k in {len(x) for _, x in wins}:
            for j in range(len(w) - k + 1):
                by.setdefault(tuple(w[j : j + k]), []).append(j)
        for i, x in wins:
            for j in by.get(x, ()):
                hit.update(range(j, j + len(x)))
                found.add(str(i))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def got(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_cases(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(30))
    items = [(1, long), (2, "Short item"), (10, "été über"), (11, None), (12, ""), (3, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (2, "Short item")]
    docs = [(0, None), (1, ""), (2, "no leak here"), (3, "A, SHORT-item! été"), (4, f"x {long.upper()} y short  item"), (5, "w3 w4 w5 w6 w7 w8 w9 w10 w11"), (6, "ÉTÉ été Über été über"), (7, ("w " * 50000) + long), (8, f"x {long} "), (8, f"x {long} ")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert got(decontaminate.query(spark, str(tmp_path))) == brute(docs, items)


def test_sample(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = got(decontaminate.query(spark, sf))
    assert found == brute(docs, items) and any(x[-1] for x in found.values())


def test_blocks_agree(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one, many = (decontaminate.mark(docs, bench, most_bytes=b).select("doc_id", "leak").orderBy("doc_id").collect() for b in (1 << 20, 2000))
    assert one == many


def test_clean(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "é x A b c, y a b c", "q", "z"), (2, "clean", None, None), (3, None, None, None)], SCHEMA)
    assert {r.doc_id: r.text for r in decontaminate.clean(docs, bench, "spans").collect()} == {1: "é x , y ", 2: "clean", 3: None}
    kept = decontaminate.clean(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3] and kept.columns == docs.columns


def test_empty(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.mark(docs, bench).count() == 0
    assert decontaminate.mark(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), bench).where(F.size("leak.spans") > 0).count() == 0
