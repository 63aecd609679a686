import corpus_pipeline as P
from rulespark.llm import decontaminate, ngram_join


def test_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen, columns = {r.doc_id for r in docs.collect()}, docs.columns
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, P.written(stage(spark, docs, sf))
        assert docs.columns == columns, name
        kept = [r.doc_id for r in docs.collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= seen
        if name == "language_id":
            assert len(kept) >= 0.97 * len(seen)
        if name == "ngram_jaccard_join":
            found = {r.component_id for r in ngram_join.join(before).collect()}
            assert set(kept) == found
        if name == "benchmark_decontamination":
            marked = decontaminate.mark(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
            assert set(kept) == {r.doc_id for r in marked if not r.leak.spans}
        seen = set(kept)
    pieces = P.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in pieces} == seen


def test_cases(spark, tmp_path, sf):
    """Nulls, repeated ids and rows, a very long text, columns with clashing names; then empty tables."""
    base = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in base.collect()]
    one, two = rows[0], rows[1]
    more = [(None, one[1], one[2], one[3], 1), (9001, None, "en", "x", 0), (9002, "", "en", "x", 0), one, (two[0], two[1] + " and other words", *two[2:]), (9003, (two[1] + " ") * 300, *two[2:])]
    extra = [(*r, "mine", 1.5, "c", 7) for r in rows + more]
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity string, lang_score double, leak string, place int"
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/a/{t}.parquet")
    docs = spark.createDataFrame(extra, schema)
    for name, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, f"{tmp_path}/a"))
        assert [f.name for f in docs.schema] == schema.replace(",", "").split()[::2], name
        assert {(r.toxicity, r.lang_score, r.leak, r.place) for r in docs.select("toxicity", "lang_score", "leak", "place").distinct().collect()} == {("mine", 1.5, "c", 7)}
    kept = [r.doc_id for r in docs.collect()]
    assert 9001 not in kept and 9002 not in kept and kept.count(one[0]) <= 1
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/b/{t}.parquet")
    assert P.run(spark, f"{tmp_path}/b").count() == 0
