import json

from rulespark.sources import corpus
from rulespark.streaming import metrics


def test_corpus(spark, tmp_path):
    for p, t in {"a/x.txt": "one", "a/y.md": "two", "_skip/z.txt": "no", "a/.h/w.txt": "no", "a/b.bin": "no"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    root = f"file:{tmp_path}"
    assert sorted(r.text for r in corpus.texts(spark, root).collect()) == ["one", "two"]
    assert sorted(r.size for r in corpus.discover(spark, root).collect()) == [3, 3]


def test_rules_and_logs(spark, tmp_path):
    for k, g in enumerate(([{"rule_id": "a"}, {"rule_id": "b"}], {"rules": [{"rule_id": "c"}]}, {"rule_id": "d", "rule_name": "n"}, {"business_rules": [{"rule_id": "e"}]})):
        (tmp_path / f"g{k}.json").write_text(json.dumps(g))
    assert sorted(r.rule_id for r in corpus.rules(spark, str(tmp_path)).collect()) == list("abcde")
    lines = spark.createDataFrame([('[LLM_COST] {"model": "m", "cost": 0.5}',), ("other",), ("[LLM_COST] broken",)], "value string")
    assert sorted((r.model or "", r.cost) for r in corpus.cost_lines(lines).collect() if r.cost) == [("m", 0.5)]
    (tmp_path / "log.jsonl").write_text('{"key": "k", "seq": 1, "v": "old"}\n{"key": "k", "seq": 2, "v": "new"}\n')
    assert [r.v for r in corpus.latest(spark, str(tmp_path / "log.jsonl")).collect()] == ["new"]


def test_stream_equals_table(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    want = sorted(map(tuple, metrics.stage_metrics(events).collect()))
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = metrics.stage_metrics(stream).writeStream.outputMode("complete").format("memory").queryName("metrics_test").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("metrics_test").collect())) == want
