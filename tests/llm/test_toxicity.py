import numpy as np

from rulespark.llm import toxicity


def test_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = toxicity.query(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").collect()
    y, z = np.array([r.toxic for r in out]), np.array([r.score for r in out])
    assert ((z >= 0) & (z <= 1)).all()
    assert np.mean([(r.score >= 0.5) == r.predicted for r in out]) == 1
    assert z[y == 1].mean() > z[y == 0].mean() + 0.1


def test_misspellings_share_vectors():
    r = np.random.default_rng(3)
    words = [bytes(r.integers(97, 123, r.integers(3, 8)).tolist()) for _ in range(3000)]
    plain = [b" ".join(words[k] for k in r.integers(0, 3000, 40)) for _ in range(300)]
    model = toxicity.SubwordBags().fit(plain + [p + b" idiots " + q for p, q in zip(plain, plain[::-1])], np.repeat([0, 1], 300))
    odds = model.word_odds([b"idiots", b"idiotz", b"xqzvkw"])[:, 0]
    assert odds[0] > odds[1] > odds[2] + 0.5


def test_cases(spark):
    docs = [(1, "nice words here"), (2, "awful idiot words"), (3, None), (4, ""), (5, " \n"), (6, "word " * 200000 + "idiot"), (None, "x"), (2, "awful idiot words")]
    df = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, toxicity double")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (9, 1), (4, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    rows = toxicity.predict(df, model).collect()
    by = {r.doc_id: r.toxicity for r in rows}
    assert len(rows) == len(docs) and all(0 <= x <= 1 for x in by.values())
    assert by[2] > by[1] and by[3] == by[4] == by[5]
    only = toxicity.predict(df, toxicity.train(df, labels.where("toxic = 0"))).collect()
    assert all(r.toxicity < 1e-9 for r in only)
    assert toxicity.predict(df.limit(0), model).count() == 0


def test_scores_against_spans_one_by_one(spark):
    """The model's own word vectors, averaged over spans and pooled in plain Python."""
    model = toxicity.SubwordBags(span=3)
    r = np.random.default_rng(8)
    model.emb, model.bias = r.standard_normal(model.emb.shape), np.array([0.2, -0.1])
    way, b = model.out[:, 1] - model.out[:, 0], model.bias[1] - model.bias[0]
    texts = ["", "one", "One two three four five six seven", "same same same other same", "é ü  x\ty"]
    got = {r.doc_id: r.toxicity for r in toxicity.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, t in enumerate(texts):
        words = [w.encode() for w in t.lower().split()]
        odds = []
        for j, w in enumerate(words):
            at, _ = toxicity.ngrams([w], model.bits)
            odds.append(0.0 if j and words[j - 1] == w else float(model.emb[at].mean(axis=0) @ way))
        z = [sum(odds[a : a + 3]) / len(odds[a : a + 3]) + b for a in range(0, len(odds), 3)] or [b]
        e = np.exp(np.array(z) - max(z))
        total = float((e / e.sum() * z).sum())
        assert abs(got[k] - 1 / (1 + np.exp(-total))) < 1e-4


def test_an_id_of_several_texts_is_learned_from_by_its_first(spark):
    docs = spark.createDataFrame([(1, "fine")] * 3 + [(1, "aaa"), (2, "bad"), (3, "ok"), (4, "x" * 30000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1)], "doc_id long, toxic int")
    kept = []
    fit = toxicity.SubwordBags.fit
    try:
        toxicity.SubwordBags.fit = lambda self, texts, toxic, *a: kept.append(sorted(zip(texts, toxic))) or fit(self, texts, toxic, 3)
        toxicity.train(docs, labels)
    finally:
        toxicity.SubwordBags.fit = fit
    assert kept == [[(b"aaa", 0.0), (b"bad", 1.0), (b"ok", 0.0)]]


def test_blocks_of_words_change_nothing():
    texts, y = [b"a bad word here", b"some good words there", b"worse words", b""], np.array([1, 0, 1, 0])
    a = toxicity.SubwordBags(bits=10).fit(texts, y, steps=20)
    b = toxicity.SubwordBags(bits=10).fit(texts, y, steps=20, block=2)
    assert np.allclose(a.emb, b.emb) and np.allclose(a.bias, b.bias)


def test_clashing_columns(spark):
    model = toxicity.SubwordBags()
    df = spark.createDataFrame([(1, "x", "mine")], "doc_id long, text string, toxicity string")
    assert toxicity.predict(df, model, as_col="score").first()["toxicity"] == "mine"
    assert isinstance(toxicity.predict(df, model).first()["toxicity"], float)
