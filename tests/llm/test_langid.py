import zlib

import numpy as np

from rulespark.llm import langid


def test_gradient_matches_differences():
    net = langid.BiGru(["a", "b", "c"], embed=3, hidden=4)
    net.w = {k: x.astype(np.float64) for k, x in net.w.items()}
    words, y = [b"ab", b"xyz", b"q"], np.array([0, 2, 1])
    _, g = net.gradient(words, y)
    for k in net.w:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        keep, d = net.w[k][at], 1e-4
        net.w[k][at] = keep + d
        up = net.gradient(words, y)[0]
        net.w[k][at] = keep - d
        down = net.gradient(words, y)[0]
        net.w[k][at] = keep
        assert abs((up - down) / (2 * d) - g[k][at]) < 2e-3


def test_every_position_has_a_distribution():
    p, letter = langid.BiGru(["a", "b"]).positions([b"xyz", b"1"])
    assert p.shape == (5, 2, 2) and np.allclose(p.sum(axis=2), 1, atol=1e-5)
    assert letter.sum(axis=0).tolist() == [3, 0]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()), per_lang=80, steps=250)
    out = langid.predict(docs.where(langid.held_out()), model).select("doc_id", "lang", "lang_pred", "lang_score", "text").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and 0 <= r.lang_score <= 1 for r in out)
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95


def test_cases(spark):
    docs = [(1, "the cat sat", "en"), (2, "le chat noir", "fr"), (3, None, "en"), (4, "", None), (5, "12 34!", "fr"), (6, "É", None), (7, "—", None), (None, "THE CAT " * 40000, "en"), (8, "x" * 100000, None), (1, "the cat sat", "en")]
    df = spark.createDataFrame([(*d, "c", 1.0) for d in docs], "doc_id long, text string, lang string, lang_pred string, n double")
    rows = langid.predict(df, langid.train(df, steps=20)).collect()
    by = {r.doc_id: (r.lang_pred, r.lang_score) for r in rows}
    assert len(rows) == len(docs)
    assert [by[k] for k in (3, 4, 5, 7)] == [("und", 0.0)] * 4
    assert all(by[k][0] in ("en", "fr") for k in (1, 2, 6, 8, None))
    assert len({(r.lang_pred, r.lang_score) for r in rows if r.doc_id == 1}) == 1


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "word", None)], "doc_id long, text string, lang string")
    assert langid.predict(df, langid.train(df)).first()["lang_pred"] == "und"
    assert langid.predict(df.limit(0), langid.train(df.limit(0))).count() == 0


def test_document_scores_word_by_word(spark):
    """A document's distribution is the mean over its letters, read off the network word by word."""
    model = langid.BiGru(["a", "b", "c"])
    texts = ["Ein kurzer Text, mit Zahl 12", "é", "w" * 100 + " x", "12 34", None]
    rows = {r.doc_id: r for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, t in enumerate(texts):
        p, letters = np.zeros(3), 0
        for w in (t or "").translate(langid.FOLD).encode().split():
            for at in range(0, len(w), model.reach):
                each, mask = model.positions([w[at : at + model.reach]])
                p += (each[:, 0] * mask[:, 0, None]).sum(axis=0)
                letters += mask[:, 0].sum()
        if not letters:
            assert (rows[k].lang_pred, rows[k].lang_score) == ("und", 0.0)
        else:
            assert rows[k].lang_pred == model.labels[int(p.argmax())]
            assert abs(rows[k].lang_score - p.max() / letters) < 1e-4
