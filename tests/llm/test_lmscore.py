import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from rulespark.llm import lmscore

PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
HELD = "pmod(crc32(cast(doc_id as string)), 10) = 0"


def base(docs):
    toks = [[*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for _, t in docs]
    out = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs]
    c = Counter(w for t, o in zip(toks, out) if not o for w in t)
    n, v = sum(c.values()), len(c)
    return [(i, o, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for (i, _), t, o in zip(docs, toks, out)]


def same(rows, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


def small(ids=12, **kw):
    pairs = (np.array([1, 2, -1]), np.array([2, 1, 3]), np.array([5.0, 2.0, 4.0]))
    return lmscore.AttentionLM(np.arange(ids)[::-1] * 3.0, pairs, 0, groups=3, outputs=min(8, ids - 1), inputs=6, dim=6, window=6, stride=4, **kw)


def test_gradient_matches_differences():
    net = small()
    net.w = {k: x.astype(np.float64) for k, x in net.w.items()}
    r = np.random.default_rng(1)
    x, y, mask = r.integers(0, net.start + 1, (3, 6)), r.integers(0, net.classes, (3, 6)), r.random((3, 6)) > 0.2
    _, g = net.gradient(x, y, mask)
    for k in net.w:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        keep, d, loss = net.w[k][at], 1e-4, []
        for s in (d, -d):
            net.w[k][at] = keep + s
            loss.append(net.gradient(x, y, mask)[0])
        net.w[k][at] = keep
        assert abs((loss[0] - loss[1]) / (2 * d) - g[k][at]) < 1e-3


def test_probabilities_add_up():
    """Over all texts of two ids and an end, with whatever comes first."""
    net = small(5)
    total = 0.0
    for text in [[], *([a] for a in range(1, 5))]:
        ids = np.array([*text, 0])
        total += 10 ** net.score(ids, np.array([0, len(ids)]))[0]
    for a in range(1, 5):
        total += sum(10 ** net.score(np.array([a, b, 0]), np.array([0, 3]))[0] / max(1e-30, 10 ** (net.score(np.array([a, b, 0]), np.array([0, 3]))[0] - prefix(net, [a, b]))) for b in range(1, 5))
    assert total == pytest.approx(1, abs=1e-4)


def prefix(net, ids):
    """log10 probability of the first ids of a text."""
    ids = np.array(ids)
    x, y = net.inputs(ids, np.array([0, len(ids)])), net.cls[ids]
    z = net.logits(np.pad(x, (0, 6 - len(x)))[None], 0)[0, : len(ids)]
    return float((z[np.arange(len(ids)), y] - np.log(np.exp(z).sum(axis=1)) + net.share[x, net.symbol[ids]] + net.within[ids]).sum() / np.log(10))


def test_windows_score_each_id_once_and_alike():
    net, r = small(), np.random.default_rng(2)
    texts = [r.integers(1, 12, n) for n in (0, 1, 5, 6, 7, 30)]
    ids = np.concatenate([[*t, 0] for t in texts])
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    together = net.score(ids, first)
    for k, t in enumerate(texts):
        alone = np.array([*t, 0])
        assert together[k] == pytest.approx(net.score(alone, np.array([0, len(alone)]))[0], rel=1e-4)
        # Step by step: position p is scored from the start of its window.
        x, total = net.inputs(alone, np.array([0, len(alone)])), 0.0
        for p in range(len(alone)):
            s = 0 if p < 6 else 4 * (-(-(p - 5) // 4))
            z = net.logits(np.pad(x[s : p + 1], (0, 6 - (p + 1 - s)))[None], 0)[0, p - s]
            total += z[net.cls[alone[p]]] - np.log(np.exp(z).sum()) + net.share[x[p], net.symbol[alone[p]]] + net.within[alone[p]]
        assert together[k] == pytest.approx(total / np.log(10), rel=1e-4)


def test_sample(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = lmscore.query(spark, sf).collect()
    same(rows, base(docs))
    assert all(r.score < 0 for r in rows)


def test_cases(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "HEAD", 4)
    docs = [(1, None), (2, ""), (3, "A a\x0bb c"), (4, "a b " * 20000), (None, "z z y"), (7, "x"), (7, "x"), (8, "<|endoftext|> né")] + [(100 + k, "b q") for k in range(40)]
    df = spark.createDataFrame([(*d, 0.0, True) for d in docs], "doc_id long, text string, score double, held_out boolean")
    rows = lmscore.score(df, PATH, HELD, steps=5).collect()
    same(rows, base(docs))
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert lmscore.score(df.limit(0), PATH, HELD).count() == 0


def test_pairs_are_counted_in_all_texts(spark, monkeypatch):
    """Also in texts whose windows are not in the sample, across words as within."""
    from tokenizers import Tokenizer

    kept = []

    make = lmscore.AttentionLM.__init__

    def init(net, counts, pairs, *args):
        make(net, counts, pairs, *args)
        kept.append((net, pairs))

    monkeypatch.setattr(lmscore.AttentionLM, "__init__", init)
    docs = [(k, t) for k, t in enumerate(["red fish, blue fish", "", None, "Unquestionably né", "one two three " * 3000, *[f"word{k} follows word{k % 7}" for k in range(60)]])]
    lmscore.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), PATH, HELD, most_windows=2, steps=1)
    net, pairs = kept[0]
    tokenizer, want = Tokenizer.from_file(PATH), Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 10:
            ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 49407]
            want.update(zip([net.start, *net.inp[ids[:-1]].tolist()], net.symbol[ids].tolist(), strict=True))
    assert isinstance(pairs, np.ndarray)
    at = np.nonzero(pairs)
    assert dict(zip(zip(*(x.tolist() for x in at), strict=True), pairs[at].tolist(), strict=True)) == want


def test_weights_come_from_every_window(spark, monkeypatch):
    """Of more windows than the start takes, each id of each training text is told once more, whatever its task; the mean by windows is what texts are scored with."""
    docs = [(k, t) for k, t in enumerate(["red fish, blue fish", "", None, "Unquestionably né", "one two three " * 3000, *[f"word{k} follows word{k % 7}" for k in range(60)]])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    kept, learn = [], lmscore.learn_all

    def spied(read, model):
        before = {k: t.copy() for k, t in model.w.items()}
        learn(read, model)
        kept.append((read, before, model))

    monkeypatch.setattr(lmscore, "learn_all", spied)
    lmscore.score(df, PATH, HELD, most_windows=2, steps=1)
    (read, before, model), = kept
    parts = read.where("train").select("ids").rdd.mapPartitions(lambda rows: [[bytes(r["ids"]) for r in rows]]).collect()
    assert sum(map(len, parts)) == sum(zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in docs)
    total, windows = {k: 0.0 for k in before}, 0
    for texts in parts:
        net = lmscore.copy.copy(model)
        net.w = {k: t.copy() for k, t in before.items()}
        told, make = [], net.gradient
        net.gradient = lambda x, y, mask: told.append(int(mask.sum())) or make(x, y, mask)
        lengths = [len(t) // 2 for t in texts]
        n = net.go_on([(np.frombuffer(b"".join(texts), "<u2").astype(np.int64), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]))])
        assert sum(told) == sum(lengths) and n == sum(-(-k // net.window) for k in lengths)
        windows += n
        total = {k: total[k] + net.w[k].astype(float) * n for k in total}
    assert windows > 2 and all(np.allclose(model.w[k], total[k] / windows, atol=1e-5) for k in total)
    assert any(not np.allclose(model.w[k], before[k]) for k in before)


def test_few_windows_are_all_gone_through():
    """No window is left out by chance where the driver takes them all."""
    net, r, seen = small(), np.random.default_rng(5), []
    x = np.tile(np.arange(500)[:, None] % 7, 6)
    make = net.gradient
    net.gradient = lambda a, b, mask: seen.append(b[:, 0]) or make(a, b % net.classes, mask)
    y = np.tile(np.arange(500)[:, None], 6)
    net.fit(x, y, r.random((500, 6)) > 0.2, steps=1, batch=64)
    assert set(np.concatenate(seen).tolist()) == set(range(500))


def test_gradient_is_the_same_by_blocks():
    """Logits are made for some positions at a time; blocks that part a window or leave a rest change nothing."""
    net, r = small(), np.random.default_rng(7)
    net.w = {k: x.astype(np.float64) for k, x in net.w.items()}
    x, y, mask = r.integers(0, net.start + 1, (9, 6)), r.integers(0, net.classes, (9, 6)), r.random((9, 6)) > 0.2
    loss, want = net.gradient(x, y, mask)
    for rows in (1, 7, 54):
        got = net.gradient(x, y, mask, rows)
        assert got[0] == pytest.approx(loss, rel=1e-9) and all(np.allclose(got[1][k], want[k], rtol=1e-9, atol=1e-12) for k in want)
    a, b = r.standard_normal((403, 5)), r.standard_normal((5, 3))
    assert all(np.allclose(lmscore.times(a[:n], b), a[:n] @ b) for n in (0, 1, 191, 192, 403))


def test_words_met_again_are_kept():
    """A worker's words outlive tasks and thinning: ids stay right, and a word met again and again is cut once."""
    from rulespark.llm.wordcache import WordIds

    names = np.array([f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "klmnrs"] + ["né.", "x-1", "red,"])
    kept, r, cut, most_held = lmscore.KeptIds(PATH, 40), np.random.default_rng(3), Counter(), 0
    make = kept.encode
    kept.encode = lambda words: cut.update(words) or make(words)
    for _ in range(60):
        text = f"always there {' '.join(r.choice(names, 12))}".encode()
        buf, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        got, want = kept.ids(buf, offs), WordIds(PATH).ids(buf, offs)
        assert all((a == b).all() for a, b in zip(got, want, strict=True))
        most_held = max(most_held, kept.known.n)
    assert cut["always"] == cut["there"] == 1 and most_held <= 40 + 14 + 3
    assert sum(cut.values()) > len(cut)
    assert lmscore.words_held(PATH) is lmscore.words_held(PATH)
