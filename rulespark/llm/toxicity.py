"""Toxicity from subword bags: averaged embeddings into a linear softmax.

A word is the bag of its character n-grams (3 to 5 bytes of "<word>", and the
whole of it), each an embedding in a hashed table; its vector is their mean.  A
text is read in spans of `span` words; a span's words are averaged and go into a
linear softmax over (clean, toxic).  The document's log odds are the mean over
its spans weighted by the softmax of their own log odds, so a short insult in a
long text still counts; a word like the one before it weighs nothing.
Misspellings share n-grams, hence vectors.

Embeddings and softmax are trained jointly in numpy on at most `most_docs`
labelled texts of up to `most_bytes` bytes, chosen by a hash of the id; every
text is scored whole.  Null, empty and wordless texts get the bias alone.
Null labels are not learned from.  Without both labels the score is the share
of toxic labels (0 if none).  Repeated rows get equal scores; an id with several
texts is learned from by the first of them in order, toxic if any label says so.
An empty table gives no rows.  Other columns are carried along; one named like
the score (as_col) is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytewords import LOWER, NOT_SPACE, U, batches, buffer_of, mix, run_hashes, word_bounds
from .wordcache import WordRows

SIZES = (3, 4, 5)


def ngrams(words: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the words' n-grams, word after word, and where each word begins."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    buf = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8)
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    left = ends[owner] - np.arange(len(buf))
    codes = buf.astype(U) + U(1)
    keys, whose = [], []
    for n in SIZES:
        at = np.flatnonzero(left >= n)
        keys.append(run_hashes(codes, n)[at])
        whose.append(owner[at])
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(codes * U(0x9E3779B97F4A7C15) + (size[owner] - left).astype(U)), dtype=U)])
    keys.append(mix(total[ends] - total[ends - size] + U(77)))
    whose.append(np.arange(len(words)))
    key, who = np.concatenate(keys), np.concatenate(whose)
    order = np.argsort(who, kind="stable")
    return (key[order] >> U(64 - bits)).astype(np.int64), np.searchsorted(who[order], np.arange(len(words) + 1))


def fresh(row: np.ndarray) -> np.ndarray:
    """0 for a word like the one before it, so that a run of one word weighs as one; else 1."""
    out = np.ones(len(row))
    out[1:] = row[1:] != row[:-1]
    return out


def spans_of(first: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the spans of all texts, and the first span of each text."""
    n = -(-np.diff(first) // span)
    upto = np.concatenate([[0], np.cumsum(n)])
    k = np.arange(upto[-1]) - np.repeat(upto[:-1], n)
    starts = np.repeat(first[:-1], n) + k * span
    return np.append(starts, first[-1]), upto


class SubwordBags:
    def __init__(self, bits: int = 17, dim: int = 8, span: int = 8, seed: int = 5):
        r = np.random.default_rng(seed)
        self.bits, self.span = bits, span
        self.emb = np.zeros((1 << bits, dim))
        self.out = r.standard_normal((dim, 2)) * 0.5
        self.bias = np.zeros(2)
        self.trained = False

    def word_odds(self, words: list[bytes]) -> np.ndarray:
        """A word's share in the log odds of toxic to clean: its vector times the softmax weights."""
        at, first = ngrams(words, self.bits)
        part = (self.emb @ (self.out[:, 1] - self.out[:, 0]))[at]
        return (np.add.reduceat(part, first[:-1]) / np.diff(first))[:, None]

    def pool(self, odds: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log odds of each text; its spans' bounds, first spans and weights.  A repeated word must have odds 0."""
        bounds, upto = spans_of(first, self.span)
        total = np.concatenate([[0.0], np.cumsum(odds, dtype=np.float64)])
        b = self.bias[1] - self.bias[0]
        z = (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(1, np.diff(bounds)) + b
        full = np.flatnonzero(np.diff(upto))
        out, weight = np.full(len(first) - 1, b), np.zeros(len(z))
        if len(full):
            begin, n = upto[full], np.diff(upto)[full]
            e = np.exp(z - np.repeat(np.maximum.reduceat(z, begin), n))
            weight = e / np.repeat(np.add.reduceat(e, begin), n)
            out[full] = np.add.reduceat(weight * z, begin)
        return out, bounds, upto, weight

    def fit(self, texts: list[bytes], toxic: np.ndarray, steps: int = 160, rate: float = 0.1, decay: float = 4e-6, block: int = 1 << 14) -> SubwordBags:
        """Adam over all texts; n-grams are gone through in blocks of words, so that memory is theirs in 32 bits and little more."""
        known: dict[bytes, int] = {}
        rows, sizes = [], [0]
        for t in texts:
            rows.append(np.array([known.setdefault(w, len(known)) for w in t.split()], np.int32))
            sizes.append(len(rows[-1]))
        if not known:
            return self
        row, begin, words = np.concatenate(rows), np.cumsum(sizes), list(known)
        del known, rows
        grams = []
        for a in range(0, len(words), block):
            at, first = ngrams(words[a : a + block], self.bits)
            grams.append((a, at.astype(np.int32), first))
        n_words = len(words)
        del words
        y, new = np.asarray(toxic, float), fresh(row)
        params = {"emb": self.emb, "out": self.out, "bias": self.bias}
        m, v = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2))
        class_weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        odds = np.empty(n_words)
        for step in range(1, steps + 1):
            way = self.out[:, 1] - self.out[:, 0]
            each = self.emb @ way
            for a, at, first in grams:
                odds[a : a + len(first) - 1] = np.add.reduceat(each[at], first[:-1]) / np.diff(first)
            z, bounds, upto, weight = self.pool(odds[row] * new, begin)
            dz = (1 / (1 + np.exp(-z)) - y) * class_weight
            per_span = np.repeat(dz, np.diff(upto)) * weight / np.maximum(1, np.diff(bounds))
            per_word = np.bincount(row, np.repeat(per_span, np.diff(bounds)) * new, n_words)
            cells = np.zeros(len(self.emb))
            for a, at, first in grams:
                size = np.diff(first)
                cells += np.bincount(at, np.repeat(per_word[a : a + len(size)] / size, size), len(cells))
            side = np.array([-1.0, 1.0])
            g = {"emb": cells[:, None] * way + decay * self.emb, "out": (self.emb.T @ cells)[:, None] * side, "bias": dz.sum() * side}
            for k, x in g.items():
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        self.trained = True
        return self


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_docs: int = 3000, most_bytes: int = 20000) -> SubwordBags:
    """Learns from labels joined with their texts; a third of the sample is toxic if there are as many."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_y")).withColumn("_h", F.xxhash64(F.lit("train"), id_col))
    # Twice as many ids as texts wanted, since some have no text or a long one; only their texts are read out, nothing is shuffled.
    most = {1: most_docs // 3, 0: most_docs - most_docs // 3}
    some = known.where("_y = 1").orderBy("_h").limit(2 * most[1]).unionByName(known.where("_y = 0").orderBy("_h").limit(2 * most[0])).collect()
    chosen = docs.sparkSession.createDataFrame([(r[id_col], int(r["_y"]), r["_h"]) for r in some], f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, _y int, _h long")
    rows = docs.where(F.col(text_col).isNotNull() & (F.octet_length(text_col) <= most_bytes)).select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col)
    # An id with several texts is learned from by the first of them in order.
    one = rows.groupBy("_y", "_h", id_col).agg(F.min("text").alias("text")).withColumn("_n", F.row_number().over(W.partitionBy("_y").orderBy("_h", id_col)))
    got = one.where(F.col("_n") <= F.when(F.col("_y") == 1, most[1]).otherwise(most[0])).orderBy("_y", "_n").select("_y", "text").collect()
    y = np.array([r["_y"] for r in got], float)
    model = SubwordBags()
    if len(y) and 0 < y.mean() < 1:
        return model.fit([LOWER[np.frombuffer(r.text.encode(), np.uint8)].tobytes() for r in got], y)
    share = y.mean() if len(y) else 0.0
    model.bias[:] = (0.0, 50.0) if share == 1 else (50.0, 0.0)
    return model


def predict(docs: DataFrame, model: SubwordBags, text_col: str = "text", keep: list[str] | None = None, as_col: str = "toxicity") -> DataFrame:
    """docs (its columns in keep; all by default) with as_col double, 0 to 1."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != as_col]
    held = docs.sparkSession.sparkContext.broadcast({"way": (model.emb @ (model.out[:, 1] - model.out[:, 0])).astype(np.float32), "model": (model.bits, model.span, model.bias)})
    src = docs.select(*{c: None for c in [*keep, text_col]})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name in keep) + f", `{as_col}` double"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, span, bias = held.value["model"]
        net, names = SubwordBags(bits, 1, span), list(keep)
        net.emb, net.out, net.bias = held.value["way"][:, None], np.array([[0.0, 1.0]]), bias
        cache = WordRows(net.word_odds, 1)
        for batch, buf, offs in batches(rows, text_col):
            buf = LOWER[buf]
            starts, ends, first = word_bounds(buf, offs, NOT_SPACE)
            row = cache.rows(buf, starts, ends)
            z = net.pool(cache.values[row, 0] * fresh(row), first)[0]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names] + [pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=[*names, as_col])

    return src.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels.where(~held_out()))
    out = predict(docs, model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
