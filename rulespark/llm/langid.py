"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads words, each with a space on either side, as bytes in both
directions (state starts anew at each word; a word of over `reach` bytes is read
in runs of that many).  It labels every byte position with a distribution over
the languages; a document's distribution is the mean over the positions of its
letters.  Because a word's labels depend on the word alone, a worker reads each
distinct word once and remembers it (bounded cache).

It is trained in numpy by backpropagation through time on a sample of labelled
documents: about `per_lang` of each language, of up to `most_bytes` bytes each,
chosen by a hash of the id.  Inference covers every byte of every text.

Null texts and texts without a letter are `und` with score 0; so is everything
if no row has a language.  Empty table: no rows.  Repeated rows get equal
answers.  Ties go to the language that sorts first.  Other columns are carried
along; ones named like the answers (as_cols) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import LOWER, NOT_SPACE, batches, buffer_of, table, word_bounds
from .wordcache import WordRows

UNKNOWN = "und"
#: Bytes that may belong to letters: a-z and every byte of a non-ASCII character.
LETTER = table(np.zeros(256, dtype=bool))
LETTER[0x61:0x7B] = LETTER[0x80:] = True


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


class BiGru:
    """Byte embeddings, one gated layer in each direction, a softmax at every position."""

    def __init__(self, labels: list[str], embed: int = 12, hidden: int = 16, reach: int = 32, seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels, self.hidden, self.reach = labels, hidden, reach
        make = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {"emb": make(256, embed) * 4, "out": make(2 * hidden, len(labels)), "bias": np.zeros(len(labels), np.float32)}
        for d in "fb":
            self.w |= {f"x{d}": make(embed, 3 * hidden), f"h{d}": make(hidden, 3 * hidden), f"c{d}": np.zeros(3 * hidden, np.float32)}

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(steps, words) bytes with spaces around and behind; lengths with the two spaces."""
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        width = int(size.max())
        flat = b"".join(b" " + w + b" " * (width - 1 - len(w)) for w in words)
        return np.frombuffer(flat, np.uint8).reshape(len(words), width).T, size

    def one_way(self, emb: np.ndarray, size: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States after each step; the backward pass leaves the padding at state 0."""
        steps, n, _ = emb.shape
        h, k = np.zeros((n, self.hidden), np.float32), self.hidden
        wx, wh, c = self.w[f"x{d}"], self.w[f"h{d}"], self.w[f"c{d}"]
        out = np.zeros((steps, n, k), np.float32)
        gx = emb @ wx + c
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            gh = h @ wh
            zr = sigmoid(gx[t, :, : 2 * k] + gh[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            cand = np.tanh(gx[t, :, 2 * k :] + r * gh[:, 2 * k :])
            live = (t < size)[:, None].astype(np.float32)
            new = live * (z * h + (1 - z) * cand) + (1 - live) * h
            if keep is not None:
                keep.append((t, h, z, r, cand, gh[:, 2 * k :], live))
            out[t] = h = new
        return out

    def positions(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distributions (steps, words, labels) and which positions are letters."""
        x, size = self.encode(words)
        emb = self.w["emb"][x]
        both = np.concatenate([self.one_way(emb, size, "f"), self.one_way(emb, size, "b")], axis=2)
        z = both @ self.w["out"] + self.w["bias"]
        p = np.exp(z - z.max(axis=2, keepdims=True))
        return p / p.sum(axis=2, keepdims=True), LETTER[x]

    def gradient(self, words: list[bytes], labels: np.ndarray) -> tuple[float, dict]:
        """Mean loss over the letters and its gradient, through time."""
        x, size = self.encode(words)
        emb, k = self.w["emb"][x], self.hidden
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self.one_way(emb, size, d, kept[d]) for d in "fb"], axis=2)
        z = both @ self.w["out"] + self.w["bias"]
        p = np.exp(z - z.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        mask = LETTER[x].astype(np.float32) / max(1, LETTER[x].sum())
        rows = np.arange(len(words))
        loss = -float((np.log(p[:, rows, labels] + 1e-9) * mask).sum())
        dz = p
        dz[:, rows, labels] -= 1
        dz *= mask[:, :, None]
        g = {"out": np.einsum("tnh,tnl->hl", both, dz), "bias": dz.sum(axis=(0, 1))}
        dboth = dz @ self.w["out"].T
        demb = np.zeros_like(emb)
        for d, part in (("f", dboth[:, :, :k]), ("b", dboth[:, :, k:])):
            wx, wh = self.w[f"x{d}"], self.w[f"h{d}"]
            gwx, gwh, gc, dh = np.zeros_like(wx), np.zeros_like(wh), np.zeros(3 * k, np.float32), np.zeros((len(words), k), np.float32)
            for t, h, zt, r, cand, ghc, live in reversed(kept[d]):
                dh = dh + part[t]
                dn = dh * live
                dzt, dc = dn * (h - cand) * zt * (1 - zt), dn * (1 - zt) * (1 - cand**2)
                dr = dc * ghc * r * (1 - r)
                dgx = np.concatenate([dzt, dr, dc], axis=1)
                dgh = np.concatenate([dzt, dr, dc * r], axis=1)
                gwx += emb[t].T @ dgx
                gwh += h.T @ dgh
                gc += dgx.sum(axis=0)
                demb[t] += dgx @ wx.T
                dh = dn * zt + dh * (1 - live) + dgh @ wh.T
            g |= {f"x{d}": gwx, f"h{d}": gwh, f"c{d}": gc}
        ge = np.zeros_like(self.w["emb"])
        np.add.at(ge, x.ravel(), demb.reshape(-1, demb.shape[2]))
        return loss, g | {"emb": ge}

    def fit(self, words: list[list[bytes]], steps: int = 700, batch: int = 384, rate: float = 0.01, seed: int = 11) -> BiGru:
        """Adam on minibatches with as many words of each label."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        have = [k for k, x in enumerate(words) if x]
        for step in range(1, steps + 1):
            y = np.array(have)[r.integers(0, len(have), batch)]
            _, g = self.gradient([words[k][int(r.integers(0, len(words[k])))] for k in y], y)
            lr = rate * min(1, step / 50) * (1 - step / (steps + 1))
            for k, x in g.items():
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.w[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
        return self

    def sums(self, words: list[bytes]) -> np.ndarray:
        """For each word the sum of its letters' distributions, and their number."""
        cut = [(k, w[a : a + self.reach]) for k, w in enumerate(words) for a in range(0, len(w), self.reach)]
        out = np.zeros((len(words), len(self.labels) + 1), np.float32)
        order = sorted(range(len(cut)), key=lambda k: len(cut[k][1]))
        for a in range(0, len(order), 1024):
            part = [cut[k] for k in order[a : a + 1024]]
            p, letter = self.positions([w for _, w in part])
            where = np.array([k for k, _ in part])
            np.add.at(out, where, np.concatenate([(p * letter[:, :, None]).sum(axis=0), letter.sum(axis=0)[:, None]], axis=1))
        return out


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, most_bytes: int) -> list:
    """About per_lang (text, lang) of each language, by a hash of the id."""
    ok = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.octet_length(text_col) <= most_bytes))
    n = {r[0]: r[1] for r in ok.groupBy(lang_col).count().collect()}
    if not n:
        return []
    share = F.element_at(F.create_map(*[x for k, c in n.items() for x in (F.lit(k), F.lit(min(1.0, per_lang / c)))]), F.col(lang_col))
    chosen = ok.where(F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 20)) < share * (1 << 20))
    return chosen.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h")).orderBy("h").limit(2 * per_lang * len(n)).collect()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 250, most_bytes: int = 20000, steps: int = 700) -> BiGru:
    rows = sample(docs, id_col, text_col, lang_col, per_lang, most_bytes)
    labels = sorted({r.lang for r in rows})
    words: list[list[bytes]] = [[] for _ in labels]
    for r in rows:
        words[labels.index(r.lang)] += [w[:32] for w in r.text.translate(FOLD).encode().split() if LETTER[list(w)].any()]
    model = BiGru(labels)
    return model.fit(words, steps) if len(labels) > 1 and any(words) else model


#: A-Z to a-z, and nothing else.
FOLD = {k: k + 32 for k in range(65, 91)}


def has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Of folded texts."""
    ascii_, other = np.zeros(len(buf) + 1, np.int64), np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf >= 0x61) & (buf < 0x7B), out=ascii_[1:])
    np.cumsum(buf >= 0x80, out=other[1:])
    out = ascii_[offs[1:]] > ascii_[offs[:-1]]
    for k in np.flatnonzero(~out & (other[offs[1:]] > other[offs[:-1]])):
        out[k] = any(c.isalpha() for c in buf[offs[k] : offs[k + 1]].tobytes().decode())
    return out


def predict(docs: DataFrame, model: BiGru, text_col: str = "text", keep: list[str] | None = None, as_cols: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """docs (its columns in keep; all by default) with the language and its share of the letters."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in as_cols]
    held = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*{c: None for c in [*keep, text_col]})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name in keep) + f", `{as_cols[0]}` string, `{as_cols[1]}` double"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        labels, names = net.labels, [f for f in keep]
        cache = WordRows(net.sums, len(labels) + 1)
        for batch, buf, offs in batches(rows, text_col):
            buf = LOWER[buf]
            starts, ends, first = word_bounds(buf, offs, NOT_SPACE)
            total = np.zeros((len(starts) + 1, len(labels) + 1))
            if labels:
                row = cache.rows(buf, starts, ends)
                np.cumsum(cache.values[row], axis=0, dtype=np.float64, out=total[1:])
            doc = total[first[1:]] - total[first[:-1]]
            known = has_letter(buf, offs) & (doc[:, -1] > 0.5)
            p = doc[:, :-1] / np.maximum(doc[:, -1:], 1)
            best = p.argmax(axis=1) if labels else np.zeros(len(doc), np.int64)
            pred = [labels[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            score = np.where(known, p[np.arange(len(doc)), best], 0.0) if labels else np.zeros(len(doc))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names] + [pa.array(pred, pa.string()), pa.array(np.clip(score, 0.0, 1.0))], names=[*names, *as_cols])

    return src.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    return predict(docs, model, keep=["doc_id"]).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
