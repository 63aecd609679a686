"""Language-model scores by causal self-attention over subword ids.

An id's probability is that of its group times its share within the group.
Groups: embeddings of the input ids and of positions, one layer of causal
self-attention, and logits from its output plus a table for the last id.  Shares:
counts of pairs of ids, smoothed by the counts of ids.  So every text has a
proper probability.  Texts are read in windows of `window` ids that overlap; each
id is scored once, by the window that shows it at least `window - stride` earlier
ids (or all there are), many windows at a time.

The weights are trained in numpy by backpropagation on all windows of all training
texts.  Up to `most_windows` of them are gone through on the driver.  Of more, about
that many, chosen by a hash, give the weights a start; from there each task makes one
pass over every window of its texts, and the mean of the tasks' weights is taken, so
the weights depend (little) on how the texts are dealt over tasks.  The table for the
last id is not trained: it is made of the counts.  Counts of words, of ids and of all
pairs of ids cover all training texts; pairs are counted by what the model tells
apart, the class of the first id and the symbol of the second.  A text is cut into
ids once; the ids are written out, counted, learned from and scored.

The base score is that of smoothed word counts.  The most frequent words (at
most HEAD) are broadcast with their counts; the rest are looked up by a join.

Null and empty texts are the end mark alone.  Rows without an id are training
texts.  Repeated rows get equal scores.  Empty table: no rows.
"""

from __future__ import annotations

import copy
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import LOWER, NOT_SPACE, U, batches, mix, word_bounds, word_hashes
from .shared import written
from .wordcache import Slots, WordIds

HEAD = 1 << 19
#: A hash that stands for the end of a text among words.
END_WORD = -1
COUNT_BUFFER = 1 << 20
#: As ids are written out; the tokenizer has fewer than 2**16.
ID = np.dtype("<u2")
#: Output groups, ids that are symbols of their own, and input ids told apart.
GROUPS, OUTPUTS, INPUTS = 64, 2048, 1000
#: Logits are held within these bounds, so that their exponentials are finite and not zero in float32.
MOST_LOGIT = 80.0


def told_apart(counts: np.ndarray, groups: int = GROUPS, outputs: int = OUTPUTS, inputs: int = INPUTS) -> tuple[np.ndarray, np.ndarray]:
    """(inp, symbol) of each id: the class of an input id (the most frequent ids, and one for the rest), and its output symbol."""
    n = len(counts)
    outputs, inputs = min(outputs, n), min(inputs, n)
    order = np.argsort(-counts, kind="stable")
    # Symbols: the most frequent ids, and for each group the rest of the ids that belong to it.
    inp, symbol = np.full(n, inputs), outputs + np.arange(n) % groups
    inp[order[:inputs]] = np.arange(inputs)
    symbol[order[:outputs]] = np.arange(outputs)
    return inp, symbol


def inputs_of(inp: np.ndarray, start: int, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What precedes each id: the class of the id before it, or the start of the text."""
    x = np.empty(len(ids), np.int64)
    x[1:] = inp[ids[:-1]]
    x[first[:-1][np.diff(first) > 0]] = start
    return x


def products(a: np.ndarray, b: np.ndarray, rows: int = 384) -> np.ndarray:
    """a.T @ b of long narrow arrays, in blocks of rows, which BLAS does faster."""
    n = len(a) // rows * rows
    out = a[n:].T @ b[n:]
    if n:
        out += (a[:n].reshape(-1, rows, a.shape[1]).transpose(0, 2, 1) @ b[:n].reshape(-1, rows, b.shape[1])).sum(axis=0)
    return out


def times(a: np.ndarray, b: np.ndarray, rows: int = 192) -> np.ndarray:
    """a @ b of a long narrow array and a small one, in blocks of rows, which BLAS does faster."""
    n = len(a) // rows * rows
    out = np.empty((len(a), b.shape[1]), np.result_type(a, b))
    np.matmul(a[:n].reshape(-1, rows, a.shape[1]), b, out=out[:n].reshape(-1, rows, b.shape[1]))
    np.matmul(a[n:], b, out=out[n:])
    return out


class Adam:
    """The weights, one after the other, have one row of moments."""

    def __init__(self, w: dict):
        self.w, self.steps = w, 0
        self.m, self.v = (np.zeros(sum(t.size for t in w.values()), np.result_type(*w.values())) for _ in range(2))

    def step(self, g: dict, rate: float) -> None:
        self.steps += 1
        t = np.concatenate([g[k].ravel() for k in self.w])
        self.m += 0.1 * (t - self.m)
        self.v += 0.02 * (t * t - self.v)
        np.multiply(self.v, np.float32(1 / (1 - 0.98**self.steps)), out=t)
        np.sqrt(t, out=t)
        t += np.float32(1e-7)
        np.divide(self.m, t, out=t)
        t *= np.float32(rate / (1 - 0.9**self.steps))
        at = 0
        for w in self.w.values():
            w -= t[at : at + w.size].reshape(w.shape)
            at += w.size


class AttentionLM:
    def __init__(self, counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray] | np.ndarray, end_id: int, groups: int = GROUPS, outputs: int = OUTPUTS, inputs: int = INPUTS, dim: int = 16, window: int = 24, stride: int = 16, seed: int = 9):
        """pairs: ids (-1: the start of a text), the ids after them and how often; or the table of input classes and symbols."""
        self.window, self.stride, self.end_id, self.dim, self.classes = window, stride, end_id, dim, groups
        c = counts.astype(np.float64) + 1
        n = len(c)
        outputs, inputs = min(outputs, n), min(inputs, n)
        self.inp, self.symbol = told_apart(counts, groups, outputs, inputs)
        mass = np.bincount(self.symbol, c, outputs + groups)
        load = mass[outputs:].copy()
        group = np.concatenate([np.zeros(outputs, np.int64), np.arange(groups)])
        for k in range(outputs):
            group[k] = load.argmin()
            load[group[k]] += mass[k]
        self.cls = group[self.symbol]
        self.within = np.where(self.symbol < outputs, 0.0, np.log(c / mass[self.symbol])).astype(np.float32)
        self.start = inputs + 1
        if isinstance(pairs, tuple):
            seen = np.zeros((inputs + 2, outputs + groups), np.float32)
            x, y, m = pairs
            np.add.at(seen, (np.where(x < 0, self.start, self.inp[x]), self.symbol[y]), m)
        else:
            seen = pairs.astype(np.float32)
        by_group = seen @ (group[:, None] == np.arange(groups)).astype(np.float32)
        share = seen + (30 * mass / load[group]).astype(np.float32)
        share /= by_group[:, group] + 30
        share[:, mass == 0] = 1
        self.share = np.log(share)
        prior = (by_group + 30 * load / load.sum()) / (by_group.sum(axis=1, keepdims=True) + 30)
        r = np.random.default_rng(seed)
        make = lambda *s: (r.standard_normal(s) / np.sqrt(dim)).astype(np.float32)
        self.w = {"emb": make(self.start + 1, dim), "pos": make(window, dim) * 0.3, "q": make(dim, dim), "k": make(dim, dim), "v": make(dim, dim), "o": make(dim, dim) * 0.5, "out": make(dim, groups) * 0.3, "bias": np.zeros(groups, np.float32)}
        self.last = np.log(prior).astype(np.float32)
        self.show = np.tril(np.ones((window, window), np.float32))
        self.cells = np.arange(self.w["emb"].size).reshape(self.w["emb"].shape)
        self.scale = np.float32(dim**-0.5)

    def tables(self) -> tuple[np.ndarray, ...]:
        """What inputs and positions add to queries, keys and values and to logits, and the way from attended values to logits: `logits` without products of its own for them."""
        w = self.w
        qkv = np.concatenate([w["q"] * self.scale, w["k"], w["v"]], axis=1)
        return w["emb"] @ qkv, w["pos"] @ qkv, self.last + w["bias"] + w["emb"] @ w["out"], w["pos"] @ w["out"], w["o"] @ w["out"]

    def attended(self, qkv: np.ndarray, seen: int) -> tuple[np.ndarray, ...]:
        """Queries, keys and values as slices of qkv, the weights of what precedes each position from `seen` on, and the values they gather."""
        d, (b, t, _) = self.dim, qkv.shape
        q, k, v = qkv[:, seen:, :d], qkv[:, :, d : 2 * d], qkv[:, :, 2 * d :]
        a = q @ k.transpose(0, 2, 1)
        np.clip(a, -MOST_LOGIT, MOST_LOGIT, out=a)
        np.exp(a, out=a)
        a *= self.show[seen:]
        a /= (a.reshape(-1, t) @ np.ones(t, a.dtype)).reshape(b, t - seen, 1)
        return q, k, v, a, a @ v

    def logits(self, x: np.ndarray, seen: int, tables: tuple | None = None) -> np.ndarray:
        """For windows of inputs x, the class logits at the positions from `seen` on."""
        inputs, places, last, place, out = tables or self.tables()
        qkv = inputs.take(x, axis=0)
        qkv += places
        m = self.attended(qkv, seen)[4]
        z = times(m.reshape(-1, self.dim), out).reshape(len(x), x.shape[1] - seen, -1)
        z += place[seen:]
        z += last.take(x[:, seen:], axis=0)
        return np.clip(z, -MOST_LOGIT, MOST_LOGIT, out=z)

    def gradient(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, rows: int = 1152) -> tuple[float, dict]:
        """Mean loss over the masked positions and its gradient; logits are there for `rows` positions at a time, as many as a processor's cache holds."""
        w, d = self.w, self.dim
        flat = lambda t: t.reshape(-1, t.shape[2])
        h = w["emb"].take(x, axis=0)
        h += w["pos"]
        to_qkv = np.concatenate([w["q"] * self.scale, w["k"], w["v"]], axis=1)
        qkv = times(flat(h), to_qkv).reshape(*x.shape, 3 * d)
        q, k, v, a, m = self.attended(qkv, 0)
        r = times(flat(m), w["o"])
        r += flat(h)
        kind, groups = r.dtype, w["out"].shape[1]
        share = (mask.ravel() / max(1, mask.sum())).astype(kind)
        last, back, one = self.last + w["bias"], np.ascontiguousarray(w["out"].T), np.ones(max(groups, rows), kind)
        x, y, n = x.ravel(), y.ravel(), x.size
        g = {"out": np.zeros_like(w["out"]), "bias": np.zeros_like(w["bias"])}
        total, own, dr, of_last = np.empty(n, kind), np.empty(n, kind), np.empty_like(r), np.empty((min(n, rows), groups), last.dtype)
        for at in range(0, n, rows):
            some = slice(at, min(n, at + rows))
            p = times(r[some], w["out"])
            p += last.take(x[some], axis=0, out=of_last[: len(p)], mode="clip")
            np.clip(p, -MOST_LOGIT, MOST_LOGIT, out=p)
            told = np.arange(0, p.size, groups) + y[some]
            own[some] = p.ravel().take(told)
            total[some] = np.exp(p, out=p) @ one[:groups]
            p *= (share[some] / total[some])[:, None]
            p.ravel()[told] -= share[some]
            g["out"] += products(r[some], p)
            g["bias"] += one[: len(p)] @ p
            dr[some] = times(p, back)
        loss = float(((np.log(total) - own) * share).sum())
        g["o"] = products(flat(m), dr)
        dm = times(dr, np.ascontiguousarray(w["o"].T)).reshape(m.shape)
        ds = dm @ v.transpose(0, 2, 1)
        ds -= np.einsum("btd,btd->bt", dm, m)[:, :, None]
        ds *= a
        dqkv = np.empty_like(qkv)
        np.matmul(ds, k, out=dqkv[:, :, :d])
        np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[:, :, d : 2 * d])
        np.matmul(a.transpose(0, 2, 1), dm, out=dqkv[:, :, 2 * d :])
        g["q"], g["k"], g["v"] = np.split(products(flat(h), flat(dqkv)), 3, axis=1)
        g["q"] = g["q"] * self.scale
        dr += times(flat(dqkv), np.ascontiguousarray(to_qkv.T))
        g["pos"] = dr.reshape(h.shape).sum(axis=0)
        g["emb"] = np.bincount(self.cells.take(x, axis=0).ravel(), dr.ravel(), w["emb"].size).reshape(w["emb"].shape).astype(kind)
        return loss, g

    def inputs(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return inputs_of(self.inp, self.start, ids, first)

    def windows(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows, and the end of each one's text."""
        n = 1 + np.maximum(0, -(-(np.diff(first) - self.window) // self.stride))
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(first[:-1], n) + k * self.stride, np.repeat(first[1:], n)

    def fit(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, steps: int = 700, batch: int = 192, rate: float = 0.01, seed: int = 4) -> AttentionLM:
        """Adam on windows in random order, all of them once before any again and each once at least: inputs, classes to tell, and which positions count."""
        r, adam = np.random.default_rng(seed), Adam(self.w)
        steps = max(steps, -(-len(x) // batch))
        order = np.concatenate([r.permutation(len(x)) for _ in range(-(-steps * batch // len(x)))])
        for step in range(1, steps + 1):
            pick = order[(step - 1) * batch : step * batch]
            adam.step(self.gradient(x[pick], y[pick], mask[pick])[1], rate * min(1, step / 30) * (1 - step / (steps + 1)))
        return self

    def go_on(self, parts: Iterable[tuple[np.ndarray, np.ndarray]], batch: int = 192, rate: float = 0.004, seed: int = 6) -> int:
        """One pass over all windows of the texts in parts (ids, first), each id told once; the number of windows."""
        r, adam, done = np.random.default_rng(seed), Adam(self.w), 0
        for ids, first in parts:
            x, y = self.inputs(ids, first), self.cls[ids]
            n = -(-np.diff(first) // self.window)
            starts = np.repeat(first[:-1], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * self.window
            ends, order = np.repeat(first[1:], n), r.permutation(len(starts))
            done += len(order)
            for k in np.array_split(order, -(-len(order) // batch)) if len(order) else []:
                at = starts[k][:, None] + np.arange(self.window)
                mask = at < ends[k][:, None]
                np.minimum(at, (ends[k] - 1)[:, None], out=at)
                adam.step(self.gradient(x[at], y[at], mask)[1], rate * min(1, (adam.steps + 1) / 30) / np.sqrt(1 + adam.steps / 100))
        return done

    def score(self, ids: np.ndarray, first: np.ndarray, block: int = 128) -> np.ndarray:
        """log10 probability of each text (each ends with the end id)."""
        x, y = self.inputs(ids, first), self.cls[ids]
        starts, ends = self.windows(first)
        is_first = np.isin(starts, first[:-1])
        each, tables = np.zeros(len(ids), np.float32), self.tables()
        for seen, chosen in ((0, np.flatnonzero(is_first)), (self.window - self.stride, np.flatnonzero(~is_first))):
            for a in range(0, len(chosen), block):
                k = chosen[a : a + block]
                at = np.minimum(starts[k][:, None] + np.arange(self.window), (ends[k] - 1)[:, None])
                z = self.logits(x[at], seen, tables=tables)
                live = starts[k][:, None] + np.arange(seen, self.window) < ends[k][:, None]
                at = at[:, seen:]
                own = z.ravel()[np.arange(at.size) * z.shape[2] + y[at].ravel()].reshape(at.shape)
                own -= np.log(np.exp(z, out=z).reshape(-1, z.shape[2]) @ np.ones(z.shape[2], z.dtype)).reshape(at.shape)
                each[at[live]] = own[live]
        each += self.share.ravel().take(x * self.share.shape[1] + self.symbol.take(ids))
        each += self.within.take(ids)
        total = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
        return (total[first[1:]] - total[first[:-1]]) / np.log(10)


def keep_freed_memory() -> None:
    """Lets this process hold up to 32 MB that arrays have freed, where glibc would return it and fault every page in again for the next arrays; elsewhere nothing."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (OSError, TypeError, AttributeError):
        return
    for what, size in ((-3, 16 << 20), (-1, 32 << 20)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
        mallopt(what, size)


def with_end(flat: np.ndarray, first: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(first) - 1
    return np.insert(flat, first[1:], end_id).astype(np.int64), first + np.arange(n + 1)


def word_counts(docs: DataFrame) -> DataFrame:
    """h, c: words by hash, and how often they occur in the training texts; the end mark is a word."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, held, texts = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            u, back = np.unique(np.concatenate(hashes), return_inverse=True)
            c = np.bincount(back, np.concatenate(counts)).astype(np.int64)
            hashes.clear()
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["h", "c"])

        for batch, buf, offs in batches(rows):
            buf = LOWER[buf]
            starts, ends, _ = word_bounds(buf, offs, NOT_SPACE)
            u, c = np.unique(word_hashes(buf, starts, ends), return_counts=True)
            hashes.append(u)
            counts.append(c)
            held += len(u)
            texts += batch.num_rows
            if held > COUNT_BUFFER:
                yield flush()
                held = 0
        if texts:
            hashes.append(np.array([END_WORD]).view(U))
            counts.append(np.array([texts]))
            yield flush()

    return docs.where("train").select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class KeptIds(WordIds):
    """Word ids that outlive a text's task: where too many words are held, those met again since the last time stay (half of `most` at most), the others make room."""

    def clear(self) -> None:
        super().clear()
        self.again = np.zeros(1024, bool)

    def thin(self) -> None:
        known, n = self.known, self.known.n
        kept = np.flatnonzero(self.again[:n])[: self.most // 2]
        h, taken = np.empty(n, U), known.row >= 0
        h[known.row[taken]] = known.keys[taken]
        size = self.length[kept]
        first = np.cumsum(size) - size
        flat = self.flat[np.repeat(self.start[kept] - first, size) + np.arange(size.sum())]
        self.clear()
        self.known.enter(h[kept])
        self.start, self.length, self.flat, self.used = first, size, flat, len(flat)

    def rows(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.known.n > self.most:
            self.thin()
        n = self.known.n
        row = super().rows(buf, starts, ends)
        if self.known.n > len(self.again):
            self.again = np.concatenate([self.again, np.zeros(self.known.n, bool)])
        self.again[row[row < n]] = True
        return row


#: The words that this worker holds, by tokenizer.
HELD: dict[str, KeptIds] = {}


def words_held(tokenizer: str) -> KeptIds:
    if tokenizer not in HELD:
        HELD[tokenizer] = KeptIds(tokenizer, 1 << 18)
    return HELD[tokenizer]


def read_ids(docs: DataFrame, tokenizer: str, end_id: int, keys: np.ndarray, known: np.ndarray) -> DataFrame:
    """Each text read once: its subword ids, and what is needed for the base score.

    rid, i, train, ids (little-endian uint16, with the end id), n_tokens; of the frequent words (keys, known) how many
    tokens and the sum of their logarithms; the other words by hash, and how often each occurs; n_end: ends not counted yet.
    """
    held = docs.sparkSession.sparkContext.broadcast((keys, known))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        keys, known = held.value
        words, rid = words_held(tokenizer), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        frequent, logs = Slots(), np.append(np.log10(known + 0.1), 0.0)
        frequent.enter(keys)
        end_at = int(frequent.find(np.array([END_WORD]).view(U))[0])
        for batch, buf, offs in batches(rows):
            m = batch.num_rows
            ids, first = with_end(*words.ids(buf, offs), end_id)
            ids = ids.astype(ID)
            low = LOWER[buf]
            starts, ends, at_word = word_bounds(low, offs, NOT_SPACE)
            h = word_hashes(low, starts, ends)
            at = frequent.find(h)
            is_head = at >= 0
            sums = np.concatenate([[0.0], np.cumsum(logs[at])])
            heads = np.concatenate([[0], np.cumsum(is_head)])
            owner = np.repeat(np.arange(m), np.diff(at_word))[~is_head]
            tail = h[~is_head]
            order = np.lexsort((tail, owner))
            owner, tail = owner[order], tail[order]
            new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (tail[1:] != tail[:-1]))) if len(tail) else np.zeros(0, np.int64)
            per = np.searchsorted(owner[new], np.arange(m + 1)).astype(np.int32)
            data = ids.tobytes()
            cols = [
                pa.array(rid + np.arange(m)), batch.column(0), batch.column(2), pa.array([data[ID.itemsize * a : ID.itemsize * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary()),
                pa.array(np.diff(at_word) + 1), pa.array(heads[at_word[1:]] - heads[at_word[:-1]] + int(end_at >= 0)), pa.array(sums[at_word[1:]] - sums[at_word[:-1]] + logs[end_at]),
                pa.ListArray.from_arrays(pa.array(per), pa.array(tail[new].view(np.int64))), pa.ListArray.from_arrays(pa.array(per), pa.array(np.diff(np.append(new, len(tail))))), pa.array(np.full(m, int(end_at < 0))),
            ]
            rid += m
            yield pa.RecordBatch.from_arrays(cols, names=["rid", "i", "train", "ids", "n_tokens", "n_head", "head_sum", "tail", "times", "n_end"])

    kind = docs.schema["i"].dataType.simpleString()
    return docs.select("i", "text", "train").mapInArrow(run, f"rid long, i {kind}, train boolean, ids binary, n_tokens long, n_head long, head_sum double, tail array<long>, times array<long>, n_end long")


def id_batches(rows: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, first): text i has the ids first[i] to first[i + 1]."""
    for part, buf, offs in batches(rows, "ids", most):
        yield part, np.frombuffer(buf.tobytes(), ID).astype(np.int64), offs // ID.itemsize


def tallied(read: DataFrame, cells_of, size: int) -> DataFrame:
    """cell, c: how often each of `size` cells occurs; cells_of makes an array of cells out of (ids, first)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, held = np.zeros(size, np.int64), [], 0
        for _, ids, first in id_batches(rows):
            waiting.append(cells_of(ids, first))
            held += len(ids)
            if held > 1 << 21:
                total += np.bincount(np.concatenate(waiting), minlength=size)
                waiting, held = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=size)
        at = np.flatnonzero(total)
        for a in range(0, len(at), 1 << 18):
            some = at[a : a + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "c"])

    return read.where("train").select("ids").mapInArrow(run, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c"))


def id_counts(read: DataFrame, size: int) -> np.ndarray:
    """How often each subword id occurs in the training texts."""
    out = np.zeros(size)
    got = tallied(read, lambda ids, first: ids, size).toPandas()
    out[got["cell"].to_numpy(dtype=np.int64)] = got["c"]
    return out


def pair_counts(read: DataFrame, counts: np.ndarray) -> np.ndarray:
    """How often each symbol follows each input class in the training texts, with their starts and ends: 1,002 rows of 2,112 figures at most reach the driver, whatever the input."""
    inp, symbol = told_apart(counts)
    start, width = min(INPUTS, len(counts)) + 1, min(OUTPUTS, len(counts)) + GROUPS
    held = read.sparkSession.sparkContext.broadcast((inp, symbol))

    def cells_of(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        inp, symbol = held.value
        return inputs_of(inp, start, ids, first) * width + symbol[ids]

    def dense(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in rows:
            cell, c = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in np.unique(cell // width).tolist():
                mine = cell // width == k
                out.setdefault(k, np.zeros(width, "<i8"))[cell[mine] % width] = c[mine]
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([x.tobytes() for x in out.values()], pa.binary())], names=["k", "row"])

    out = np.zeros((start + 1, width), np.float32)
    cells = tallied(read, cells_of, (start + 1) * width).repartition(16, F.floor(F.col("cell") / width))
    for r in cells.mapInArrow(dense, "k long, row binary").collect():
        out[r["k"]] = np.frombuffer(r["row"], "<i8")
    return out


def start_windows(read: DataFrame, model: AttentionLM, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Inputs, classes and mask of the windows that weights start from, and whether these are all: of more than `most`, about that many, chosen by a hash."""
    window, stride = model.window, model.stride
    n = F.octet_length("ids") / ID.itemsize
    total = read.where("train").agg(F.sum(1 + F.greatest(F.lit(0), F.ceil((n - window) / stride)))).first()[0] or 0
    share = min(1.0, most / max(1, total))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, first in id_batches(rows):
            starts, ends = model.windows(first)
            text = np.searchsorted(first, starts, "right") - 1
            key = mix(part.column(1).to_numpy().view(U))
            chosen = np.flatnonzero(mix(key[text] + (starts - first[text]).astype(U)) < U(min(share, 1 - 2**-53) * 2.0**64))
            starts, ends, text = starts[chosen], ends[chosen], text[chosen]
            at = starts[:, None] + np.arange(-1, window)
            got = np.where((at >= first[text][:, None]) & (at < ends[:, None]), ids[np.clip(at, 0, len(ids) - 1)], -1).astype("<i4")
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in got], pa.binary())], names=["w"])

    got = read.where("train").select("ids", F.xxhash64("i", "ids").alias("k")).mapInArrow(run, "w binary").select("w", F.xxhash64("w").alias("h")).orderBy("h", "w").limit(2 * most).toPandas()
    w = np.frombuffer(b"".join(got["w"]), "<i4").reshape(len(got), window + 1)
    x = np.where(w[:, :-1] < 0, model.start, model.inp[w[:, :-1]])
    return x, model.cls[w[:, 1:]], w[:, 1:] >= 0, share == 1.0


def learn_all(read: DataFrame, model: AttentionLM, parts: int = 8) -> None:
    """Weights that have gone once over every window of every training text: each task goes on from the model's over its own texts, and the mean by windows is taken.

    One model leaves each task; `parts` tasks add them up, and the driver gets one.
    """
    held, names = read.sparkSession.sparkContext.broadcast(model), sorted(model.w)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        net = copy.copy(held.value)
        net.w = {k: t.copy() for k, t in net.w.items()}
        n = net.go_on((ids, first) for _, ids, first in id_batches(rows))
        if n:
            flat = np.concatenate([net.w[k].ravel() for k in names]).astype("<f8") * n
            yield pa.RecordBatch.from_arrays([pa.array(range(parts)), pa.array([n] * parts), pa.array([x.tobytes() for x in np.array_split(flat, parts)], pa.binary())], names=["k", "n", "w"])

    def added(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, tuple[int, np.ndarray]] = {}
        for b in rows:
            for k, n, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                m, t = out.get(k, (0, 0.0))
                out[k] = m + n, t + np.frombuffer(w, "<f8")
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out)), pa.array([m for m, _ in out.values()]), pa.array([t.tobytes() for _, t in out.values()], pa.binary())], names=["k", "n", "w"])

    schema = "k long, n long, w binary"
    got = sorted(read.where("train").select("ids").mapInArrow(run, schema).repartition(parts, "k").mapInArrow(added, schema).collect(), key=lambda r: r["k"])
    at, flat = 0, np.concatenate([np.frombuffer(r["w"], "<f8") / r["n"] for r in got])
    for k in names:
        t = model.w[k]
        model.w[k] = flat[at : at + t.size].reshape(t.shape).astype(np.float32)
        at += t.size


def score(docs: DataFrame, tokenizer: str, held_out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 49407, size: int = 49408, most_windows: int = 1 << 16, steps: int = 700) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score; held_out is an SQL condition, null counts as false."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (~F.coalesce(F.expr(held_out), F.lit(False))).alias("train"))
    counts = written(word_counts(docs))
    row = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = row["n"] or 0, row["v"]
    steps_of = F.floor(F.log2("c") * 4)
    total, least = 0, 1 << 20
    for k, m in sorted(((r["k"], r["count"]) for r in counts.groupBy(steps_of.alias("k")).count().collect()), reverse=True):
        total += m
        if total > HEAD:
            break
        least = k
    head = counts.where(steps_of >= least).select("h", "c").toPandas()
    keys, known = head["h"].to_numpy(dtype=np.int64).view(U), head["c"].to_numpy(dtype=np.int64)
    order = np.argsort(keys)
    read = written(read_ids(docs, tokenizer, end_id, keys[order], known[order]))
    ids = id_counts(read, size)
    model = AttentionLM(ids, pair_counts(read, ids), end_id)
    x, y, mask, are_all = start_windows(read, model, most_windows)
    if len(x):
        model.fit(x, y, mask, steps)
    if not are_all:
        learn_all(read, model)
    held = spark.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        for part, ids, first in id_batches(rows):
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(held.value.score(ids, first))], names=[*part.schema.names[1:], "score"])

    few = counts.where(steps_of < least).select("h", "c")
    rare = read.select("rid", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("rid", F.col("t.tail").alias("h"), F.col("t.times").alias("m"))
    c = F.coalesce("c", F.lit(0))
    more = rare.join(few, "h", "left").groupBy("rid").agg(F.sum(F.col("m") * F.log10(c + 0.1)).alias("s"), F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("known"))
    low = float(np.log10(n + 0.1 * (v + 1)))
    carried = ["rid", "i", "train", "n_tokens", "n_head", "head_sum", "n_end"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.select(carried).schema) + ", score double"
    return read.select("ids", *carried).mapInArrow(run, schema).join(more, "rid", "left").select(
        F.col("i").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_head") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("s", F.lit(0.0)) + F.col("n_end") * F.log10(F.lit(0.1)) - F.col("n_tokens") * low).alias("base_score"), "score",
    )


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, public_tokenizers.path("word_bpe_49k.json"), "pmod(crc32(cast(doc_id as string)), 10) = 0")
