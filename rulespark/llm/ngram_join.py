"""N-gram Jaccard join: a grouped prefix join over the word shingles of documents.

A document is the set of its distinct runs of n words, as 62-bit hashes.  Two
documents link when 100 * intersection >= percent * union.

1. Shingles that many documents share are counted over the whole corpus (those
   that recur within a task's buffer, summed up); the most frequent ones, a fixed
   number at most, sort last, all others by hash.  Any order gives right results.
2. Equal sets form a class.  Classes with the same prefix (the shingles one of
   which every linked set must share) and size form a group.
3. Groups are listed under each shingle of their prefix; the list of a shingle in
   LONG_LIST documents or more is dealt by bands of sizes that can link.  Size,
   position and a parity bitmap bound the intersection of a pair; only pairs within
   the bounds are candidates.
4. First each group is paired with one other in each list only, and the
   sets of their members are compared; then, in the lists that do not hang
   together yet, every pair is that does not and that larger bitmaps allow.  So
   a group of thousands of near copies is never expanded into all its pairs, and
   no link between components is missed.
5. Components of the verified links give each document the smallest doc_id it
   can reach.

Null and empty texts have no shingles and link with nothing.  Texts of fewer than
n words are one shingle.  Rows without an id get no component.  Rows that share
an id are one document with several texts.  Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import LOWER, NOT_SPACE, U, batches, mix, run_hashes, word_bounds, word_hashes
from .components import components
from .shared import dropped, written

HOT_MOST, HOT_LEAST, HOT_BUFFER = 1 << 17, 24, 1 << 21
#: Documents of a shingle whose list is dealt by size.
LONG_LIST = 4096
HOT_BIT = 1 << 62
BLOOM_BITS = 23


def shingles(buf: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    buf = LOWER[buf]
    starts, ends, first = word_bounds(buf, offs, NOT_SPACE)
    words = word_hashes(buf, starts, ends)
    runs = run_hashes(words, n) >> U(2)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            x = np.sort(runs[a : b - n + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        else:
            out.append(run_hashes(words[a:b], b - a) >> U(2) if b > a else np.zeros(0, U))
    return out


def needed(n: np.ndarray | int, percent: int):
    """The least intersection of a set of n with any set it links to."""
    return -(-percent * n // 100)


def frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """The most frequent shingles, rarest first, at most HOT_MOST; and from which of them on a list is long."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            x, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(x[c > 1].astype(np.int64)), pa.array(c[c > 1])], names=["h", "c"])

        for _, buf, offs in batches(rows):
            for x in shingles(buf, offs, n):
                held.append(x)
                size += len(x)
            if size > HOT_BUFFER:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    counts = docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= HOT_LEAST).persist()
    steps = sorted(((r["k"], r["count"]) for r in counts.groupBy(F.floor(F.log2("c") * 4).alias("k")).count().collect()), reverse=True)
    total, least = 0, None
    for k, m in steps:
        total += m
        if total > HOT_MOST:
            break
        least = k
    rows = counts.where(F.floor(F.log2("c") * 4) >= least).select("h", "c").toPandas() if least is not None else None
    counts.unpersist()
    if rows is None or not len(rows):
        return np.zeros(0, U), 0
    rows = rows.sort_values(["c", "h"])
    return rows["h"].to_numpy().astype(U), int((rows["c"] < LONG_LIST).sum())


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signatures(docs: DataFrame, n: int, percent: int, hot: np.ndarray) -> DataFrame:
    """doc_id, n, hashes of the set and its prefix, the prefix in canonical order, parity bitmaps: one of 256 bits, w of n bits or more, f of as many as tell sets that have nothing in common."""
    sort = np.argsort(hot, kind="stable")
    held = docs.sparkSession.sparkContext.broadcast((hot[sort], sort.astype(U)))
    names = ["doc_id", "n", "s1", "s2", "ph", "p", "b0", "b1", "b2", "b3", "w", "f"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rank = held.value
        for batch, buf, offs in batches(rows):
            sets = shingles(buf, offs, n)
            size = np.array([len(x) for x in sets], dtype=np.int64)
            s, b = np.zeros((3, len(sets)), U), np.zeros((len(sets), 4), U)
            prefixes, wide, short = [], [], []
            for d, x in enumerate(sets):
                if not len(x):
                    prefixes.append(np.zeros(0, np.int64))
                    wide.append(b"")
                    short.append(b"")
                    continue
                m = mix(x)
                s[0, d], s[1, d] = m.sum(), mix(m + U(1)).sum()
                b[d] = np.packbits(np.bincount((m & U(255)).astype(np.int64), minlength=256).astype(np.uint8) & 1).view(U)
                parity = lambda bits: np.packbits(np.bincount((m & U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()  # noqa: B023, E731
                wide.append(parity(max(256, 1 << (len(x) - 1).bit_length())))
                # Two sets with nothing in common differ in half the bits: 4.8 bits for each shingle that may differ are plenty.
                short.append(parity(max(256, 1 << int(4.8 * 2 * len(x) * (100 - percent) / (100 + percent)).bit_length())))
                take = len(x) - int(needed(len(x), percent)) + 1
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
                    is_hot = keys[at] == x
                    cold = x[~is_hot][:take]
                    p = cold if len(cold) == take else np.concatenate([cold, np.sort(rank[at[is_hot]])[: take - len(cold)] | U(HOT_BIT)])
                else:
                    p = x[:take]
                s[2, d] = mix(p + np.arange(len(p), dtype=U)).sum()
                prefixes.append(p.astype(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes)))
            cols = [batch.column(0).cast(pa.int64()), pa.array(size), *(pa.array(signed(x)) for x in s), lists, *(pa.array(signed(np.ascontiguousarray(b[:, k]))) for k in range(4)), pa.array(wide, pa.binary()), pa.array(short, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, ph long, p array<long>, b0 long, b1 long, b2 long, b3 long, w binary, f binary")


def possible(x: dict, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which listed pairs the bounds allow: by size, by position in the prefix, by bitmap where one set stands on either side."""
    a, b_ = x["n"][i], x["n"][j]
    least = -(-percent * (a + b_) // (100 + percent))
    ok = 100 * np.minimum(a, b_) >= percent * np.maximum(a, b_)
    pi, pj = x["pos"][i], x["pos"][j]
    ok &= np.minimum(pi, pj) + np.minimum(a - pi, b_ - pj) >= least
    some = np.flatnonzero(ok & (x["gm"][i] == 1) & (x["gm"][j] == 1))
    for k in range(0, len(some), 1 << 14):
        p = some[k : k + (1 << 14)]
        if "f" in x:
            off = differing(x["f"][i[p]].tolist(), x["f"][j[p]].tolist())
        else:
            off = sum(np.bitwise_count((x[b][i[p]] ^ x[b][j[p]]).view(U)).astype(np.int64) for b in ("b0", "b1", "b2", "b3"))
        ok[p[off > (a + b_ - 2 * least)[p]]] = False
    return ok


#: What the lists hold in the second pass: components, and the short bitmaps in place of those of 256 bits.
OPEN = ("tok", "gid", "n", "gm", "pos", "comp", "mixed", "f")
LISTED = ("tok", "gid", "n", "gm", "pos", "b0", "b1", "b2", "b3")


def runs(rows: Iterator[pa.RecordBatch], names: tuple) -> Iterator[tuple[dict, np.ndarray]]:
    """Whole runs of equal tok out of sorted batches: columns, and where the runs begin (with the end)."""
    carry: dict | None = None

    def arrays(b: pa.RecordBatch) -> dict:
        return {k: b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in names}

    def whole(x: dict) -> tuple[dict, np.ndarray]:
        return x, np.append(np.flatnonzero(np.diff(x["tok"], prepend=x["tok"][0] - 1)), len(x["tok"]))

    for b in rows:
        if not b.num_rows:
            continue
        x = arrays(b)
        if carry is not None:
            x = {k: np.concatenate([carry[k], x[k]]) for k in names}
        last = int(np.searchsorted(x["tok"], x["tok"][-1]))
        if last:
            yield whole({k: v[:last] for k, v in x.items()})
        carry = {k: v[last:] for k, v in x.items()}
    if carry is not None:
        yield whole(carry)


def neighbours(rows: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Lists of two and more (as they are), and candidates: each entry with the list's smallest id or, where the bounds forbid it, with the entry before.

    Lists of one family mostly have the same smallest id, so few different pairs come of many lists.
    """
    for x, at in runs(rows, LISTED):
        size = np.repeat(np.diff(at), np.diff(at))
        start = np.repeat(at[:-1], np.diff(at))
        keep = np.flatnonzero(size > 1)
        if not len(keep):
            continue
        place = np.arange(len(size)) - start
        low = np.lexsort((x["gid"], start))[start]
        all_ = np.arange(len(size))
        mine = np.flatnonzero(low != all_)
        ok = possible(x, low[mine], mine, percent)
        later = np.setdiff1d(mine[~ok], all_[place == 0])
        near = possible(x, later - 1, later, percent)
        i, j = np.concatenate([low[mine[ok]], later[near] - 1]), np.concatenate([mine[ok], later[near]])
        pairs = np.unique(np.stack([np.minimum(x["gid"][i], x["gid"][j]), np.maximum(x["gid"][i], x["gid"][j])]), axis=1)
        cols = {k: np.concatenate([x[k][keep], np.zeros(pairs.shape[1], np.int64)]) for k in LISTED}
        cols["gid"][len(keep) :] = pairs[0]
        other = np.concatenate([np.full(len(keep), -1), pairs[1]])
        yield pa.RecordBatch.from_arrays([pa.array(cols[k]) for k in LISTED] + [pa.array(other), pa.array(np.arange(len(other)) >= len(keep))], names=[*LISTED, "other", "pair"])


def differing(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """In how many bits the parity bitmaps of each pair differ; the longer one folds onto the shorter one."""
    out = np.zeros(len(left), np.int64)
    sizes = np.array([(len(a), len(b)) for a, b in zip(left, right, strict=True)]).reshape(-1, 2)
    for la, lb in {tuple(x) for x in sizes.tolist()}:
        at = np.flatnonzero((sizes == (la, lb)).all(axis=1))
        pair = [np.frombuffer(b"".join(side[k] for k in at.tolist()), np.uint8).reshape(len(at), -1) for side in (left, right)]
        short = min(la, lb)
        folded = [np.bitwise_xor.reduce(p.reshape(len(at), -1, short), axis=1) for p in pair]
        out[at] = np.bitwise_count(folded[0] ^ folded[1]).sum(axis=1, dtype=np.int64)
    return out


def across(rows: Iterator[pa.RecordBatch], percent: int, block: int = 1024) -> Iterator[pa.RecordBatch]:
    """All candidates of two groups that do not hang together yet (comp; mixed: a group whose members do not)."""

    def pairs(found: list) -> pa.RecordBatch:
        got = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], names=["a", "b"])

    for x, at in runs(rows, OPEN):
        found, held = [], 0
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            c, mixed = x["comp"][a:b], x["mixed"][a:b].astype(bool)
            if b - a < 2 or ((c == c[0]).all() and not mixed.any()):
                continue
            top = np.searchsorted(x["n"][a:b] * percent, x["n"][a:b] * 100, "right")
            for k in range(0, b - a, block):
                i = np.arange(k, min(b - a, k + block))
                for m in range(k, int(top[i[-1]]), block):
                    j = np.arange(m, min(int(top[i[-1]]), m + block))
                    p, q = np.nonzero((i[:, None] < j[None, :]) & ((c[i][:, None] != c[j][None, :]) | mixed[i][:, None] | mixed[j][None, :]))
                    p, q = a + i[p], a + j[q]
                    ok = possible(x, p, q, percent)
                    found.append(np.stack([x["gid"][p[ok]], x["gid"][q[ok]]]))
                    held += int(ok.sum())
                    if held > 1 << 20:
                        yield pairs(found)
                        found, held = [], 0
        if held:
            yield pairs(found)


def plausible(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps of n bits do not rule a link out: sets differ in as many shingles as bits at least."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            ok = []
            for k in range(0, r.num_rows, 1 << 10):
                part = r.slice(k, 1 << 10)
                both = part.column(2).to_numpy() + part.column(3).to_numpy()
                least = -(-percent * both // (100 + percent))
                ok.append(differing(part.column(4).to_pylist(), part.column(5).to_pylist()) <= both - 2 * least)
            yield r.select([0, 1]).filter(pa.array(np.concatenate(ok) if ok else [], pa.bool_()))

    x = pairs.join(wide.toDF("b", "nb", "wb"), "b").join(wide.toDF("a", "na", "wa"), "a")
    return x.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(run, "a long, b long").distinct()


def verified(docs: DataFrame, pairs: DataFrame, wide: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link; sets are sent only for documents in pairs that bitmaps leave open."""
    spark = docs.sparkSession
    pairs = written(plausible(pairs, wide, percent))
    mask = (1 << BLOOM_BITS) - 1
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    bit = F.xxhash64("id").bitwiseAND(F.lit(mask))
    words = ids.groupBy(F.shiftright(bit, 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("m"))
    got = words.toPandas()
    bloom = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    bloom[got["w"].to_numpy(dtype=np.int64)] = got["m"].to_numpy(dtype=np.int64)
    held = spark.sparkContext.broadcast(bloom)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = held.value.view(U)
        for batch in rows:
            bits = batch.column(2).to_numpy(zero_copy_only=False)
            keep = (filter_[bits >> 6] >> (bits & 63).astype(U)) & U(1)
            batch = batch.filter(pa.array(keep.astype(bool)))
            for part, buf, offs in batches([batch]):
                sets = [x.astype("<u8").tobytes() for x in shingles(buf, offs, n)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["id", "set"])

    some = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("long")).bitwiseAND(F.lit(mask)).alias("bit"))
    sets = written(some.mapInArrow(run, "id long, set binary").where("set <> X''"))

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            ok = []
            for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                s, t = np.frombuffer(s, "<u8"), np.frombuffer(t, "<u8")
                both = np.concatenate([s, t])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(s) + len(t) - common))
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    # a, the smaller id, is in many pairs: the sets of its partners go to it, so that its own is not sent with every pair.
    right = pairs.join(sets.toDF("b", "sb"), "b")
    out = written(right.join(sets.toDF("a", "sa"), "a").select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long").distinct())
    dropped(sets)
    dropped(pairs)
    return out


def join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hot, long_from = frequent(docs, n)
    sig = written(signatures(docs, n, percent, hot))
    real = sig.where("doc_id is not null and n > 0")
    shape = ["ph", "n", "p", "b0", "b1", "b2", "b3"]
    classes = written(real.groupBy("s1", "s2").agg(F.min("doc_id").alias("cid"), F.count("*").alias("m"), *(F.first(c).alias(c) for c in (*shape, "w", "f"))))
    slim, fat = written(sig.select("doc_id", "n", "s1", "s2")), sig
    dropped(fat)
    sig = slim
    groups = classes.groupBy("ph", "n").agg(F.min("cid").alias("gid"), F.count("*").alias("gm"), *(F.first(c).alias(c) for c in ("p", "b0", "b1", "b2", "b3")))
    listed = groups.select("gid", "n", "gm", "b0", "b1", "b2", "b3", F.posexplode("p").alias("pos", "tok")).withColumn("pos", F.col("pos").cast("long"))
    # Sets that link are of one band of sizes or of neighbouring ones: a long list is dealt by bands, each set to its own and the one below.
    band = F.floor(F.log(F.col("n")) / math.log(100 / percent) + 1e-9) if percent < 100 else F.col("n")
    bands = F.when(F.col("tok") >= HOT_BIT + long_from, F.array(band, band - 1)).otherwise(F.array(F.lit(None).cast("long")))
    listed = listed.withColumn("band", F.explode(bands)).withColumn("tok", F.when(F.col("band").isNotNull(), F.xxhash64("tok", "band")).otherwise(F.col("tok")))
    listed = listed.select(*LISTED).repartition("tok").sortWithinPartitions("tok", "n", "gid")
    kept = written(listed.mapInArrow(lambda rows: neighbours(rows, percent), ", ".join(f"{c} long" for c in (*LISTED, "other")) + ", pair boolean"))
    lists = kept.where("not pair").select("tok", "gid", "n", "gm", "pos")
    # Members of the groups that have several: equal sizes differ in two shingles at least, so small sets never link there.
    slim, fat = written(classes.select("s1", "s2", "ph", "n", "cid", "m")), classes
    wide = written(fat.select("cid", "n", "w", "f"))
    dropped(fat)
    classes = slim
    several = classes.groupBy("ph", "n").agg(F.min("cid").alias("gid"), F.count("*").alias("gm")).where("gm > 1")
    members = written(classes.select("ph", "n", "cid").join(several, ["ph", "n"]).select("gid", "cid", "n"))
    within = F.expr(f"100 * (n - 1) >= {percent} * (n + 1)")
    first = kept.where("pair").select(F.col("gid").alias("a"), F.col("other").alias("b")).unionByName(members.where(within).where("gid <> cid").select(F.col("gid").alias("a"), F.col("cid").alias("b"))).distinct()
    bitmaps = wide.drop("f")
    links = verified(docs, first, bitmaps, n, percent)
    label = components(links, "a", "b")
    # What is left: pairs of groups, or members of one, in different components.
    placed = members.join(label, members["cid"] == label["node"], "left").select("gid", "cid", "n", F.coalesce("label", "cid").alias("comp"))
    state = placed.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).select("gid", F.col("lo").alias("gcomp"), (F.col("lo") != F.col("hi")).alias("gmixed"))
    state = label.select(F.col("node").alias("gid"), F.col("label").alias("gcomp"), F.lit(False).alias("gmixed")).join(state.select("gid"), "gid", "left_anti").unionByName(state)
    state = written(state)
    # Lists meet components and bitmaps by group, where both are dealt alike, and are dealt by shingle once.
    short = wide.select(F.col("cid").alias("gid"), "f")
    rest = lists.join(state, "gid", "left").join(short, "gid").select("tok", "gid", "n", "gm", "pos", F.coalesce("gcomp", "gid").alias("comp"), F.coalesce("gmixed", F.lit(False)).alias("mixed"), "f")
    rest = rest.repartition("tok").sortWithinPartitions("tok", "n", "gid")
    second = written(rest.mapInArrow(lambda rows: across(rows, percent), "a long, b long").distinct())
    own = placed.where(within)
    inside = own.join(own.toDF("gid", "cid2", "n2", "comp2"), "gid").where("cid < cid2 and comp <> comp2").select(F.col("cid").alias("a"), F.col("cid2").alias("b"))
    side = lambda c: placed.select(F.col("gid").alias(c), F.col("cid").alias(f"{c}_cid"))
    outside = second.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_cid", "a").alias("a"), F.coalesce("b_cid", "b").alias("b"))
    more = written(inside.unionByName(outside).distinct())
    if more.limit(1).count():
        links = links.unionByName(verified(docs, more, bitmaps, n, percent))
        label = components(links, "a", "b")
    for t in (kept, members, second, more, wide, state):
        dropped(t)
    # A class of very many copies is joined by salted rows; there are 1,000 of them at most.
    total = sig.count()
    known = classes.select("s1", "s2", "cid", "m").join(label, classes["cid"] == label["node"], "left").select("s1", "s2", "m", F.coalesce("label", "cid").alias("component_id"), (F.col("label").isNotNull() | (F.col("m") > 1)).alias("use")).where("use")
    hot_at = max(1000, total // 1000)
    hot = [r["s1"] for r in classes.where(F.col("m") > hot_at).select("s1").collect()]
    is_hot = F.col("s1").isin(hot) if hot else F.lit(False)
    salts = 64
    known = written(known.select("s1", "s2", "component_id", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("salt")))
    rows = sig.select("doc_id", "n", "s1", "s2", F.when(is_hot, F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).otherwise(0).alias("salt"))
    out = rows.join(known, ["s1", "s2", "salt"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)
