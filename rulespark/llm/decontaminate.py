"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

The windows of every benchmark item (n consecutive words, or the whole item if
it has fewer) are hashed; training texts are scanned once, each run of words is
looked up, and each hit is verified word by word.  The set is broadcast only up
to `most_bytes` of benchmark text; a larger benchmark is dealt by item into
blocks of that size, scanned one after the other.

Null or empty texts have no words and no hits; a null item has no windows.
Repeated item_ids count once; null item_ids are ignored.  An empty benchmark
marks nothing.  Repeated documents are judged each for itself.  Other columns
are carried along untouched.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import ALNUM, LOWER, U, batches, buffer_of, run_hashes, word_bounds, word_hashes
from .shared import free

FILTER_BITS = 20
REPORT = "n_words long, spans array<struct<start:long,end:long,start_byte:long,end_byte:long>>, items array<string>"


def windows_of(items: list[tuple[str, str]], n: int) -> dict:
    """Window lengths -> (sorted hashes, filter), and what each hash stands for."""
    by_size, meaning = defaultdict(set), defaultdict(dict)
    texts = pa.array([t or "" for _, t in items], pa.string())
    buf, offs = buffer_of(texts)
    buf = LOWER[buf]
    starts, ends, first = word_bounds(buf, offs, ALNUM)
    hashes, data = word_hashes(buf, starts, ends), buf.tobytes()
    for k, (item, _) in enumerate(items):
        a, b = int(first[k]), int(first[k + 1])
        if a == b or item is None:
            continue
        size = min(n, b - a)
        for j, h in enumerate(run_hashes(hashes[a:b], size).tolist()):
            words = b" ".join(data[starts[i] : ends[i]] for i in range(a + j, a + j + size))
            by_size[size].add(h)
            meaning[h].setdefault(words, set()).add(str(item))
    out = {}
    for size, found in by_size.items():
        keys = np.sort(np.fromiter(found, U, len(found)))
        quick = np.zeros(1 << FILTER_BITS, dtype=bool)
        quick[keys >> U(64 - FILTER_BITS)] = True
        out[size] = (keys, quick)
    return {"sizes": out, "meaning": {h: {w: sorted(i) for w, i in m.items()} for h, m in meaning.items()}}


def scan(buf: np.ndarray, offs: np.ndarray, held: dict) -> tuple[np.ndarray, dict[int, list], dict[int, set]]:
    """Words of each text; by text, its verified windows (start, end, bytes) and items."""
    buf = LOWER[buf]
    starts, ends, first = word_bounds(buf, offs, ALNUM)
    n_words, hits, items = np.diff(first), defaultdict(list), defaultdict(set)
    if not len(starts) or not held["sizes"]:
        return n_words, hits, items
    hashes, data = word_hashes(buf, starts, ends), buf.tobytes()
    owner = np.repeat(np.arange(len(n_words)), n_words)
    for size, (keys, quick) in held["sizes"].items():
        runs = run_hashes(hashes, size)
        at = np.flatnonzero(quick[runs >> U(64 - FILTER_BITS)])
        at = at[owner[at] == owner[at + size - 1]]
        at = at[np.isin(runs[at], keys)]
        for i, h in zip(at.tolist(), runs[at].tolist(), strict=True):
            words = b" ".join(data[starts[j] : ends[j]] for j in range(i, i + size))
            found = held["meaning"][h].get(words)
            if found:
                d = int(owner[i])
                hits[d].append((i - int(first[d]), i - int(first[d]) + size, int(starts[i] - offs[d]), int(ends[i + size - 1] - offs[d])))
                items[d].update(found)
    return n_words, hits, items


def joined(spans: list) -> list[dict]:
    """Overlapping or touching windows as one span."""
    out: list[list[int]] = []
    for a, b, x, y in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1], out[-1][3] = max(out[-1][1], b), max(out[-1][3], y)
        else:
            out.append([a, b, x, y])
    return [dict(zip(("start", "end", "start_byte", "end_byte"), s, strict=True)) for s in out]


def mark(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_bytes: int = 1 << 20, keep: list[str] | None = None, as_col: str = "leak") -> DataFrame:
    """docs (of its columns, those in keep) with a struct column as_col (one of that name is replaced): n_words, spans (word and byte positions), items."""
    spark = docs.sparkSession
    b = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / most_bytes))
    out = docs.drop(as_col).withColumn(as_col, F.lit(None).cast(f"struct<{REPORT.replace(' long', ':long').replace(' array', ':array')}>"))
    every = out.schema
    few = T.StructType([f for f in every if keep is None or f.name in {*keep, as_col}])
    for k in range(blocks):
        schema = few if k == blocks - 1 else every
        part = b if blocks == 1 else b.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        held = spark.sparkContext.broadcast(windows_of([(r.item, r.text) for r in part.collect()], n))

        def run(rows: Iterator[pa.RecordBatch], held=held, names=tuple(schema.names)) -> Iterator[pa.RecordBatch]:
            known = held.value
            for batch, buf, offs in batches(rows, text_col):
                n_words, hits, items = scan(buf, offs, known)
                at = batch.schema.get_field_index(as_col)
                old = batch.column(at).to_pylist() if blocks > 1 else [None] * batch.num_rows
                leak = []
                for d, was in enumerate(old):
                    was = was or {"spans": [], "items": []}
                    spans = hits.get(d, []) + [tuple(s.values()) for s in was["spans"]]
                    leak.append({"n_words": int(n_words[d]), "spans": joined(spans), "items": sorted(items.get(d, set()) | set(was["items"]))})
                made = pa.array(leak, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([made if x == as_col else batch.column(batch.schema.get_field_index(x)) for x in names], names=list(names))

        out = out.mapInArrow(run, schema)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, action: str = "documents", **kw) -> DataFrame:
    """docs without the leaks: whole documents go, or ("spans") only the passages."""
    text = kw.get("text_col", "text")
    leak = free("leak", docs.columns)
    marked = mark(docs, benchmark, as_col=leak, **kw)
    if action == "documents":
        return marked.where(F.size(f"{leak}.spans") == 0).select(*docs.columns)
    raw = F.encode(F.col(text), "UTF-8")
    cuts = F.aggregate(
        F.col(f"{leak}.spans"), F.struct(F.lit(0).cast("long").alias("at"), F.encode(F.lit(""), "UTF-8").alias("kept")),
        lambda s, x: F.struct(x["end_byte"].alias("at"), F.concat(s["kept"], F.substring(raw, (s["at"] + 1).cast("int"), (x["start_byte"] - s["at"]).cast("int"))).alias("kept")),
    )
    cut = free("cut", marked.columns)
    kept = marked.withColumn(cut, F.when(F.size(f"{leak}.spans") > 0, cuts))
    rest = F.decode(F.concat(F.col(f"{cut}.kept"), F.substring(raw, (F.col(f"{cut}.at") + 1).cast("int"), F.lit(2147483647))), "UTF-8")
    return kept.withColumn(text, F.when(F.col(cut).isNotNull(), rest).otherwise(F.col(text))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    n_hit = F.aggregate("leak.spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select(
        "doc_id", F.col("leak.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("leak.items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
