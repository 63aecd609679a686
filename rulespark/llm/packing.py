"""Cost-balanced packing of documents into sequences of a fixed window.

A piece of n tokens costs linear * n + quadratic * n * n (attention within a
document).  Each task packs blocks of about `block_tokens` tokens: documents in
descending order of cost go to the lowest-cost sequence that has token capacity
left for the whole of them; where none has, they are cut.  A block opens as many
full windows as its tokens fill and splits the rest into powers of two, which need
no padding, so that every sequence is filled exactly.  Nothing is shuffled; memory
is one block.

Null text: the end id alone.  Empty table: no pieces.  Repeated rows are packed
as they come; ties in cost keep the order of the input.  A null id stays null.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import batches
from .wordcache import WordIds

def capacities(tokens: int, window: int) -> list[int]:
    """Full windows, then the powers of two that make up the rest."""
    full, rest = divmod(tokens, window)
    return [window] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack_lengths(lengths: list[int], window: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece.

    A document goes whole to the lowest-cost sequence that has room for it; only where none has is it cut, at the room of the lowest-cost one.
    """
    left = np.array(capacities(sum(lengths), window), dtype=np.int64)
    cost, used, out = np.zeros(len(left)), [0] * len(left), []
    for doc in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        start, rest = 0, lengths[doc]
        while rest:
            room = np.flatnonzero(left >= min(rest, window))
            if not len(room):
                room = np.flatnonzero(left)
            k = int(room[cost[room].argmin()])
            n = min(rest, window, int(left[k]))
            out.append((doc, start, n, k, used[k]))
            used[k] += n
            left[k] -= n
            cost[k] += linear * n + quadratic * n * n
            start, rest = start + n, rest - n
    return out


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end_id: int = 2, block_tokens: int = 1 << 20, linear: float = 1.0, quadratic: float = 1 / 2048
) -> DataFrame:
    """Pieces: id_col, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset, cost."""
    field = docs.schema[id_col]
    schema = f"`{id_col}` {field.dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, `offset` long, cost double"

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base = WordIds(tokenizer), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        names, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal base, names, ids, held
            lengths = [len(x) for x in ids]
            placed = pack_lengths(lengths, window, linear, quadratic)
            doc, start, n, seq, off = (np.array(x, dtype=np.int64) for x in zip(*placed, strict=True))
            every = pa.concat_arrays(names)
            cols = [
                every.take(pa.array(doc)), start, n, pa.array([ids[d][a : a + k].tobytes() for d, a, k in zip(doc.tolist(), start.tolist(), n.tolist(), strict=True)], pa.binary()),
                np.array(lengths, dtype=np.int64)[doc], base + seq, off, linear * n + quadratic * n.astype(float) ** 2,
            ]
            base += int(seq.max()) + 1
            names, ids, held = [], [], 0
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "cost"])

        for batch, buf, offs in batches(rows, text_col):
            flat, first = words.ids(buf, offs)
            for k in range(batch.num_rows):
                ids.append(np.append(flat[first[k] : first[k + 1]], np.uint32(end_id)))
            names.append(batch.column(0))
            held += len(flat) + batch.num_rows
            if held >= block_tokens:
                yield flush()
        if ids:
            yield flush()

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost")
