"""Words of UTF-8 texts as numpy arrays: bounds, 64-bit hashes, runs of words.

A batch of texts is one byte buffer plus offsets, exactly as Arrow hands it
over, so no Python string is made for a word.  A word of up to LONG bytes is
hashed by runs of 8 bytes, each mixed into two lanes that depend on all runs
before; a longer one by BLAKE2b.  Equal words have equal hashes; unequal ones
collide with a chance of 2**-64 a pair, whatever their structure.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
#: Words of more bytes are hashed one by one.
LONG = 64

#: The byte classes that separate words.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
SPLIT_BYTES = b" \t\n\r"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(inside: np.ndarray | None = None, outside: bytes = b"") -> np.ndarray:
    """256 booleans: which bytes belong to words."""
    t = np.ones(256, dtype=bool) if inside is None else inside.copy()
    t[list(outside)] = False
    return t


NOT_SPACE = table(outside=SPACE_BYTES)
NOT_SPLIT = table(outside=SPLIT_BYTES)
#: Digits, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

def buffer_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of about `most` bytes; a longer text is its own run."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield a, b
        a = b


def word_bounds(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): text i has the words first[i] to first[i + 1]."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    w = inside[buf]
    begins, ends = w.copy(), w.copy()
    begins[1:] &= ~w[:-1]
    ends[:-1] &= ~w[1:]
    cut = offs[(offs > 0) & (offs < len(buf))]
    begins[cut] = w[cut]
    ends[cut - 1] = w[cut - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if len(starts) == 0:
        return np.zeros(0, U)
    size = ends - starts
    runs = np.ndarray((len(buf),), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix(size.astype(U) * U(0x9E3779B97F4A7C15) + U(1))
    g = mix(h + U(0xD6E8FEB86659FD93))
    at = np.flatnonzero(size <= LONG)
    for k in range(LONG // 8):
        if k:
            at = at[size[at] > 8 * k]
        if not len(at):
            break
        left = np.minimum(size[at] - 8 * k, 8).astype(U)
        x = runs[starts[at] + 8 * k] & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - U(8) * left))
        one = mix(h[at] ^ x)
        g[at] = mix(g[at] + one * U(0xA24BAED4963EE407) + x)
        h[at] = one
    out = mix(h ^ (g >> U(23) | g << U(41)))
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(blake2b(buf[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive words (also across texts: use run_starts)."""
    if len(words) < n:
        return np.zeros(0, U)
    m = len(words) - n + 1
    out = np.full(m, U(n * 0xD6E8FEB86659FD93 % (1 << 64)))
    for k in range(n):
        out = out * U(0xA24BAED4963EE407) + words[k : k + m]
    return mix(out)


def batches(rows: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts Arrow batches into runs of about `most` bytes of text: (rows, bytes, offsets)."""
    for batch in rows:
        if batch.num_rows == 0:
            continue
        buf, offs = buffer_of(batch.column(batch.schema.get_field_index(column)))
        for a, b in pieces(offs, most):
            yield batch.slice(a, b - a), buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


def strings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray) -> list[bytes]:
    data = buf.tobytes()
    return [data[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]
