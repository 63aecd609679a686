import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rulespark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start string, ids int"
TEXTS = [None, "", "  \n\t ", "Hello, WORLD! it's\x1cnaïve", "É" * 30 + " ﬁ Ångström é <|endoftext|>x", "the of and in " * 6000, "same text", "same text", "word\x0bapart\x85two"]


def test_capacities():
    assert packing.capacities(0, 8) == []
    assert packing.capacities(29, 8) == [8, 8, 8, 4, 1]


def check(pieces, texts, window=4096):
    tok = Tokenizer.from_file(PATH)
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in texts.items()}
    parts, seqs = {}, {}
    for r in pieces:
        parts.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert set(parts) == set(want)
    for i, rows in parts.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want[i]) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(want[i][at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(want[i])
    for rows in seqs.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and at & (at - 1) == 0


def test_pieces(spark, tmp_path):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    check(packing.query(spark, str(tmp_path)).collect(), dict(enumerate(TEXTS)))


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_costs_are_balanced():
    lengths = [int(x) for x in np.random.default_rng(1).integers(1, 1500, 900)]
    cost = {}
    for _, _, n, k, _ in packing.pack_lengths(lengths, 4096, 1.0, 1 / 2048):
        cost[k] = cost.get(k, 0) + n + n * n / 2048
    full = [cost[k] for k in range(sum(lengths) // 4096)]
    assert max(full) < 1.15 * np.mean(full)


def test_sample(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    check(packing.query(spark, sf).collect(), {r.doc_id: r.text for r in rows})
