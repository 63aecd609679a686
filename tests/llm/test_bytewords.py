import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rulespark.llm.bytewords import LONG, NOT_SPACE, batches, buffer_of, word_bounds, word_hashes


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") & 1] for k in range(n))


def hashes(texts):
    buf, offs = buffer_of(pa.array(texts, pa.string()))
    starts, ends, first = word_bounds(buf, offs, NOT_SPACE)
    return word_hashes(buf, starts, ends), first


def test_words_with_much_structure_stay_apart():
    """Thue-Morse words and their complements collide under any polynomial modulo 2**64."""
    words = []
    for n in (8, 16, 32, LONG, LONG + 1, 1024, 4096):
        w = thue_morse(n)
        words += [w, w.translate(str.maketrans("ab", "ba"))]
    words += ["\0", "\0\0", "\0" * 8, "\0" * 9, "a\0", "a"]
    h, _ = hashes(words)
    assert len(set(h.tolist())) == len(words)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab\0é €", max_size=150), max_size=20))
def test_equal_words_and_only_they_have_equal_hashes(texts):
    h, first = hashes(texts)
    words = [w for t in texts for w in re.findall("[^ ]+", t)]
    assert len(words) == len(h) == first[-1]
    by = {}
    for w, x in zip(words, h.tolist()):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_hash_does_not_depend_on_place():
    rows = [pa.record_batch({"text": pa.array(["x " * k + "needle in", "needle"])}) for k in range(20)]
    seen = set()
    for _, buf, offs in batches(iter(rows)):
        starts, ends, first = word_bounds(buf, offs, NOT_SPACE)
        seen.add(int(word_hashes(buf, starts, ends)[first[1]]))
    assert len(seen) == 1 and np.uint64(0) not in seen
