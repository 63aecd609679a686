"""Values of distinct words, kept within a worker: each word is worked out once.

Texts repeat their words, so a value that depends on a word alone (its subword
ids, a vector) is computed for the distinct words of a piece and looked up by
the word's 64-bit hash afterwards.  The cache is bounded: it is emptied when
`most` words are in it.
"""

from __future__ import annotations

import numpy as np

from .bytewords import LOWER, NOT_SPLIT, strings, table, word_bounds, word_hashes


class Slots:
    """Hashes and their rows (0, 1, ... in order of entry) in an open table that grows; whole arrays are looked up at once."""

    def __init__(self):
        self.n = 0
        self.resize(1 << 12)

    def resize(self, size: int) -> None:
        self.keys, self.row = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.mask = np.uint64(size - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 where it is unknown."""
        at = (h & self.mask).astype(np.int64)
        out = self.row[at]
        off = np.flatnonzero((out >= 0) & (self.keys[at] != h))
        while len(off):
            at[off] = (at[off] + 1) & int(self.mask)
            out[off] = self.row[at[off]]
            off = off[(out[off] >= 0) & (self.keys[at[off]] != h[off])]
        return out

    def enter(self, h: np.ndarray) -> None:
        """Gives the next rows to hashes that are new and distinct."""
        if 3 * (self.n + len(h)) > len(self.row):
            known = self.row >= 0
            old, rows = self.keys[known], self.row[known]
            self.resize(1 << (4 * (self.n + len(h))).bit_length())
            self.put(old, rows)
        self.put(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)

    def put(self, h: np.ndarray, rows: np.ndarray) -> None:
        at, left = (h & self.mask).astype(np.int64), np.arange(len(h))
        while len(left):
            free = left[self.row[at[left]] < 0]
            self.keys[at[free]] = h[free]
            self.row[at[free]] = rows[free]
            left = left[self.row[at[left]] != rows[left]]
            at[left] = (at[left] + 1) & int(self.mask)


class WordRows:
    """One row of `width` floats for each word; `compute` gets a list of words."""

    def __init__(self, compute, width: int, most: int = 1 << 19):
        self.compute, self.width, self.most = compute, width, most
        self.clear()

    def clear(self) -> None:
        self.known = Slots()
        self.values = np.zeros((1024, self.width), dtype=np.float32)

    def add(self, words: list[bytes]) -> None:
        n, m = self.known.n, len(words)
        if n + m > len(self.values):
            grown = np.zeros((max(2 * len(self.values), n + m), self.width), dtype=np.float32)
            grown[:n] = self.values[:n]
            self.values = grown
        for a in range(0, m, 8192):
            self.values[n + a : n + min(m, a + 8192)] = self.compute(words[a : a + 8192])

    def rows(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of each word."""
        if self.known.n > self.most:
            self.clear()
        h = word_hashes(buf, starts, ends)
        row = self.known.find(h)
        new = np.flatnonzero(row < 0)
        if len(new):
            u, at, back = np.unique(h[new], return_index=True, return_inverse=True)
            self.add(strings(buf, starts, ends, new[at]))
            row[new] = self.known.n + back
            self.known.enter(u)
        return row


ASCII_LETTER = np.zeros(256, dtype=bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True
#: Marks between which and a letter the tokenizer always parts.
MARK = ~table(outside=b'.,;:!?"()*$%&#')
#: Bytes of words that must be tokenized as they stand: non-ASCII ones compose in NFC, and bars are in special tokens.
AS_IS = ~table(outside=b"|")
AS_IS[0x80:] = True


class WordIds(WordRows):
    """Subword ids by the public tokenizer word_bpe_49k.

    It drops white space, parts letters from marks, and folds case, so texts are
    cut there and ASCII words are folded before they are looked up.
    """

    def __init__(self, path: str, most: int = 1 << 19):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.closes[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        super().__init__(None, 0, most)

    def clear(self) -> None:
        self.known = Slots()
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat, self.used = np.zeros(8192, np.uint32), 0

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each has.

        A word of letters alone is one word to the tokenizer too, so such words go in lines and are told apart by
        the ids that close a word; should the closing ids not be as many as the words, each word goes by itself.
        """
        if words and all(map(str.isalpha, words)):
            lines = [" ".join(words[k : k + 128]) for k in range(0, len(words), 128)]
            ids = np.concatenate([np.array(x.ids, np.int64) for x in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.flatnonzero(self.closes[ids])
            if len(ends) == len(words) and ends[-1] == len(ids) - 1:
                return ids, np.diff(ends, prepend=-1)
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.int64, int(size.sum())), size

    def add(self, words: list[bytes]) -> None:
        n, m = self.known.n, len(words)
        if n + m > len(self.start):
            more = max(len(self.start), m)
            self.start, self.length = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.start, self.length))
        texts = [w.decode() for w in words]
        plain = np.fromiter(map(str.isalpha, texts), bool, m)
        for which in (np.flatnonzero(plain), np.flatnonzero(~plain)):
            for a in range(0, len(which), 4096):
                some = which[a : a + 4096]
                ids, size = self.encode([texts[k] for k in some])
                if self.used + len(ids) > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
                self.flat[self.used : self.used + len(ids)] = ids
                self.length[n + some] = size
                self.start[n + some] = self.used + np.cumsum(size) - size
                self.used += len(ids)

    @staticmethod
    def cut(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Folded bytes and the bounds of the words."""
        starts, ends, first = word_bounds(buf, offs, NOT_SPLIT)
        if not len(starts):
            return buf, starts, ends, first
        as_is = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(AS_IS[buf], out=as_is[1:])
        kept = np.flatnonzero(as_is[ends] > as_is[starts])
        out = LOWER[buf]
        if len(kept):
            inside = np.zeros(len(buf) + 1, np.int8)
            inside[starts[kept]] += 1
            inside[ends[kept]] -= 1
            inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
            out[inside] = buf[inside]
        letter, mark = ASCII_LETTER[buf], MARK[buf] & NOT_SPLIT[buf]
        parts = np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1
        parts = parts[~np.isin(parts, offs)] if len(offs) < 3 else parts[offs[np.searchsorted(offs, parts)] != parts]
        at = np.searchsorted(parts, offs)
        return out, np.sort(np.concatenate([starts, parts])), np.sort(np.concatenate([ends, parts])), first + at

    def ids(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): text i has the ids first[i] to first[i + 1]."""
        buf, starts, ends, first = self.cut(buf, offs)
        row = self.rows(buf, starts, ends)
        size = self.length[row]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.start[row] - upto[:-1], size) + np.arange(upto[-1])]
        return ids, upto[first]
