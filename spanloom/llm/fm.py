"""FM-index of one shard of symbols, in numpy: suffix order, wavelet tree, backward search, location.

A shard is an array of symbols 1..n in which 0 separates pieces of text. Separators differ from one another (they
compare by position), so no comparison and no match crosses one. Everything is done for many rows or patterns at once.
"""

from __future__ import annotations

import numpy as np

SAMPLE_BITS = 3


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order; ``seq`` ends with a separator. Prefix doubling over ranks."""
    n = len(seq)
    sep = seq == 0
    n_sep = int(sep.sum())
    rank = np.where(sep, np.cumsum(sep) - 1, n_sep - 1 + seq.astype(np.int64))
    order = np.argsort(rank)
    h = 1
    while True:
        tail = np.zeros(n, np.int64)
        tail[:n - h] = rank[h:]
        key = (rank << 32) | tail
        order = np.argsort(key)
        key = key[order]
        new = np.empty(n, np.int64)
        new[0] = 0
        np.cumsum(key[1:] != key[:-1], out=new[1:])
        rank[order] = new
        if new[-1] == n - 1:
            return order
        h *= 2


class Wavelet:
    """Wavelet tree over a symbol array, one packed bit row per level (high bit first), with block counts."""

    def __init__(self, seq: np.ndarray, n_symbols: int, counted: bool = False):
        """``counted`` keeps a count per place instead of packed bits: larger, and faster to ask."""
        self.n, self.bits = len(seq), max(1, int(n_symbols).bit_length())
        self.words, self.before, self.zeros = [], [], []
        self.counts: list[np.ndarray] = []
        now = seq
        for level in range(self.bits - 1, -1, -1):
            bit = ((now >> level) & 1).astype(np.uint8)
            if counted:
                self.counts.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
                self.zeros.append(self.n - int(self.counts[-1][-1]))
                now = np.concatenate((now[bit == 0], now[bit == 1]))
                continue
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate((packed, np.zeros(16 - len(packed) % 8, np.uint8))).view(np.uint64)
            self.words.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed).astype(np.int64)))).astype(np.uint32))
            self.zeros.append(self.n - int(bit.sum()))
            now = np.concatenate((now[bit == 0], now[bit == 1]))
        self.start = self._down(np.arange(n_symbols + 1), np.zeros(n_symbols + 1, np.int64))

    def ones(self, level: int, i: np.ndarray) -> np.ndarray:
        """Set bits before place i of a level."""
        if self.counts:
            return self.counts[level][i]
        block = i >> 6
        part = self.words[level][block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[level][block].astype(np.int64) + np.bitwise_count(part)

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            one = self.ones(k, i)
            i = np.where((c >> (self.bits - 1 - k)) & 1, self.zeros[k] + one, i - one)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c before place i."""
        return self._down(c, i) - self.start[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at place i and its occurrences before i."""
        c = np.zeros(len(i), np.int64)
        for k in range(self.bits):
            bit = (self.words[k][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)
            one = self.ones(k, i)
            i = np.where(bit, self.zeros[k] + one, i - one)
            c = (c << 1) | bit.astype(np.int64)
        return c, i - self.start[c]


class FMIndex:
    """Backward search and location over one shard."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        order = suffix_order(seq)
        bwt = seq[order - 1]  # before place 0 stands the last separator
        self.n = len(seq)
        self.tree = Wavelet(bwt.astype(np.int64), n_symbols)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=n_symbols + 1))))[:-1].astype(np.int64)
        kept = ((order & ((1 << SAMPLE_BITS) - 1)) == 0) | (bwt == 0)
        self.sampled = kept
        self.sample_at = np.cumsum(kept) - 1
        self.samples = order[kept]

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of c + pattern from the rows lo..hi-1 of the pattern."""
        base = self.first[c]
        return base + self.tree.rank(c, lo), base + self.tree.rank(c, hi)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns that occur, with their rows: (pattern, lo, hi). ``patterns``: one per line, right-aligned."""
        at = np.arange(len(patterns))
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64)
        wide = patterns.shape[1]
        for step in range(wide):
            more = lengths[at] > step
            c = patterns[at, wide - 1 - step]
            l2, h2 = self.extend(np.where(more, c, 0), lo, hi)
            lo, hi = np.where(more, l2, lo), np.where(more, h2, hi)
            keep = lo < hi
            at, lo, hi = at[keep], lo[keep], hi[keep]
        return at, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text place of each suffix row: walk left to a sampled one."""
        out = np.zeros(len(rows), np.int64)
        todo, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.sampled[rows]
            out[todo[hit]] = self.samples[self.sample_at[rows[hit]]] + steps
            todo, rows = todo[~hit], rows[~hit]
            if len(rows):
                c, before = self.tree.access(rows)
                rows = self.first[c] + before
            steps += 1
        return out


def expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges lo..hi-1, and the range of each."""
    n = hi - lo
    of = np.repeat(np.arange(len(lo)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[of], of
