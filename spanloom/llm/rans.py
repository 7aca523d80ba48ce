"""Static range asymmetric numeral system over interleaved lanes, and the block format of token files.

Token i of a block is coded by lane i mod ``LANES``. A lane's state x lies in [2**31, 2**63); a symbol of frequency f (of
2**20) and cumulative frequency c takes x to (x // f) * 2**20 + c + x % f, after moving 32 bits out where x would pass its bound.
Encoding runs from the last token to the first, decoding from the first on. Every ``STEPS`` steps the block notes the states and
the place in the words: decoding starts at any such checkpoint, and a whole block decodes all its checkpoints side by side.

A block, little-endian::

    HEADER  magic, lanes, steps per checkpoint, shard, block, first (ids of the shard before it), n ids, documents, checkpoints, words,
            CRC-32 of the frequency table, CRC-32 of the rest of the block
    int64   per document: key, 1 if the key is null, number in the shard, ids in all, ids before this block, ids in this block
    uint64  per checkpoint and lane: state
    uint32  per checkpoint: words read before it
    uint32  words
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

BITS = 20
LANES = 2048
STEPS = 128
BLOCK_IDS = 4 * LANES * STEPS
LOW = 1 << 31
MAGIC = b"sRA1"
HEADER = "<4sIIQQQQIIQII"
HEADER_BYTES = struct.calcsize(HEADER)
DOC_FIELDS = 6


class Corrupt(ValueError):
    """A block that does not match its checksum, or was written with another table."""


@dataclass
class Table:
    """Frequencies of all symbols, summing to 2**20; symbols that never occur have none."""

    freq: np.ndarray

    def __post_init__(self) -> None:
        self.freq = self.freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.checksum = zlib.crc32(self.freq.astype("<u4").tobytes())
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            small = np.uint16 if len(self.freq) <= 1 << 16 else np.uint32
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=small), self.freq.astype(np.int64))
        return self._symbol


def table(counts: np.ndarray) -> Table:
    """Counts scaled to 2**20, at least 1 for every symbol that occurs; the commonest symbols take up the difference."""
    total, whole = int(counts.sum()), 1 << BITS
    if (counts > 0).sum() > whole:
        raise ValueError(f"more than {whole} different ids")
    if total == 0:
        return Table(np.zeros(len(counts), np.int64))
    freq = np.maximum((counts.astype(np.float64) * (whole / total)).astype(np.int64), counts > 0)
    order = np.argsort(-counts, kind="stable")
    missing = whole - int(freq.sum())
    if missing > 0:
        freq[order[0]] += missing
    for s in order:
        if missing >= 0:
            break
        give = min(-missing, int(freq[s]) - 1)
        freq[s] -= give
        missing += give
    return Table(freq)


def encode(ids: np.ndarray, t: Table, lanes: int = LANES, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(states per checkpoint and lane, words before each checkpoint, words)."""
    freq, start = t.freq[ids], t.start[ids]
    if len(ids) and not freq.all():
        raise ValueError("an id without frequency")
    bound, rest = freq << np.uint64(63 - BITS), np.uint64(1 << BITS) - freq
    x = np.full(lanes, LOW, np.uint64)
    n_steps = -(-len(ids) // lanes)
    states = np.zeros((-(-n_steps // steps), lanes), np.uint64)
    words, sizes = [], np.zeros(n_steps + 1, np.int64)
    for k in range(n_steps - 1, -1, -1):
        a, b = k * lanes, min((k + 1) * lanes, len(ids))
        live = x[:b - a]
        full = np.flatnonzero(live >= bound[a:b])
        if len(full):
            out = live[full]
            words.append(out.astype(np.uint32))
            sizes[k + 1] = len(out)
            live[full] = out >> np.uint64(32)
        # (x // f) * 2**20 + x % f + c
        live += (live // freq[a:b]) * rest[a:b]
        live += start[a:b]
        if k % steps == 0:
            states[k // steps] = x
    before = np.cumsum(sizes)[:-1][::steps].astype(np.uint32) if n_steps else np.zeros(0, np.uint32)
    return states, before, np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)


def decode(states: np.ndarray, before: np.ndarray, words: np.ndarray, n: int, t: Table, steps: int = STEPS) -> np.ndarray:
    """The first ``n`` ids from the given checkpoints on, which are decoded side by side (all but the last are full)."""
    many, lanes = states.shape
    symbol, freq, start = t.symbol, t.freq.astype(np.int64), t.start.astype(np.int64)
    out = np.zeros((many, steps * lanes), symbol.dtype)
    # states stay below 2**63
    x, at, words = states.astype(np.int64), before.astype(np.int64), words.astype(np.int64)
    last = n - (many - 1) * steps * lanes
    edges = np.arange(many + 1) * lanes
    for k in range(steps):
        rows = many if k * lanes < last else many - 1
        if rows == 0:
            break
        live = x[:rows].ravel()
        slot = live & ((1 << BITS) - 1)
        s = symbol.take(slot)
        out[:rows, k * lanes:(k + 1) * lanes] = s.reshape(rows, lanes)
        live >>= BITS
        live *= freq.take(s)
        live += slot
        live -= start.take(s)
        need = np.flatnonzero(live < LOW)
        if rows == many and (k + 1) * lanes > last:  # lanes beyond the last id rest
            need = need[need < (rows - 1) * lanes + last - k * lanes]
        bound = np.searchsorted(need, edges[:rows + 1])
        count = np.diff(bound)
        place = np.arange(len(need)) + np.repeat(at[:rows] - bound[:-1], count)
        live[need] = (live[need] << 32) | words[place]
        at[:rows] += count
    return out.ravel()[:n]


@dataclass
class Block:
    shard: int
    number: int
    first: int
    docs: np.ndarray
    ids: np.ndarray


def pack(block: Block, t: Table) -> bytes:
    states, before, words = encode(block.ids, t)
    body = b"".join((block.docs.astype("<i8").tobytes(), states.astype("<u8").tobytes(), before.astype("<u4").tobytes(), words.astype("<u4").tobytes()))
    return struct.pack(HEADER, MAGIC, LANES, STEPS, block.shard, block.number, block.first, len(block.ids), len(block.docs), len(states), len(words),
                       t.checksum, zlib.crc32(body)) + body


def unpack(data: bytes, at: int, t: Table, lo: int = 0, hi: int | None = None) -> tuple[Block, int]:
    """The block at byte ``at`` and where it ends; with ``lo`` and ``hi`` only these ids, from the checkpoint before ``lo`` on."""
    if len(data) - at < HEADER_BYTES:
        raise Corrupt("a block is cut off")
    magic, lanes, steps, shard, number, first, n, n_docs, points, n_words, table_sum, body_sum = struct.unpack_from(HEADER, data, at)
    at += HEADER_BYTES
    sizes = [n_docs * DOC_FIELDS * 8, points * lanes * 8, points * 4, n_words * 4]
    end = at + sum(sizes)
    if magic != MAGIC or end > len(data) or zlib.crc32(memoryview(data)[at:end]) != body_sum:
        raise Corrupt("a block does not match its checksum")
    if table_sum != t.checksum:
        raise Corrupt("the block was written with another frequency table")
    cut = np.cumsum([at, *sizes])
    docs = np.frombuffer(data, "<i8", n_docs * DOC_FIELDS, cut[0]).reshape(n_docs, DOC_FIELDS)
    states = np.frombuffer(data, "<u8", points * lanes, cut[1]).reshape(points, lanes)
    before, words = np.frombuffer(data, "<u4", points, cut[2]), np.frombuffer(data, "<u4", n_words, cut[3])
    hi = n if hi is None else min(hi, n)
    if lo >= hi:
        return Block(shard, number, first, docs, np.zeros(0, np.uint32)), int(end)
    p, q = lo // (lanes * steps), -(-hi // (lanes * steps))
    skip = p * lanes * steps
    ids = decode(states[p:q], before[p:q], words, min(n, q * lanes * steps) - skip, t, steps)
    return Block(shard, number, first, docs, ids[lo - skip:hi - skip]), int(end)
