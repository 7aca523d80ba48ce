"""Suffix-array dedup of bytes by threshold-bounded interval expansion.

A shard's stretches are one byte sequence; its suffixes are put in the order of their first bytes, its Burrows-Wheeler
transform goes into a wavelet tree, and intervals of suffixes with a common prefix are expanded breadth first: each interval of prefix
w gives the intervals of cw for all bytes c before it. Intervals appear by increasing prefix length, so the first one to end at a
place tells the common prefix of the two suffixes there; expansion stops at ``LENGTH``. Places that no shorter interval has
reached join suffixes with ``LENGTH`` bytes in common, and the least document in such a group is the first to hold the string.

Null and empty texts have no bytes; a text shorter than the window keeps all; repeated rows (same id) are the same document, whose strings
are not earlier than themselves; a null id comes before all others; an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .fm import Wavelet
from .repeats import Plan, remove

LENGTH = 50
PLAN = Plan(items="bytes", size=LENGTH, gram=20, within=False)


def bounded_order(seq: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least (0 ends a comparison); symbols below 256."""
    n = len(seq)
    bits = max(1, int(seq.max()).bit_length())
    h = 64 // bits  # symbols of the first key
    padded = np.concatenate((seq.astype(np.uint64), np.zeros(h, np.uint64)))
    key = np.zeros(n, np.uint64)
    live = np.ones(n, bool)
    for i in range(h):
        c = np.where(live, padded[i:i + n], np.uint64(0))
        key = (key << np.uint64(bits)) | c
        live &= c > 0
    gap = np.where(seq == 0, np.arange(n), n)
    ahead = np.minimum.accumulate(gap[::-1])[::-1] - np.arange(n)  # symbols before the next separator
    times, width = (3, 21) if n < 1 << 21 else (2, 32)  # ranks of neighbouring prefixes that fit into one key
    while True:
        order = np.argsort(key)
        s = key[order]
        new = np.zeros(n, np.int64)
        np.cumsum(s[1:] != s[:-1], out=new[1:])
        if h >= depth or new[-1] == n - 1:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = new + 1
        key = rank
        for k in range(1, times):
            tail = np.zeros(n, np.uint64)
            tail[:max(n - k * h, 0)] = rank[k * h:]
            tail[ahead < k * h] = 0  # a prefix that met a separator is not compared further
            key = (key << np.uint64(width)) | tail
        h *= times


def common_prefix_breaks(tree: Wavelet, first: np.ndarray, n: int, n_symbols: int, depth: int) -> np.ndarray:
    """For places 0..n: whether the suffixes on both sides share fewer than ``depth`` symbols, by interval expansion."""
    broken = np.zeros(n + 1, bool)
    broken[0] = broken[n] = True
    # intervals of one symbol
    lo = first[:-1].astype(np.int64)
    hi = first[1:].astype(np.int64)
    lo, hi = lo[1:], hi[1:]  # prefixes with a separator are no prefixes of windows
    keep = hi > lo
    lo, hi = lo[keep], hi[keep]
    # suffixes that begin with a separator share nothing
    broken[:first[1] + 1] = True
    broken[hi] = True
    broken[lo] = True
    shift = (first[:-1] - tree.start).astype(np.int32)
    lo, hi = lo.astype(np.int32), hi.astype(np.int32)
    for _ in range(1, depth):
        if not len(lo):
            break
        lo, hi, c = split(tree, lo, hi)
        base = shift[c]
        lo, hi = base + lo, base + hi
        # an interval is needed while its right or left end is new; the rest was reached by a shorter prefix
        fresh = (~broken[hi] | ~broken[lo]) & (c > 0)
        lo, hi = lo[fresh], hi[fresh]
        broken[hi] = True
        broken[lo] = True
    return broken


def split(tree: Wavelet, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols inside the ranges of the transform: for each (places after the last level, symbol)."""
    c = np.zeros(len(lo), np.int32)
    for k in range(tree.bits):
        a, b = tree.ones(k, lo), tree.ones(k, hi)
        zero_lo, zero_hi = lo - a, hi - b
        one_lo, one_hi = tree.zeros[k] + a, tree.zeros[k] + b
        z, o = zero_hi > zero_lo, one_hi > one_lo
        lo, hi = np.concatenate((zero_lo[z], one_lo[o])), np.concatenate((zero_hi[z], one_hi[o]))
        c = np.concatenate((c[z] << 1, (c[o] << 1) | 1))
    return lo, hi, c


def first_holders(bodies: list[bytes], base: np.ndarray, windows: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Least base value among the stretches that hold each window."""
    size = np.array([len(b) for b in bodies], np.int64)
    raw = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    begin = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    gap = np.zeros(len(raw), bool)
    gap[begin + size] = True
    used = np.flatnonzero(np.bincount(raw[~gap], minlength=256))
    to = np.zeros(256, np.int64)
    to[used] = np.arange(1, len(used) + 1)
    if len(used) > 255:
        to[used[-1]] = 255  # all 256 byte values never occur together in UTF-8
    seq = to[raw]
    seq[gap] = 0
    order = bounded_order(seq, depth)
    tree = Wavelet(seq[order - 1], len(used), counted=True)
    first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=len(used) + 1)))).astype(np.int64)
    broken = common_prefix_breaks(tree, first, len(seq), len(used), depth)
    heads = np.flatnonzero(broken[:-1])
    owner = np.repeat(np.arange(len(bodies)), size + 1)
    low = np.minimum.reduceat(base[owner[order]], heads)
    at = np.empty(len(seq), np.int64)
    at[order] = np.repeat(low, np.diff(np.append(heads, len(seq))))
    of = np.repeat(np.arange(len(bodies)), windows)
    return at[begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)]


def kept(data: np.ndarray, begin: np.ndarray, end: np.ndarray, gone: np.ndarray) -> tuple:
    n = int(gone.sum())
    own = data[begin[0]:end[-1]] if len(begin) else data[:0]
    spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
    return len(own), n, spans, hashlib.sha256((own[~gone] if n else own).tobytes()).hexdigest()


def dedup_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 per document."""
    return remove(docs, PLAN, first_holders, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
                  [pa.int64(), pa.int64(), pa.int64(), pa.string()], kept, key, text)


def substrings_query(docs: DataFrame) -> DataFrame:
    """Contract columns of every document."""
    return dedup_bytes(docs).withColumnRenamed("id", "doc_id")
