"""Sharding by histogram sort.

Rows are put in order by (hash of the text, id), which spreads sources evenly and keeps equal texts
together. The driver holds candidate boundaries in that key space; each round counts, exactly and across all
partitions, the bytes and rows between neighbouring boundaries, and puts finer probes only where a splitter
is still out of tolerance or where a slice holds more rows than one task should order. Then every row is exchanged
once, to its slice, and gets its slot from the counts below the slice plus its place inside.

Law: ``bytes``. Each splitter is within ``TOLERANCE`` of a shard's fair share of bytes, unless a
single row is larger than that. Equal texts stay together up to that tolerance; a larger group is cut
by id. Rows that agree in text and id can't be told apart and stay together. Null text has no bytes and checksum 0; a
null id comes before the others; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import cut, fresh

SHARDS = 16
TOLERANCE = 0.002
#: rows that one task orders at the end; the boundaries on the driver are about rows / SLICE_ROWS
SLICE_ROWS = 1 << 16
PROBES = 48
FIRST, LAST = 0, 1 << 128


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def crc_of(text: Column) -> Column:
    return F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint")


def packed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Two signed 64-bit columns as 16-byte strings whose byte order is the order of the pair."""
    flip = np.uint64(1 << 63)
    both = np.stack([first.view(np.uint64) ^ flip, second.view(np.uint64) ^ flip], axis=1).astype(">u8")
    return np.ascontiguousarray(both).view("S16").ravel()


def as_bytes(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(16, "big") for k in keys], "S16")


def key_columns(batch: pa.RecordBatch, a: int, b: int) -> np.ndarray:
    get = lambda i: batch.column(i).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64)
    return packed(get(a), get(b))


def counts(rows: DataFrame, bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(slice, bytes, rows, least key, greatest key) of the slices between sorted boundaries. ``rows``: k1, k2, size."""
    at = as_bytes(bounds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            key = key_columns(b, 0, 1)
            s = np.searchsorted(at, key, "right")
            order = np.lexsort((key, s))
            s, key = s[order], key[order]
            size = b.column(2).to_numpy()[order]
            first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            last = np.append(first[1:], len(s)) - 1
            wide = lambda k: pa.array([bytes(x).ljust(16, b"\0") for x in k.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(s[first].astype(np.int64)), pa.array(np.add.reduceat(size, first)),
                                              pa.array(last - first + 1), wide(key[first]), wide(key[last])], names=["s", "b", "n", "lo", "hi"])

    got = rows.mapInArrow(count, "s bigint, b bigint, n bigint, lo binary, hi binary").groupBy("s").agg(
        F.sum("b").alias("b"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    return sorted((r.s, r.b, r.n, int.from_bytes(r.lo, "big"), int.from_bytes(r.hi, "big")) for r in got)


def spread(lo: int, hi: int, n: int) -> set[int]:
    """About n boundaries inside lo < b <= hi."""
    return {lo + max(1, (hi - lo) * i // n) for i in range(1, n + 1)} if hi > lo else set()


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, slice_rows: int = SLICE_ROWS,
              probes: int = PROBES) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Shard splitters, and the slices (least key, rows below, shard) that tasks order, from exact counts.

    A boundary b separates keys < b from keys >= b. ``rows``: k1, k2, size.
    """
    bounds: list[int] = []
    probe = sorted(spread(FIRST, LAST - 1, probes * shards))
    ends: dict[int, tuple[int, int]] = {}
    while True:
        bounds = sorted({*bounds, *probe})
        seen = counts(rows, bounds)
        total, n_rows = sum(x[1] for x in seen), sum(x[2] for x in seen)
        if not n_rows:
            return [], []
        # an occupied slice's least key is as good a boundary as the probe that made it
        cum_b = cum_n = 0
        ends, cells = {}, []
        for s, b, n, lo, hi in seen:
            ends[lo] = (cum_b, cum_n)
            cells.append((lo, hi, cum_b, cum_b + b, n))
            cum_b, cum_n = cum_b + b, cum_n + n
        fair, new = total / shards, set()
        for i in range(1, shards):
            want = i * fair
            for lo, hi, b0, b1, _ in cells:
                if b0 < want < b1:
                    if min(want - b0, b1 - want) > tolerance * fair:
                        new |= spread(lo, hi, probes)
        for lo, hi, _, _, n in cells:
            if n > slice_rows:
                new |= spread(lo, hi, probes)
        probe = [k for k in new if k not in bounds]
        if not probe:
            break
    keys = sorted(ends)
    below = [ends[k][0] for k in keys]
    cuts = []
    for i in range(1, shards):
        want = i * total / shards
        j = bisect_right(below, want)
        near = min((k for k in (j - 1, j) if k < len(keys)), key=lambda k: abs(below[k] - want))
        # what lies above the last boundary is one row or one group that can't be cut
        cuts.append(keys[near] if abs(below[near] - want) <= abs(total - want) else LAST)
    slices, full = [], 0
    for k in keys:
        shard = bisect_right(cuts, k)
        here = ends[k][1]
        if not slices or slices[-1][2] != shard or here - full >= slice_rows:
            slices.append((k, here, shard))
            full = here
    return cuts, slices


def shard(docs: DataFrame, text: str = "text", key: str = "doc_id", shards: int = SHARDS, size: Column | None = None,
          text_key: Column | None = None, narrow: DataFrame | None = None, **limits) -> DataFrame:
    """Add shard and slot (gapless from 0 in each shard) to all rows; columns of those names are replaced.

    ``narrow`` may hold k1, k2, size of the rows when they have been worked out before; a null ``key`` counts as least.
    """
    docs = docs.drop(*[c for c in ("shard", "slot") if c not in (text, key)])
    k1, k2, w = fresh(docs, "k1", "k2", "w")
    keyed = docs.withColumns({k1: F.xxhash64(text) if text_key is None else text_key, k2: F.col(key).cast("bigint"),
                              w: size_of(F.col(text)) if size is None else size})
    if narrow is None:
        narrow = cut(keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(w).alias("size")))
    cuts, slices = splitters(narrow, shards, **limits)
    at = as_bytes([s[0] for s in slices])
    below = np.array([s[1] for s in slices], np.int64)
    of = np.array([s[2] for s in slices], np.int64)
    start = np.array([below[np.searchsorted(of, x)] for x in of], np.int64) if slices else below
    a, b = keyed.columns.index(k1), keyed.columns.index(k2)
    sl, base = fresh(keyed, "slice", "base")
    schema = T.StructType([*keyed.schema.fields, T.StructField(sl, T.LongType()), T.StructField(base, T.LongType()), T.StructField("shard", T.IntegerType())])
    names = [f.name for f in schema.fields]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                s = np.searchsorted(at, key_columns(x, a, b), "right") - 1
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(s.astype(np.int64)), pa.array(below[s] - start[s]),
                                                  pa.array(of[s].astype(np.int32))], names=names)

    inside = Window.partitionBy(sl).orderBy(k1, k2, w)
    return (keyed.mapInArrow(place, schema).withColumn("slot", F.col(base) + F.row_number().over(inside) - 1)
            .drop(k1, k2, w, sl, base))


def shards_query(docs: DataFrame) -> DataFrame:
    """Contract columns of every document."""
    t = F.col("text")
    rows = cut(docs.select("doc_id", size_of(t).alias("size"), crc_of(t).alias("text_crc32"), F.xxhash64(t).alias("h")))
    narrow = rows.select(F.col("h").alias("k1"), F.col("doc_id").cast("bigint").alias("k2"), "size")
    got = shard(rows, text="h", text_key=F.col("h"), size=F.col("size"), narrow=narrow)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame) -> DataFrame:
    """All documents with their own columns, then shard, slot and size."""
    (s,) = fresh(docs, "size")
    return shard(docs).withColumn(s, size_of(F.col("text")))
