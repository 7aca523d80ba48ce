"""Helpers shared by the operators: table access, Arrow text as numpy arrays, word bounds, hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

__all__ = ["append", "cut", "mix64", "pieces", "put_back", "set_aside", "table", "utf8", "word_hashes", "word_spans"]

#: text handled at once inside a task; temporaries are a small multiple of it (one longer text is handled alone)
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for work columns: ``names`` with as many underscores before them as it takes not to clash."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the row bounds in them (one more than rows); null rows are empty."""
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) else "")
    wide = pa.large_binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.large_string()
    col = col.cast(wide)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0]:off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(col: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of about ``limit`` bytes: (first row, end row, bytes, bounds)."""
    data, off = utf8(col)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def word_spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words, and word bounds per row; ``inside[b]`` says whether byte b belongs to words."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    on = inside[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = on[:-1]
    before[off[:-1][off[:-1] < n]] = False
    start = np.flatnonzero(on & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = on[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    end = np.flatnonzero(on & ~after) + 1
    return start, end, np.searchsorted(start, off)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, a bijection of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        row = np.full(size, base, np.uint64)
        row[0] = 1
        _powers[base] = have = np.multiply.accumulate(row)
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """h[i]: sum of values[j] * BASE**j for j < i, modulo 2**64; spans come from ``span_hash``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] that depends on the values alone."""
    return mix64((prefix[end] - prefix[start]) * powers(BASE_INV, len(prefix))[start])


def byte_values(lower: bool = False) -> np.ndarray:
    """A fixed random 64-bit value per byte; with ``lower`` A-Z share those of a-z."""
    v = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if lower:
        v[65:91] = v[97:123]
    return v


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash per word."""
    return span_hash(prefix_hash(byte_values(lower)[data]), start, end)


def not_space() -> np.ndarray:
    """Bytes of ``[^\\x20\\x09-\\x0D]``."""
    on = np.ones(256, bool)
    on[[0x20, *range(0x09, 0x0E)]] = False
    return on


def append(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """Add columns that ``make`` computes from the text column of each Arrow batch; all other columns pass through."""
    schema = T.StructType([*df.schema.fields, *fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, *make(b.column(b.schema.get_field_index(text)))], names=names)

    return df.mapInArrow(run, schema)


def set_aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns under work names, and those names: an operator's own columns can't clash with them."""
    names = {c: f"__own_{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(a) for c, a in names.items()]), names


def put_back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(a).alias(c) for c, a in names.items()])
