"""CRC-32 of joined byte strings from the CRCs and lengths of their parts, over numpy arrays.

crc(a + b) = shift(crc(a), len(b)) ^ crc(b), where ``shift`` appends zero bytes. It is linear over bits, so appending
2**k bytes is a fixed 32 x 32 bit matrix per k, kept as four tables of 256 values.
"""

from __future__ import annotations

import zlib

import numpy as np

#: reversed polynomial of CRC-32
POLY = 0xEDB88320


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


def _tables(columns: np.ndarray) -> np.ndarray:
    """Lookup tables of the matrix whose column i is the image of bit i."""
    out = np.zeros((4, 256), np.uint32)
    for i in range(32):
        step = 1 << (i % 8)
        out[i // 8, step:2 * step] = out[i // 8, :step] ^ columns[i]
    return out


_made: list[np.ndarray] = []


def _zeros(k: int) -> np.ndarray:
    """Tables of appending 2**k zero bytes."""
    while len(_made) <= k:
        bits = np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32))
        if _made:
            bits = _apply(_made[-1], _apply(_made[-1], bits))
        else:
            for _ in range(8):
                bits = (bits >> np.uint32(1)) ^ np.where(bits & 1, np.uint32(POLY), np.uint32(0))
        _made.append(_tables(bits.astype(np.uint32)))
    return _made[k]


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs after ``length`` further zero bytes, without their own contribution."""
    crc, length = np.asarray(crc, np.uint32).copy(), np.asarray(length, np.int64)
    for k in range(int(length.max()).bit_length() if len(length) else 0):
        use = np.flatnonzero((length >> k) & 1)
        crc[use] = _apply(_zeros(k), crc[use])
    return crc


def joined(a: np.ndarray, b: np.ndarray, b_length: np.ndarray) -> np.ndarray:
    """CRCs of a + b."""
    return shift(a, b_length) ^ np.asarray(b, np.uint32)


def of(data: bytes) -> int:
    return zlib.crc32(data)
