"""Substring dedup of words with a compressed FM-index per shard.

A shard's stretches are one word sequence with an FM-index over a wavelet tree. The stretches are streamed
against it: all their windows are searched backwards side by side, a window leaves the search as soon as its interval
holds one suffix only (itself), and matching statistics that reach ``WORDS`` report their interval. The suffixes in an
interval are located from samples; the earliest place among them is the window's first.

A word counts as removed if a window over it also starts earlier: in a document with a smaller id, or before in the same document. Null and
empty texts have no words; a text of fewer words than a window keeps all; rows of one id and equal text are one document; a null id comes
before all others; an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import not_space, word_spans
from .fm import FMIndex, expand
from .repeats import Plan, remove

WORDS = 20
PLAN = Plan(items="words", size=WORDS, gram=5, within=True)


def symbols(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Word sequence of all bodies with separators, the start of each body in it, its words, and the number of symbols."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(b) for b in bodies]))).astype(np.int64)
    start, end, bounds = word_spans(data, off, not_space())
    text, number = data.tobytes(), {}
    word = np.array([number.setdefault(text[a:b], len(number) + 1) for a, b in zip(start.tolist(), end.tolist())], np.int64)
    n = np.diff(bounds)
    seq = np.zeros(len(word) + len(bodies), np.int64)
    seq[np.arange(len(word)) + np.repeat(np.arange(len(bodies)), n)] = word
    return seq, bounds[:-1] + np.arange(len(bodies)), n, len(number)


def matching_intervals(index: FMIndex, seq: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (by number) of ``length`` symbols before ``ends`` that occur more than once, with their rows."""
    at, lo, hi = np.arange(len(ends)), np.zeros(len(ends), np.int64), np.full(len(ends), index.n, np.int64)
    for step in range(1, length + 1):
        lo, hi = index.extend(seq[ends[at] - step], lo, hi)
        keep = hi - lo > 1
        at, lo, hi = at[keep], lo[keep], hi[keep]
    return at, lo, hi


def first_places(bodies: list[bytes], base: np.ndarray, windows: np.ndarray, length: int = WORDS) -> np.ndarray:
    """Least place (base value plus offset) among the stretches that hold each window."""
    seq, begin, _, n_symbols = symbols(bodies)
    index = FMIndex(seq, n_symbols)
    of = np.repeat(np.arange(len(bodies)), windows)
    j = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    out = base[of] + j
    at, lo, hi = matching_intervals(index, seq, begin[of] + j + length, length)
    if len(at):
        ranges, which = np.unique(np.stack([lo, hi], axis=1), axis=0, return_inverse=True)
        rows, r = expand(ranges[:, 0], ranges[:, 1])
        place = index.locate(rows)
        body = np.searchsorted(begin, place, "right") - 1
        low = np.minimum.reduceat(base[body] + place - begin[body], np.searchsorted(r, np.arange(len(ranges))))
        out[at] = low[which.ravel()]
    return out


def kept(data: np.ndarray, begin: np.ndarray, end: np.ndarray, gone: np.ndarray) -> tuple:
    text = [data[a:b].tobytes() for a, b in zip(begin[~gone].tolist(), end[~gone].tolist())]
    return len(begin), int(gone.sum()), hashlib.sha256(b" ".join(text)).hexdigest()


def dedup_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept_sha256 per document."""
    return remove(docs, PLAN, first_places, "n_words bigint, n_removed bigint, kept_sha256 string", [pa.int64(), pa.int64(), pa.string()], kept, key, text)


def passages_query(docs: DataFrame) -> DataFrame:
    """Contract columns of every document."""
    return dedup_words(docs).withColumnRenamed("id", "doc_id")


ORACLE = r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM f WHERE again),
one AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM w),
k AS (SELECT one.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY one.p) AS s FROM one ANTI JOIN gone ON one.doc_id = gone.doc_id AND one.p = gone.p GROUP BY one.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
