"""Language ID by rank-order profiles.

A profile is the list of a language's most frequent n-grams (one to three letters, words
marked off by one boundary) in rank order. A document is compared with each profile by the
out-of-place distance: for each of its own most frequent n-grams, how far its rank is from
the rank in the profile, or ``PROFILE`` where the profile lacks it.

Training reads at most about ``SAMPLE_DOCS`` labelled rows per language, picked by a hash of
the id; everything else reads whole texts. Null text and texts without a letter get ``und`` and
score 0. Ties between languages go to the first name in code point order; ties in rank go to the
smaller n-gram. Repeated rows get equal answers; rows without a label or an id don't train; with no
training rows at all, every row is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import append, fresh, pieces

PROFILE = 300
#: labelled rows per language that profiles are counted from (a documented bound, about this many by hash)
SAMPLE_DOCS = 2000
UNKNOWN = "und"
BOUNDARY, SYMBOL_BITS = 1, 14
SYMBOLS = 1 << SYMBOL_BITS


def fold(code: np.ndarray) -> np.ndarray:
    """Lower-case symbol of each code point: 2 and up for letters, BOUNDARY for the rest."""
    low = 0x3000
    to = np.full(low, BOUNDARY, np.int64)
    for c in range(low):
        if (ch := chr(c)).isalpha():
            l = ch.lower()
            to[c] = 2 + ord(l) if len(l) == 1 and ord(l) < SYMBOLS - 2 else 2 + c
    out = np.full(len(code), BOUNDARY, np.int64)
    near = code < low
    out[near] = to[code[near]]
    if not near.all():
        far = np.flatnonzero(~near)
        kinds, at = np.unique(code[far], return_inverse=True)
        of = np.array([2 + c % (SYMBOLS - 3) if chr(c).isalpha() else BOUNDARY for c in kinds.tolist()], np.int64)
        out[far] = of[at]
    return out


def symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all rows, runs of boundaries made one and one at each end, with the row of each symbol."""
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[off] if len(data) else np.zeros(len(off), np.int64)
    n = len(off) - 1
    # every row is followed by a boundary, and the first one by another in front
    sym = np.full(len(code) + n + 1, BOUNDARY, np.int64)
    row = np.zeros(len(sym), np.int64)
    of = np.repeat(np.arange(n), np.diff(heads))
    place = np.arange(len(code)) + of + 1
    sym[place] = fold(code)
    row[place] = of
    row[heads[1:] + np.arange(1, n + 1)] = np.arange(n)
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != BOUNDARY) | (sym[:-1] != BOUNDARY)
    return sym[keep], row[keep]


def gram_counts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, count) of all rows, ordered by row and n-gram. A row is at most 2**20 - 1."""
    sym, row = symbols(data, off)
    if len(sym) < 2:
        z = np.zeros(0, np.int64)
        return z, z, z
    letter = sym != BOUNDARY
    at = row << (3 * SYMBOL_BITS)
    keys = [(at + sym)[letter]]
    two = (sym[:-1] << SYMBOL_BITS) | sym[1:]
    same = (row[:-1] == row[1:]) | ~letter[:-1]
    ok = same & (letter[:-1] | letter[1:])
    keys.append((at[1:] + two)[ok])
    if len(sym) > 2:
        three = (two[:-1] << SYMBOL_BITS) | sym[2:]
        # the boundary in front of a row belongs to the row before, and serves both
        ok = (letter[1:-1]) & same[:-1] & (row[1:-1] == row[2:])
        keys.append((at[2:] + three)[ok])
    keys = np.sort(np.concatenate(keys))
    if not len(keys):
        return keys, keys, keys
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    n = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return keys >> (3 * SYMBOL_BITS), keys & ((1 << (3 * SYMBOL_BITS)) - 1), n


def top_grams(row: np.ndarray, gram: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, rank) of the ``most`` most frequent n-grams per row."""
    order = np.lexsort((gram, -n, row))
    row, gram = row[order], gram[order]
    first = np.searchsorted(row, row, "left")
    rank = np.arange(len(row)) - first
    keep = rank < most
    return row[keep], gram[keep], rank[keep]


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id",
        sample_docs: int = SAMPLE_DOCS, profile: int = PROFILE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Profiles of the languages in ``label``: names, sorted n-grams, and ranks (n-gram x language).

    Read: labelled rows with an id. The counts are added up by Spark; only ``profile`` rows per language reach the driver.
    """
    rows = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"), F.col(label).cast("string").alias("l")).where("k is not null and l is not null and t is not null")
    # one share per language; the driver holds a whole profile for each anyway
    shares = {r.l: sample_docs / r.n for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    unit = F.pmod(F.xxhash64("k", F.lit("profile")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair]), F.col("l")) if shares else F.lit(0.0)
    picked = rows.where(unit < share).select("l", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, of = np.unique(np.array(b.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
            for lo, hi, data, off in pieces(b.column(1)):
                row, gram, n = gram_counts(data, off)
                key = (of[lo:hi][row].astype(np.int64) << (3 * SYMBOL_BITS)) | gram
                u, at = np.unique(key, return_inverse=True)
                total = np.bincount(at, weights=n, minlength=len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names[u >> (3 * SYMBOL_BITS)].tolist(), pa.string()),
                                                  pa.array(u & ((1 << (3 * SYMBOL_BITS)) - 1)), pa.array(total)], names=["l", "g", "n"])

    totals = picked.mapInArrow(count, "l string, g bigint, n bigint").groupBy("l", "g").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("l").orderBy(F.desc("n"), "g")
    got = totals.withColumn("r", F.row_number().over(best) - 1).where(F.col("r") < profile).select("l", "g", "r").collect()
    names = sorted({x.l for x in got})
    grams = np.array(sorted({x.g for x in got}), np.int64)
    ranks = np.full((len(grams), len(names)), -1, np.int32)
    if got:
        col = {l: i for i, l in enumerate(names)}
        ranks[np.searchsorted(grams, np.array([x.g for x in got], np.int64)), [col[x.l] for x in got]] = [x.r for x in got]
    return names, grams, ranks


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text", pred: str = "lang_pred",
            score: str = "score", profile: int = PROFILE) -> DataFrame:
    """Add the language and a score from 0 to 1: one minus the distance over the largest one possible."""
    names, grams, ranks = model
    docs = docs.drop(*[c for c in (pred, score) if c != text])

    def answer(col: pa.Array) -> list[pa.Array]:
        lang, out = np.full(len(col), -1, np.int64), np.zeros(len(col))
        for lo, hi, data, off in pieces(col):
            for a in range(0, hi - lo, 1 << 19):  # rows fit the bits of gram_counts
                b = min(a + (1 << 19), hi - lo)
                row, gram, n = gram_counts(data[off[a]:off[b]], off[a:b + 1] - off[a])
                row, gram, rank = top_grams(row, gram, n, profile)
                if not len(row) or not names:
                    continue
                at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
                known = grams[at] == gram
                first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                used = np.diff(np.append(first, len(row)))
                dist = np.empty((len(first), len(names)), np.int64)
                for j in range(len(names)):
                    r = ranks[at, j]
                    dist[:, j] = np.add.reduceat(np.where(known & (r >= 0), np.abs(r - rank), profile), first)
                best = dist.argmin(axis=1)
                where = lo + a + row[first]
                lang[where] = best
                out[where] = 1 - dist[np.arange(len(first)), best] / (used * float(profile))
        say = np.array([*names, UNKNOWN], object)
        return [pa.array(say[lang].tolist(), pa.string()), pa.array(out)]

    return append(docs, text, [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())], answer)


def held_out(key: str = "doc_id") -> Column:
    """Rows that must not train: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_query(docs: DataFrame) -> DataFrame:
    """Contract columns of every document."""
    rows = docs.select("doc_id", "text")
    model = fit(docs.where(~held_out()))
    return predict(rows, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame) -> DataFrame:
    """Documents whose language could be told, with their own columns unchanged."""
    pred, score = fresh(docs, "pred", "score")
    got = predict(docs, fit(docs.where(~held_out())), pred=pred, score=score)
    return got.where(F.col(pred) != UNKNOWN).select(*docs.columns)
