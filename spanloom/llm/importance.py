"""Importance resampling towards a target distribution, with hashed n-grams found by an Aho-Corasick dictionary.

Texts are folded first: A-Z to lower case, every byte outside words to a blank. The dictionary of a piece of text (about
``PIECE`` bytes) holds its distinct words, each bounded by blanks, so that a match is a whole word; its payloads are the
word's CRC-32 and length. One scan of the automaton emits the payloads in order. N-grams of two and more words come from
neighbouring payloads alone: the CRC of the joined text follows from CRCs and lengths. Buckets are written as a narrow
table, which serves counting and scoring, so text is read once. A dictionary per piece keeps memory bounded at any
vocabulary; nothing is collected but one count per bucket.

Ranks come from a range exchange of narrow rows by (score, id) and the row counts per partition; no task orders all
rows, and rows of equal score are split by id.

Null and empty texts have no words, weight 0, and are never drawn. Long texts are cut at blanks into pieces; their
payloads stay together (4 bytes a word). Repeated rows are scored and ranked one by one, in the order of id, weight and
number of features; a null id comes first and is hashed as if empty. Without target texts or documents the gains are those
of zero counts. Extra columns are ignored by the query and kept by ``resample``, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import crc
from .base import cut, pieces, put_back, set_aside

BUCKETS = 10_000
WORDS = 1
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
#: text scanned with one dictionary
PIECE = 4 << 20


def folding() -> np.ndarray:
    """Byte to byte: words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing, all other bytes become blanks."""
    to = np.arange(256, dtype=np.uint8)
    to[65:91] += 32
    to[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20
    return to


def chunks(folded: bytes, off: np.ndarray, limit: int = PIECE) -> Iterator[bytes]:
    """Rows on end, each closed by a line feed (no folded text holds one); a longer row is cut at blanks."""
    if len(off) != 2 or len(folded) <= limit:
        yield b" " + b" \n ".join(folded[a:b] for a, b in zip(off[:-1], off[1:])) + b" \n"
        return
    at = 0
    while len(folded) - at > limit:
        end = folded.rfind(b" ", at + 1, at + limit)
        end = end if end > 0 else folded.find(b" ", at + limit)
        if end < 0:
            break
        yield b" " + folded[at:end] + b" "
        at = end
    yield b" " + folded[at:] + b" \n"


def payloads(chunk: bytes) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 and length of every word in order; the end of a row has length -1."""
    text = chunk.decode("utf-8", "surrogateescape")
    words = set(text.split(" "))
    words -= {"", "\n"}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    automaton.add_word("\n", 0)
    sums, lengths = np.zeros(len(words) + 1, np.uint32), np.full(len(words) + 1, -1, np.int64)
    for i, word in enumerate(words, 1):
        automaton.add_word(f" {word} ", i)
        raw = word.encode("utf-8", "surrogateescape")
        sums[i], lengths[i] = zlib.crc32(raw), len(raw)
    automaton.make_automaton()
    hits = np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int32)
    return sums[hits], lengths[hits]


def compose(sums: np.ndarray, lengths: np.ndarray, end: np.ndarray, words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(first word, CRC) of the runs of 1 to ``words`` words, per run length; ``end``: where the row of a word ends."""
    blank = np.uint32(zlib.crc32(b" "))
    first, run, out = np.arange(len(sums)), sums, []
    for k in range(words):
        if k:
            fits = first + k < end[first]
            first, run = first[fits], run[fits]
            run = crc.shift(run, np.ones(len(run), np.int64)) ^ blank
            run = crc.joined(run, sums[first + k], lengths[first + k])
        out.append((first, run))
    return out


def row_buckets(data: np.ndarray, off: np.ndarray, words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and features per row, and the buckets of all features, row by row."""
    found = [payloads(c) for c in chunks(folding()[data].tobytes(), off)]
    sums, lengths = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    closed = lengths < 0
    n_words = np.diff(np.concatenate(([0], np.flatnonzero(closed) - np.arange(closed.sum()))))
    sums, lengths = sums[~closed], lengths[~closed]
    row = np.repeat(np.arange(len(n_words)), n_words)
    end = np.cumsum(n_words)[row]
    runs = compose(sums, lengths, end, words)
    at = np.concatenate([row[f] for f, _ in runs])
    got = np.concatenate([r for _, r in runs]) % np.uint32(buckets)
    if words > 1:
        order = np.argsort(at, kind="stable")
        at, got = at[order], got[order]
    return n_words, np.bincount(at, minlength=len(n_words)), got.astype(np.int32)


def features(docs: DataFrame, text: str = "text", words: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """Replace the text by n_words, n_features and the buckets of its features; other columns stay."""
    rest = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*rest, T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()),
                           T.StructField("buckets", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in pieces(b.column(b.num_columns - 1), PIECE):
                n_words, n, got = row_buckets(data, off, words, buckets)
                bound = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*b.slice(lo, hi - lo).columns[:-1], pa.array(n_words), pa.array(n), pa.ListArray.from_arrays(pa.array(bound), pa.array(got))],
                    names=schema.names)

    return docs.select(*[F.col(f"`{f.name}`") for f in rest], F.col(f"`{text}`")).mapInArrow(run, schema)


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows; a task sends at most one number per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    got = rows.select("buckets").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares per bucket."""
    s_all, t_all, k = float(corpus.sum()), float(target.sum()), float(len(corpus))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """Replace ``buckets`` by ``weight``: the floored mean gain of the row's features (0 without any)."""
    rest = [f for f in rows.schema.fields if f.name != "buckets"]
    schema = T.StructType([*rest, T.StructField("weight", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(b.num_columns - 1)
            off = col.offsets.to_numpy()
            total = np.concatenate(([0], np.cumsum(gain[col.flatten().to_numpy()])))
            n = np.diff(off)
            weight = (total[off[1:] - off[0]] - total[off[:-1] - off[0]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(weight)], names=schema.names)

    return rows.select(*[F.col(f"`{f.name}`") for f in rest], "buckets").mapInArrow(run, schema)


def noise(key: str, seed: str = SEED) -> Column:
    """floor(1000 x Gumbel noise) from the first 32 bits of sha256(``seed:key``)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("bigint")


def ranked(rows: DataFrame, key: str, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """Add ``rank``: the place of a row among the ``percent`` drawn of all rows with ``min_words`` words, null if not drawn."""
    rows = cut(rows.withColumn("_in", F.col("n_words") >= min_words))
    drawn = percent * rows.where("_in").count() // 100
    order = [F.desc("_in"), F.desc("score"), F.col(key).asc_nulls_first(), F.col("weight"), F.col("n_features")]
    # the id of a row: partition, and its place there; partitions follow each other in order
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = 0, []
    for p, n in sorted(dealt.groupBy(part.alias("p")).count().collect()):
        offsets.append((p, before))
        before += n
    starts = rows.sparkSession.createDataFrame(offsets, "_p bigint, _before bigint")
    rank = F.col("_before") + place + 1
    return (dealt.withColumn("_p", part).join(starts, "_p")
            .withColumn("rank", F.when(F.col("_in") & (rank <= drawn), rank)).drop("_p", "_before", "_at", "_in"))


def importance(docs: DataFrame, target: DataFrame, key: str, text: str, target_text: str = "text", words: int = WORDS, buckets: int = BUCKETS,
               min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """All documents without their text, with n_words, n_features, weight, score and rank."""
    rows = cut(features(docs, text, words, buckets))
    gain = gains(bucket_counts(rows, buckets), bucket_counts(features(target.select(target_text), target_text, words, buckets), buckets))
    return ranked(weighted(rows, gain).withColumn("score", F.col("weight") + noise(key, seed)), key, min_words, percent)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **how: object) -> DataFrame:
    """The drawn documents with all their columns."""
    own, names = set_aside(docs)
    got = importance(own.withColumn("_text", F.col(names[text])), target, names[key], "_text", **how)
    return put_back(got.where(F.col("rank").isNotNull()), names)


def importance_query(docs: DataFrame, target: DataFrame) -> DataFrame:
    return importance(docs.select("doc_id", "text"), target, "doc_id", "text").select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
aims AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
d AS (SELECT r, unnest(w) AS g FROM words),
a AS (SELECT unnest(w) AS g FROM aims),
eight AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
              lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) x(i))),
hashed AS (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(g))), lambda i: ('0x' || substr(hex(g), 2 * i + 1, 2))::BIGINT)),
              lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b
           FROM (SELECT DISTINCT g FROM (SELECT g FROM d UNION ALL SELECT g FROM a)), eight),
s AS (SELECT b, count(*) AS s FROM d JOIN hashed USING (g) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM a JOIN hashed USING (g) GROUP BY b),
totals AS (SELECT (SELECT count(*) FROM d)::DOUBLE AS s_all, (SELECT count(*) FROM a)::DOUBLE AS t_all),
gain AS (SELECT i AS b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g
         FROM totals, range(10000) x(i) LEFT JOIN s ON s.b = i LEFT JOIN t ON t.b = i),
weight AS (SELECT r, sum(gain.g)::BIGINT AS total, count(*) AS n FROM d JOIN hashed USING (g) JOIN gain USING (b) GROUP BY r),
scored AS (SELECT doc_id, r, len(w) AS n, (CASE WHEN total % n < 0 THEN total // n - 1 ELSE total // n END) AS weight,
                  ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
           FROM words LEFT JOIN weight USING (r)),
full_score AS (SELECT doc_id, r, n, coalesce(weight, 0) AS weight,
                      coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored),
placed AS (SELECT *, row_number() OVER (ORDER BY n >= 20 DESC, score DESC, doc_id NULLS FIRST, weight, n) AS place, (10 * count(*) FILTER (n >= 20) OVER ()) // 100 AS drawn FROM full_score)
SELECT doc_id, n::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN n >= 20 AND place <= drawn THEN place END::BIGINT AS rank FROM placed
"""
