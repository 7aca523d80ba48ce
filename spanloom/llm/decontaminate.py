"""Benchmark decontamination with an FM-index per shard of the training text.

Words are runs of letters, digits and non-ASCII characters with A-Z lowered. A benchmark item's windows are its runs of
``WINDOW`` words, or all its words if it has fewer. Each task cuts its documents into shards of a few MB, keeps the
stretches of words that follow one another somewhere in the benchmark (no window occurs elsewhere), indexes them, searches all
windows backwards through the wavelet tree, locates their occurrences from sampled suffix places, and merges
the words they cover into removal spans.

The windows reach the tasks in blocks of at most ``BLOCK_BYTES`` of benchmark text; a larger benchmark takes more
passes over the same rows, without a shuffle. Null and empty texts have no words and no hits; a null item id reads
as an empty one; repeated items count once; an empty benchmark hits nothing. Work columns get names that don't clash; result
columns replace others of their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import append, pieces, put_back, set_aside, word_hashes, word_spans
from .fm import FMIndex, expand

WINDOW = 13
#: benchmark text whose windows one pass holds in each task
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 2 << 20
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def word_bytes() -> np.ndarray:
    """Bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z."""
    on = np.zeros(256, bool)
    on[0x30:0x3A] = on[0x41:0x5B] = on[0x61:0x7B] = on[0x80:] = True
    return on


class Windows:
    """Distinct windows of a block of items over its own symbols, with the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = sorted({name for name, _ in items})
        number = {n: i for i, n in enumerate(self.names)}
        text = pa.array([t for _, t in items], pa.string())
        hashes, bounds = [], [0]
        for _, _, data, off in pieces(text):
            start, end, at = word_spans(data, off, word_bytes())
            hashes.append(word_hashes(data, start, end, lower=True))
            bounds.extend((bounds[-1] + at[1:]).tolist())
        word = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.vocabulary = np.unique(word)
        sym = np.searchsorted(self.vocabulary, word) + 1
        rows, owner = [], []
        for i, (name, _) in enumerate(items):
            a, b = bounds[i], bounds[i + 1]
            for s in range(a, max(a, b - window) + 1):
                if b > a:
                    row = sym[s:min(s + window, b)]
                    rows.append(np.concatenate((np.zeros(window - len(row), np.int64), row)))
                    owner.append(number[name])
        table = np.array(rows, np.int64).reshape(len(rows), window)
        self.patterns, at = np.unique(table, axis=0, return_inverse=True) if len(rows) else (table, np.zeros(0, np.int64))
        self.lengths = (self.patterns > 0).sum(axis=1)
        pair = np.unique(np.stack([at.ravel(), np.array(owner, np.int64)], axis=1), axis=0) if len(rows) else np.zeros((0, 2), np.int64)
        self.item = pair[:, 1]
        self.item_from = np.searchsorted(pair[:, 0], np.arange(len(self.patterns) + 1))
        two = self.patterns[:, :-1] * self.size + self.patterns[:, 1:]
        self.pairs = np.unique(two[self.patterns[:, :-1] > 0])
        self.shortest = int(self.lengths.min()) if len(rows) else 0

    @property
    def size(self) -> int:
        return len(self.vocabulary) + 1


def known(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each x is among the values."""
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def occurrences(word: np.ndarray, bounds: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every window in a shard's words."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(word) or not len(w.patterns):
        return none
    at = np.minimum(np.searchsorted(w.vocabulary, word), len(w.vocabulary) - 1)
    sym = np.where(w.vocabulary[at] == word, at + 1, 0)
    joined = np.zeros(len(word), bool)  # to the word before, as somewhere in the benchmark
    joined[1:] = (sym[1:] > 0) & (sym[:-1] > 0) & known(w.pairs, sym[:-1] * w.size + sym[1:])
    joined[bounds[:-1][bounds[:-1] < len(word)]] = False
    first = np.flatnonzero(~joined)
    long = np.diff(np.append(first, len(word))) >= max(w.shortest, 1)
    keep = np.repeat(long, np.diff(np.append(first, len(word)))) & (sym > 0)
    place = np.flatnonzero(keep)
    if not len(place):
        return none
    new = ~joined[place]
    to = np.arange(len(place)) + np.cumsum(new)  # one separator in front of each stretch
    seq = np.zeros(len(place) + int(new.sum()) + 1, np.int64)
    seq[to] = sym[place]
    source = np.zeros(len(seq), np.int64)
    source[to] = place
    index = FMIndex(seq, w.size - 1)
    pattern, lo, hi = index.search(w.patterns, w.lengths)
    rows, of = expand(lo, hi)
    return source[index.locate(rows)], pattern[of]


def scan(docs: DataFrame, text: str, w: Windows, spans: str, items: str, n_words: str) -> DataFrame:
    """Add merged spans of hit words, the items hit, and the number of words."""
    def find(col: pa.Array) -> list[pa.Array]:
        all_spans, all_items, words = [], [], np.zeros(len(col), np.int64)
        for lo, hi, data, off in pieces(col, SHARD_BYTES):
            start, end, bounds = word_spans(data, off, word_bytes())
            words[lo:hi] = np.diff(bounds)
            at, window = occurrences(word_hashes(data, start, end, lower=True), bounds, w)
            doc = np.searchsorted(bounds, at, "right") - 1
            cover = np.zeros(len(start) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + w.lengths[window], -1)
            hit = np.cumsum(cover)[:-1] > 0
            edge = np.zeros(len(hit) + 1, bool)
            edge[bounds] = True
            open_ = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate(([False], hit[:-1]))))
            close = np.flatnonzero(hit & (edge[1:] | ~np.concatenate((hit[1:], [False])))) + 1
            of = np.searchsorted(bounds, open_, "right") - 1
            per = [[] for _ in range(hi - lo)]
            for d, s, e in zip(of.tolist(), (open_ - bounds[of]).tolist(), (close - bounds[of]).tolist()):
                per[d].append({"start": s, "end": e})
            names = [[] for _ in range(hi - lo)]
            if len(doc):
                u = np.unique(np.stack([doc, window], axis=1), axis=0)
                i, k = expand(w.item_from[u[:, 1]], w.item_from[u[:, 1] + 1])
                for d, x in np.unique(np.stack([u[k, 0], w.item[i]], axis=1), axis=0).tolist():
                    names[d].append(w.names[x])
            all_spans += per
            all_items += names
        return [pa.array(all_spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(all_items, pa.list_(pa.string())), pa.array(words)]

    return append(docs, text, [T.StructField(spans, SPANS), T.StructField(items, T.ArrayType(T.StringType())), T.StructField(n_words, T.LongType())], find)


def merged(spans: Column) -> Column:
    """Sorted spans with overlapping and touching ones made one."""
    zero = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]), F.concat(
            F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), zero, add)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                   window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add n_words, n_hit, items (sorted), removal_spans (words, end exclusive) and contaminated to all rows."""
    names = ("n_words", "n_hit", "items", "removal_spans", "contaminated")
    docs = docs.drop(*[c for c in names if c != text])
    bench = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("t")).where("t is not null").distinct()
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = docs
    for b in range(blocks):
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == b)
        w = Windows(sorted((r.item, r.t) for r in part.collect()), window)
        out = scan(out, text, w, f"__spans_{b}", f"__items_{b}", "n_words" if b == 0 else f"__n_{b}")
    spans = F.col("__spans_0") if blocks == 1 else merged(F.flatten(F.array(*[f"__spans_{b}" for b in range(blocks)])))
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[f"__items_{b}" for b in range(blocks)]))))
    out = out.withColumns({"removal_spans": spans, "items": items})
    out = out.withColumn("n_hit", F.aggregate("removal_spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"]))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).select(*docs.columns, *names)


def decontamination_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contract columns of every document."""
    got = find_benchmark(docs.select("doc_id", "text"), benchmark)
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that are not contaminated, with their own columns."""
    own, names = set_aside(docs)
    return put_back(find_benchmark(own, benchmark, text=names["text"]).where("not contaminated"), names)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i:i + 12], ' ') AS g
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.k, win.item FROM dw JOIN win ON dw.g = win.g AND dw.k = win.k),
cov AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
