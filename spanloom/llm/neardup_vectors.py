"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative per group.

Equal vectors are made one first, with their count. Centroids are fitted by spherical k-means (cosine assignment, mean direction)
on a bounded sample; every vector is then assigned to its nearest centroid and compared inside that
cell. A pair whose ends lie in different cells is not lost: a vector also visits each cell whose border is
within reach. With centroids a, b, a point y nearest to b and a point x nearest to a, (a-b).(x-y) >= (a-b).x, so
|x-y| >= (a-b).x / |a-b|; a link at cosine c needs |x-y| <= sqrt(2 - 2c). Cells are compared in blocks of bounded size; each
block product yields link counts per vector and a spanning forest of its links, never the pairs. The forests'
components, by alternating stars over tables, are the groups.

Exact: links are those with cosine >= ``THRESHOLD`` in double precision. Null, zero, empty and non-finite vectors and rows without an id link with
nothing; vectors of different lengths do not link. Repeated rows are vectors of their own that link with each other; rows of one id and unlike
vectors count as one node when groups are named. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut
from .components import components

THRESHOLD = 0.95
#: vectors the centroids are fitted on (a documented bound), vectors per cell aimed at, most centroids, Lloyd rounds
SAMPLE = 20_000
CELL = 400
MOST_CELLS = 4096
ROUNDS = 6
#: vectors per block; a block product holds BLOCK**2 cosines
BLOCK = 1024
#: room for rounding when borders are tested
SLACK = 1e-6


def usable(vec: Column) -> Column:
    """Whether the vector can link: not null or empty, all components finite, not all zero."""
    d = F.transform(vec, lambda x: x.cast("double"))
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vec) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(d, lambda x: x != 0), F.lit(False))


def unit_rows(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows; an empty cell is seeded again with the row worst served."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        best, cos = np.empty(len(x), np.int64), np.empty(len(x))
        for s in range(0, len(x), 4096):
            p = x[s:s + 4096] @ c.T
            best[s:s + 4096] = p.argmax(axis=1)
            cos[s:s + 4096] = p.max(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, best, x)
        length = np.sqrt((sums * sums).sum(axis=1))
        empty = np.flatnonzero(length < 1e-12)
        length[empty] = 1
        c = sums / length[:, None]
        c[empty] = x[np.argsort(cos)[:len(empty)]]
    return c


def fit(vectors: DataFrame, n: int, sample: int = SAMPLE, cell: int = CELL, most: int = MOST_CELLS) -> np.ndarray:
    """Centroids from about ``sample`` vectors picked by hash (``vectors``: id, vec; all usable and of one length)."""
    share = sample / max(n, 1)
    rows = vectors if share >= 1 else vectors.where(F.pmod(F.xxhash64("id", F.lit("cells")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    got = rows.select("vec").toArrow().column(0)
    if len(got) == 0:
        return np.zeros((0, 0))
    return spherical_kmeans(unit_rows(got), int(min(most, max(1, n // cell))))


def visits(vectors: DataFrame, centroids: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """(cell, own, id, n, vec): every vector in its own cell, and as a visitor in each cell whose border is in reach. ``vectors``: id, vec, n.

    Tasks are sent the centroids alone; distances between them, their number squared, are worked out where they are needed.
    """
    reach = float(np.sqrt(2 - 2 * threshold)) + SLACK

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                part = b.slice(s, 2048)
                cos = unit_rows(part.column(1)) @ centroids.T
                own = cos.argmax(axis=1)
                used, at = np.unique(own, return_inverse=True)
                gap = np.sqrt(np.maximum(2 - 2 * (centroids[used] @ centroids.T), 1e-300))
                near = (cos[np.arange(len(own)), own][:, None] - cos) <= gap[at] * reach
                row, cell = np.nonzero(near)
                # a pair in two cells meets in the cell with the smaller number only
                use = cell <= own[row]
                row, cell = row[use], cell[use]
                to = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(own[row] == cell), part.column(0).take(to), part.column(2).take(to), part.column(1).take(to)],
                                                 names=["cell", "own", "id", "n", "vec"])

    return vectors.select("id", "vec", "n").mapInArrow(assign, f"cell bigint, own boolean, id bigint, n bigint, vec {dict(vectors.dtypes)['vec']}")


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node of its component) of a block's links; ``linked``: left x right."""
    i, j = np.nonzero(linked)
    ids, at = np.unique(np.concatenate((left[i], right[j])), return_inverse=True)
    a, b = at[:len(i)], at[len(i):]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return ids[label != np.arange(len(ids))], ids[label[label != np.arange(len(ids))]]
        label = new


def compare(rows: DataFrame, threshold: float, block: int) -> DataFrame:
    """Block products of (cell, own, id, n, vec): rows (id, n) of link counts and (id, root) of forests."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.sum(F.col("own").cast("int")) / F.lit(block)).cast("int").alias("mo"),
                                     F.ceil(F.sum((~F.col("own")).cast("int")) / F.lit(block)).cast("int").alias("mv"))
    # a row per cell, MOST_CELLS at most: it goes to the vectors
    r = rows.join(F.broadcast(sizes), "cell").withColumn("i", F.pmod(F.xxhash64("id", F.lit("block")), F.greatest(F.when(F.col("own"), F.col("mo")).otherwise(F.col("mv")), F.lit(1))).cast("int"))
    pair = lambda a, b, left, visits: F.struct(a.cast("int").alias("l"), b.cast("int").alias("r"), F.lit(visits).alias("v"), F.lit(left).alias("left"))
    all_of = lambda n, fn: F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), fn)
    i = F.col("i")
    own = F.concat(all_of(F.col("mo"), lambda j: F.when(j < i, pair(j, i, False, False)).otherwise(pair(i, j, True, False))), all_of(F.col("mv"), lambda j: pair(i, j, True, True)))
    r = r.withColumn("p", F.explode(F.when(F.col("own"), own).otherwise(all_of(F.col("mo"), lambda j: pair(j, i, False, True))))).select("cell", "p.*", "id", "n", "vec")

    def product(batch: pa.Table) -> pa.Table:
        first = batch.column("left").to_numpy(zero_copy_only=False)
        ids, n = batch.column("id").to_numpy(), batch.column("n").to_numpy()
        x = unit_rows(batch.column("vec"))
        same = not batch.column("v")[0].as_py() and batch.column("l")[0].as_py() == batch.column("r")[0].as_py()
        a = np.flatnonzero(first)
        b = a if same else np.flatnonzero(~first)
        out_id, out_n, out_root = [], [], []
        for s in range(0, len(a), block):
            for t in range(0, len(b), block):
                p, q = a[s:s + block], b[t:t + block]
                linked = x[p] @ x[q].T >= threshold
                if same:
                    linked &= ids[p][:, None] != ids[q][None, :]
                if not linked.any():
                    continue
                to_p = linked @ n[q]
                u, v = forest(linked, ids[p], ids[q])
                keep = to_p > 0
                out_id += [ids[p][keep], u]
                out_n += [to_p[keep], np.zeros(len(u), np.int64)]
                out_root += [ids[p][keep], v]
                if not same:
                    to_q = n[p] @ linked
                    keep = to_q > 0
                    out_id.append(ids[q][keep])
                    out_n.append(to_q[keep])
                    out_root.append(ids[q][keep])
        join = lambda xs: pa.array(np.concatenate(xs).astype(np.int64) if xs else np.zeros(0, np.int64))
        return pa.table({"id": join(out_id), "n": join(out_n), "root": join(out_root)})

    return r.groupBy("cell", "l", "r", "v").applyInArrow(product, "id bigint, n bigint, root bigint")


def near_dups(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vec).alias("vec"))
    rows = cut(rows.withColumn("ok", usable(F.col("vec")) & F.col("id").isNotNull()).withColumn("h", F.xxhash64("vec")))
    ok = rows.where("ok")
    classes = cut(ok.groupBy("h", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    found = None
    for length, n in sorted((r[0], r[1]) for r in classes.groupBy(F.size("vec")).agg(F.count(F.lit(1))).collect()):
        v = classes.where(F.size("vec") == length).select(F.col("rep").alias("id"), "vec", "n")
        part = compare(visits(v, fit(v.select("id", "vec"), n), threshold), threshold, block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found)
    links = found.groupBy("id").agg(F.sum("n").alias("others"))
    groups = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    facts = (classes.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
             .select("h", F.col("vec").alias("v2"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    good = ok.alias("a").join(facts.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("a.vec") == F.col("b.v2"))).select("id", "n_links", "component_id")
    rest = rows.where("not ok").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(rest).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


ORACLE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a) SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(m, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(m, v.vec_id)) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) c ON c.a = v.vec_id LEFT JOIN r ON r.a = v.vec_id
"""
