"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X are never gathered: the driver holds matrices of a few columns of one vector's length, each product
is one pass over the rows. A step takes a block V_j of orthonormal directions, forms X V_j, takes off what lies in the
earlier left vectors U, makes the rest orthonormal (U_j), and forms X'U_j; what of that lies outside V is V_{j+1}. Both
sides are reorthogonalised against all earlier blocks. Left vectors are as long as the table and are not stored: a task
makes its rows of U = X W again from the small matrix W, so lost executors lose nothing. In this basis X is upper
block-bidiagonal (``BLOCK`` = 1 gives the classical bidiagonal form; blocks read the rows that many times less often), and
the SVD of that small matrix gives components and deviations. Steps end when the wanted triplets have converged or the
whole space is spanned; a closed space is left by a random direction orthogonal to it.

Vectors that are null, or hold null or non-finite entries, are dropped; so are vectors whose length is not the most
common one (the longer at a tie) and vectors with an entry beyond 2**40 after scaling. Directions without variance
(deviation below 1e-10 of the whole) are no components, so there may be fewer than ``k``; an empty table, a single vector
or equal vectors give no rows. Repeated rows count as often as they occur; extra columns are ignored by the query and
kept by ``whiten``, whose own columns replace those of the same name. Text does not occur; long vectors cost memory as
length x (k + a few blocks) in each task. ``deviation`` is exact; where it exceeds a long it is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import cut, put_back, set_aside

K = 32
BLOCK = 8
SCALE, OFFSET = 64.0, 1_000_000
LARGEST = float(1 << 40)
#: relative size below which a direction holds nothing, and residual at which a triplet has converged
RANK, CONVERGED = 1e-10, 1e-13
#: left vectors are orthonormal when their measured Gram matrix is this near to the identity
ORTHONORMAL = 1e-12


@dataclass
class Whitening:
    """n vectors with sums ``sums``; ``components`` are columns, ``eigenvalues`` their variances, ``trace`` the whole variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0


def entries(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all usable rows on end, their lengths, and which rows are usable."""
    length = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.cast(col.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * values)
    end = np.cumsum(length)
    bad = np.concatenate(([0], np.cumsum(~(np.abs(x) < LARGEST))))
    fine = (bad[end] == bad[end - length]) & ~np.asarray(col.is_null()) & (length > 0)
    return x[np.repeat(fine, length)].astype(np.int64) + OFFSET, length[fine], fine


def lattice(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Usable rows with their other columns, ``x`` (integers on the lattice) and ``dims``."""
    rest = [f for f in vectors.schema.fields if f.name != vector]
    schema = T.StructType([*rest, T.StructField("x", T.ArrayType(T.LongType())), T.StructField("dims", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, length, fine = entries(b.column(b.num_columns - 1))
            off = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
            keep = b.filter(pa.array(fine))
            yield pa.RecordBatch.from_arrays([*keep.columns[:-1], pa.ListArray.from_arrays(pa.array(off), pa.array(x)), pa.array(length)],
                                             names=[f.name for f in schema.fields])

    return vectors.select(*[F.col(f"`{f.name}`") for f in rest], F.col(f"`{vector}`")).mapInArrow(run, schema)


def matrix(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Centre:
    """Centring in integers: n * x - S is exact, and split so that it stays small."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.q, self.r = n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)

    def spread(self, x: np.ndarray) -> np.ndarray:
        """n * x - S; as Python integers where 64 bits may not do."""
        near = x - self.q
        if len(near) and (int(np.abs(near).max()) + 1) * self.n >= 1 << 62:
            return near.astype(object) * self.n - self.r
        return near * self.n - self.r

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.spread(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        y = self.spread(x)
        most = int(np.abs(y).max()) if y.size else 0
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return pa.array((y * y).sum(axis=1).astype(np.int64))
        full = (y.astype(object) ** 2).sum(axis=1)
        return pa.array([int(v) if v < 1 << 63 else None for v in full], pa.int64())


def exact_sums(rows: DataFrame, d: int) -> list[int]:
    """Exact sum per dimension; partitions send d numbers each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for b in batches:
            for s in range(0, b.num_rows, 1 << 16):
                total = [t + int(v) for t, v in zip(total, matrix(b.column(0).slice(s, 1 << 16), d).sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array([str(t) for t in total])], names=["at", "s"])

    got = rows.select("x").mapInArrow(run, "at bigint, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return [int(r["s"]) for r in sorted(got)]


def measured(rows: DataFrame, d: int, centre: Centre, shapes: list[tuple[int, int]], make: Callable[[np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
    """Sums over all centred rows of the matrices ``make`` gives per block of rows; tasks send one sum each."""
    sizes = [a * b for a, b in shapes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(sizes))
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                total += np.concatenate([m.ravel() for m in make(centre.rows(matrix(b.column(0).slice(s, 4096), d)))])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "v"])

    got = rows.select("x").mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(sum(sizes))
    flat[got.column("at").to_numpy()] = got.column("v").to_numpy()
    return [m.reshape(s) for m, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), shapes)]


def outside(new: np.ndarray, basis: np.ndarray, least: float) -> np.ndarray:
    """Orthonormal columns for what of ``new`` lies outside ``basis``; parts below ``least`` are nothing."""
    for _ in range(2):
        new = new - basis @ (basis.T @ new)
    q, s, _ = np.linalg.svd(new, full_matrices=False)
    q = q[:, s > least]
    q = q - basis @ (basis.T @ q)
    return np.linalg.qr(q)[0] if q.size else q


def left_block(rows: DataFrame, d: int, centre: Centre, right: np.ndarray, left: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """(W_j, X'U_j) with U_j = X W_j orthonormal, orthogonal to X ``left``, and spanning the rest of X ``right``.

    Every pass measures the products on the rows themselves; the next one starts from what is left, so rounding of one pass is mended by the next.
    """
    z = right
    while z.shape[1]:
        m, b = left.shape[1], z.shape[1]

        def products(x: np.ndarray, z: np.ndarray = z) -> list[np.ndarray]:
            y, u = x @ z, x @ left
            return [u.T @ y, y.T @ y, x.T @ y]

        p, g, h = measured(rows, d, centre, [(m, b), (b, b), (d, b)], products)
        if np.abs(p).max(initial=0.0) < ORTHONORMAL and np.abs(g - np.eye(b)).max() < ORTHONORMAL:
            return z, h
        rest = g - p.T @ p
        z = z - left @ p
        e, q = np.linalg.eigh((rest + rest.T) / 2)
        if e[0] <= 1e-4 * np.abs(np.diag(g)).max() and np.abs(p).max(initial=0.0) > 1e-8 * np.sqrt(np.abs(g).max()):
            continue  # what is left is small against what was taken off: measure it alone first
        keep = e > max((RANK * size) ** 2 if np.abs(g - np.eye(b)).max() > 0.5 else 0.0, 1e-14 * e[-1])
        z = (z @ q)[:, keep] / np.sqrt(e[keep])
    return z, np.zeros((d, 0))


def fit_rows(rows: DataFrame, n: int, d: int, k: int = K, block: int = BLOCK, seed: int = 11) -> Whitening:
    """Whitening of lattice rows (``x``, all of length d), read once per pass."""
    sums = exact_sums(rows, d)
    centre = Centre(n, sums)
    rng = np.random.default_rng(seed)
    [[[size2]]] = measured(rows, d, centre, [(1, 1)], lambda x: [np.array([[(x * x).sum()]])])
    size = float(np.sqrt(size2))
    right, left, upper = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((0, d))
    new = outside(rng.standard_normal((d, min(block, d))), right, 1e-8)
    while size > 0 and new.shape[1]:
        right = np.hstack((right, new))
        w, h = left_block(rows, d, centre, new, left, size)
        left, upper = np.hstack((left, w)), np.vstack((upper, h.T))
        if right.shape[1] == d:
            break
        new = outside(h, right, RANK * size)
        # residuals of the wanted triplets: what their left vectors still send outside the right basis
        p, s, _ = np.linalg.svd(upper @ right, full_matrices=False)
        miss = np.linalg.norm((upper - upper @ right @ right.T).T @ p[:, :k], axis=0)
        if new.shape[1] and len(s) > k and miss.max() <= CONVERGED * s[0]:
            break
        if not new.shape[1]:
            new = outside(rng.standard_normal((d, min(block, d - right.shape[1]))), right, 1e-8)
    # the small block-bidiagonal matrix U'XV
    _, s, qt = np.linalg.svd(upper @ right, full_matrices=False)
    real = s > RANK * size
    s, components = s[real][:k], (right @ qt.T)[:, real][:, :k]
    components = components * np.sign(components[np.abs(components).argmax(axis=0), np.arange(len(s))]) if len(s) else np.zeros((d, 0))
    model = Whitening(n, sums, components, s * s / n, size * size / n)
    if len(s):
        turn = components / np.sqrt(model.eigenvalues)
        [gram] = measured(rows, d, centre, [(len(s), len(s))], lambda x: [(x @ turn).T @ (x @ turn)])
        model.identity_error = float(np.abs(gram / n - np.eye(len(s))).max())
    return model


def usual(rows: DataFrame) -> tuple[int, int]:
    """Number and length of the vectors of the most common length."""
    got = rows.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    return (got["count"], got["dims"]) if got else (0, 0)


def fit(vectors: DataFrame, vector: str = "embedding", k: int = K, block: int = BLOCK) -> tuple[Whitening | None, DataFrame]:
    """The whitening of all usable vectors (None without any), and their rows with ``x`` in place of the vector."""
    rows = cut(lattice(vectors, vector))
    n, d = usual(rows)
    rows = rows.where(F.col("dims") == d).drop("dims")
    return (fit_rows(rows, n, d, k, block) if n else None), rows


def whiten(vectors: DataFrame, vector: str = "embedding", k: int = K, out: str = "whitened") -> DataFrame:
    """Usable rows with their columns and ``out``: the whitened vector, of up to ``k`` entries."""
    own, names = set_aside(vectors.drop(out) if out != vector else vectors)
    kept = own.withColumn("_v", F.col(names[vector]))
    model, rows = fit(kept, "_v", k)
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != "x"], T.StructField("_w", T.ArrayType(T.DoubleType()))])
    at = [f.name for f in schema.fields[:-1]]
    d = len(model.sums) if model else 0
    turn = model.components / np.sqrt(model.eigenvalues) if model else None
    centre = Centre(model.n, model.sums) if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = centre.rows(matrix(b.column(b.num_columns - 1), d)) @ turn
            off = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(off), pa.array(w.ravel()))], names=schema.names)

    got = rows.select(*at, "x").mapInArrow(run, schema) if model else rows.select(*at, F.lit(None).cast("array<double>").alias("_w"))
    return got.select(*[F.col(a).alias(c) for c, a in names.items() if c != out], F.col("_w").alias(out))


def whitening_query(vectors: DataFrame, k: int = K) -> DataFrame:
    """One row per usable vector and component, with the figures of the contract."""
    model, rows = fit(vectors.select("vec_id", "embedding"), "embedding", k)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d, m, centre = len(model.sums), len(model.eigenvalues), Centre(model.n, model.sums)
    turn, explained = model.components / np.sqrt(model.eigenvalues), model.eigenvalues / model.trace if m else model.eigenvalues

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                part = b.slice(s, 4096)
                x = matrix(part.column(1), d)
                row = pa.array(np.repeat(np.arange(len(x)), m))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(row), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.full(len(row), model.n)),
                     centre.deviation(x).take(row), pa.array((centre.rows(x) @ turn).ravel()), pa.array(np.tile(explained, len(x))),
                     pa.array(np.full(len(row), model.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, schema)
