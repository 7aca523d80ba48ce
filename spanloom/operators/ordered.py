"""Ordered operators that never put one whole group into one task.

A window over (trace, task) or (trace, func) would send a hot task or a hot
function to a single executor. Every ordered job here therefore works in two
levels: rows are cut into chunks of bounded size, the window runs inside
(key, chunk), and one summary row per (key, chunk) carries the state from the
chunks before (or after). A key that lies in one chunk needs none, so the summary that
goes back to the rows is about ``rows / CHUNK_ROWS`` rows long, however many keys there are.
Every frame starts at the edge of its partition, so each kind costs one sort and one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BITS = 16
CHUNK_ROWS = 1 << CHUNK_BITS


def line_chunk(col: str = "line_no", bits: int = CHUNK_BITS) -> Column:
    """Chunk of a row by its line number: at most 2**bits rows per trace."""
    return F.shiftright(F.col(col), bits)


def with_value_chunk(df: DataFrame, by: list[str], col: str, rows: int = CHUNK_ROWS,
                     out: str = "chunk") -> DataFrame:
    """Add an order-preserving chunk of ``col`` of about ``rows`` rows per ``by`` group.

    Two levels of equal width, each from one combinable aggregate: first over the whole range of the group,
    then again over the actual range of every chunk that came out too full. A far value or a burst that
    takes up one chunk of the first level is cut by the second.
    """
    wide = _level(df, by, col, rows, "_c1")
    return (_level(wide, [*by, "_c1"], col, rows, "_c2")
            .withColumn(out, F.col("_c1") * F.lit(1 << 31) + F.least(F.col("_c2"), F.lit((1 << 31) - 1))).drop("_c1", "_c2"))


def _level(df: DataFrame, by: list[str], col: str, rows: int, out: str) -> DataFrame:
    stat = df.groupBy(*by).agg(
        F.min(col).cast("double").alias("_lo"), F.max(col).cast("double").alias("_hi"),
        F.count(F.lit(1)).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) * rows / F.col("_n")
    cell = F.when(width > 0, F.floor((F.col(col) - F.col("_lo")) / width))
    keys = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]
    # only groups over ``rows`` are cut: at most one for that many rows of the table, so these go to the rows and not the rows to them
    both = df.alias("l").join(F.broadcast(stat.where(F.col("_n") > rows)).alias("r"), reduce(lambda x, y: x & y, keys), "left")
    return both.select("l.*", F.coalesce(cell, F.lit(0)).cast("bigint").alias(out))


def running(df: DataFrame, keys: list[str], chunk: str, order: list[str],
            specs: list[tuple[str, str, str]]) -> DataFrame:
    """Prefix state per row over ``keys`` ordered by ``order`` (whose first part is monotone in ``chunk``).

    ``specs`` lists (output, kind, input column):
      sum   total of strictly earlier rows (0 when there are none)
      max   largest value of this row and earlier ones
      maxb  largest value of strictly earlier rows
      total total of all rows of the key
      prev  last non-NULL value of strictly earlier rows
      next  first non-NULL value of strictly later rows

    ``df`` is read twice (rows and chunk summaries): give a table or a narrow
    projection of one; ``session.cut`` turns anything longer into a table.
    """
    inner = Window.partitionBy(*keys, chunk).orderBy(*order)
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    # what follows is what precedes in descending order: a frame that only grows, so one pass does
    after = Window.partitionBy(*keys, chunk).orderBy(*[F.col(o).desc() for o in order]).rowsBetween(Window.unboundedPreceding, -1)
    pos = F.struct(*order) if len(order) > 1 else F.col(order[0])

    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    local, summ, carry = {}, [], []
    outer = Window.partitionBy(*keys).orderBy(chunk)
    o_before = outer.rowsBetween(Window.unboundedPreceding, -1)
    o_after = Window.partitionBy(*keys).orderBy(F.col(chunk).desc()).rowsBetween(Window.unboundedPreceding, -1)
    for i, (out, kind, c) in enumerate(specs):
        s = f"_s{i}"
        if kind == "sum":
            local[out] = F.coalesce(F.sum(c).over(before), F.lit(0))
            summ.append(F.sum(c).alias(s))
            carry.append(F.coalesce(F.sum(s).over(o_before), F.lit(0)).alias(f"_c{i}"))
        elif kind in ("max", "maxb"):
            local[out] = F.max(c).over(upto if kind == "max" else before)
            summ.append(F.max(c).alias(s))
            carry.append(F.max(s).over(o_before).alias(f"_c{i}"))
        elif kind == "total":
            local[out] = F.when(known, F.sum(c).over(Window.partitionBy(*keys, chunk)))
            summ.append(F.sum(c).alias(s))
            carry.append(F.sum(s).over(Window.partitionBy(*keys)).alias(f"_c{i}"))
        elif kind == "prev":
            local[out] = F.last(c, ignorenulls=True).over(before)
            summ.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), pos)).alias(s))
            carry.append(F.last(s, ignorenulls=True).over(o_before).alias(f"_c{i}"))
        elif kind == "next":
            local[out] = F.last(c, ignorenulls=True).over(after)
            summ.append(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), pos)).alias(s))
            carry.append(F.last(s, ignorenulls=True).over(o_after).alias(f"_c{i}"))
        else:
            raise ValueError(kind)

    # a key in one chunk has nothing to carry: only the others meet the rows again
    ends = df.groupBy(*keys, chunk).agg(*summ).select(*keys, chunk, *carry, F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_chunks")).where("_chunks > 1").drop("_chunks")
    res = df.withColumns(local).join(ends, [*keys, chunk], "left")
    done = {}
    for i, (out, kind, _c) in enumerate(specs):
        c = F.col(f"_c{i}")
        if kind == "sum":
            done[out] = F.col(out) + F.coalesce(c, F.lit(0))
        elif kind == "total":
            done[out] = F.coalesce(c, F.col(out))
        elif kind in ("max", "maxb"):
            done[out] = F.greatest(F.col(out), c)
        else:
            done[out] = F.coalesce(F.col(out), c)
    return res.withColumns(done).drop(*[f"_c{i}" for i in range(len(specs))])


def beside(df: DataFrame, keys: list[str], chunk: str, at: str, specs: list[tuple[str, str, Column]], chunks: bool) -> DataFrame:
    """What the rows next to a row of the same key tell; ``at`` orders the rows and is monotone in ``chunk``.

    ``specs`` lists (output, kind, struct): ``prev`` and ``next`` are of the row directly before and after, ``last`` is the last non-NULL
    one of strictly earlier rows. Nothing is copied into the rows and one ascending sort answers all. ``chunks``: whether a key may
    lie in more than one chunk; ``df`` is then read twice, as by ``running``.
    """
    w = Window.partitionBy(*keys, chunk).orderBy(at)
    frame = w.rowsBetween(Window.unboundedPreceding, -1)
    local = {"prev": lambda c: F.lag(c).over(w), "next": lambda c: F.lead(c).over(w), "last": lambda c: F.last(c, ignorenulls=True).over(frame)}
    res = df.withColumns({out: local[kind](c) for out, kind, c in specs})
    if not chunks:
        return res
    edge = {"prev": lambda c: F.max_by(c, at), "next": lambda c: F.min_by(c, at), "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(at)))}
    outer = Window.partitionBy(*keys).orderBy(chunk)
    carry = {"prev": lambda c: F.lag(c).over(outer), "next": lambda c: F.lead(c).over(outer),
             "last": lambda c: F.last(c, ignorenulls=True).over(outer.rowsBetween(Window.unboundedPreceding, -1))}
    ends = df.groupBy(*keys, chunk).agg(*[edge[kind](c).alias(f"_s{i}") for i, (_, kind, c) in enumerate(specs)])
    ends = ends.select(*keys, chunk, *[carry[kind](F.col(f"_s{i}")).alias(f"_c{i}") for i, (_, kind, _c) in enumerate(specs)])
    res = res.join(ends, [*keys, chunk], "left")
    return res.withColumns({out: F.coalesce(F.col(out), F.col(f"_c{i}")) for i, (out, _, _c) in enumerate(specs)}).drop(*[f"_c{i}" for i in range(len(specs))])


# ---- points in intervals ----------------------------------------------------

def stab(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, lo: str, hi: str) -> DataFrame:
    """Pairs of a point and an interval that holds it (ends included), with the columns of both.

    An interval lies on slots as wide as its own length rounded up to a power of two, so on two at most; a point
    looks at one slot of every width in use for its key. One long interval widens no other's slots.
    """
    wide = F.greatest(F.ceil(F.log2(F.greatest(F.col(hi) - F.col(lo), F.lit(1.0)))), F.lit(0)).cast("int")
    slot = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("_lv"))).cast("bigint")
    iv = intervals.where(F.col(hi) >= F.col(lo)).withColumn("_lv", wide)
    used = iv.groupBy(*keys).agg(F.array_distinct(F.collect_set("_lv")).alias("_lvs"))
    iv = iv.withColumn("_slot", F.explode(F.array_distinct(F.array(slot(F.col(lo)), slot(F.col(hi))))))
    pt = points.join(used, keys).withColumn("_lv", F.explode("_lvs")).drop("_lvs")
    pt = pt.withColumn("_slot", slot(F.col(at)))
    return pt.join(iv, [*keys, "_lv", "_slot"]).where(F.col(at).between(F.col(lo), F.col(hi))).drop("_lv", "_slot")


# ---- exact order statistics -------------------------------------------------

def value_bucket(v: Column, steps: int = 256) -> Column:
    """Monotone bucket of a value: 1/steps of an octave, everything <= 0 in the lowest one."""
    return F.when(v > 0, F.floor(F.log2(v) * steps).cast("int")).otherwise(F.lit(-(1 << 30)))


def order_stats(df: DataFrame, keys: list[str], value: str, picks: dict[str, Column], ids: dict[str, tuple[Column, str]] | None = None) -> DataFrame:
    """Exact order statistics per key: one row per key with a column for every pick.

    ``picks`` maps an output name to a 0-based index expression over column ``n``
    (the number of values of the key). Equal values are counted first (combinable); the ordering then runs
    inside fine log buckets, so a hot key is spread over many tasks.
    ``ids`` maps an output name to an index and a column: the least of that column among the rows with the value at that index.
    """
    ids = {name: (idx.cast("bigint"), col) for name, (idx, col) in (ids or {}).items()}
    least = {col: f"_id{i}" for i, col in enumerate(dict.fromkeys(col for _, col in ids.values()))}
    v = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
         .agg(F.count(F.lit(1)).alias("_k"), *[F.min(col).alias(out) for col, out in least.items()]).withColumn("_b", value_bucket(F.col("_v"))))
    v = running(v, keys, "_b", ["_v"], [("_before", "sum", "_k"), ("n", "total", "_k")])
    at = {name: idx.cast("bigint") for name, idx in picks.items()}
    here = lambda idx: (idx >= F.col("_before")) & (idx < F.col("_before") + F.col("_k"))
    wanted = [*at.values(), *[idx for idx, _ in ids.values()]]
    hit = v.where(F.lit(False) if not wanted else _any([here(i) for i in wanted]))
    return hit.groupBy(*keys).agg(F.first("n").alias("n"), *[F.max(F.when(here(i), F.col("_v"))).alias(name) for name, i in at.items()],
                                  *[F.max(F.when(here(i), F.col(least[col]))).alias(name) for name, (i, col) in ids.items()])


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def median_picks() -> dict[str, Column]:
    """Indexes of the two middle values (equal for an odd count)."""
    n = F.col("n")
    return {"mid_lo": F.floor((n - 1) / 2), "mid_hi": F.floor(n / 2)}


def floor_rank(q: float) -> Column:
    """Index min(n - 1, floor(q * n)): the non-interpolated quantile."""
    return F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(q)))


def rank_below(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """One row per (keys, distinct value): how many rows of the key are strictly smaller, and n.

    Equal values are counted before anything is ordered, and the ordering runs
    inside log buckets, so a hot key is spread over many tasks.
    """
    per = (df.where(F.col(value).isNotNull()).groupBy(*keys, value)
           .agg(F.count(F.lit(1)).alias("_k")).withColumn("_b", value_bucket(F.col(value))))
    return running(per, keys, "_b", [value], [(out, "sum", "_k"), ("n", "total", "_k")]).drop("_k", "_b")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def top_rows(df: DataFrame, keys: list[str], order: list, k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per key; the rank filter is pushed below the shuffle by Spark's window group limit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)
