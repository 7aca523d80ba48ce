"""The call tree with repetition folded: runs, loops, and what happened between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ordered import median_picks, order_stats, running

MIN_RUN = 3
UNIT_LENGTHS = range(2, 9)
STRAYS = 2
#: places between calls of one function that follow each other in a fold, at most
REACH = UNIT_LENGTHS[-1] + STRAYS

LIST = ["trace_id", "list_id", "task_key"]


def siblings(st: DataFrame) -> DataFrame:
    """Sibling lists without interrupt roots: list_id is the parent, -1 for a task's roots."""
    s = st.where(~F.col("irq_root")) if "irq_root" in st.columns else st
    s = s.withColumn("list_id", F.coalesce("parent_id", F.lit(-1)))
    return s.select(*LIST, "span_id", "func", "start_us", "dur_us", "ord", F.shiftright("ord", 16).alias("chunk"))


def same_func_steps(st: DataFrame) -> DataFrame:
    """Previous and next call of the same function in time."""
    from .ordered import with_value_chunk

    s = cut(with_value_chunk(st.select("trace_id", "func", "span_id", "start_us"), ["trace_id"], "start_us"))
    return running(s, ["trace_id", "func"], "chunk", ["start_us", "span_id"],
                   [("prev_id", "prev", "span_id"), ("next_id", "next", "span_id")]).drop("chunk")


def runs(sib: DataFrame) -> DataFrame:
    """Siblings with the run of equal functions they belong to (run_id) and their position (idx) in the list."""
    s = sib.withColumn("_one", F.lit(1).cast("bigint"))
    s = running(s, LIST, "chunk", ["ord"], [("_pf", "prev", "func"), ("idx", "sum", "_one"), ("list_len", "total", "_one")])
    s = cut(s.withColumn("_new", F.when(F.col("_pf").eqNullSafe(F.col("func")), 0).otherwise(1)))
    s = running(s, LIST, "chunk", ["ord"], [("_r", "sum", "_new")])
    return s.withColumn("run_id", F.col("_r") + F.col("_new")).drop("_one", "_pf", "_new", "_r")


def run_folds(r: DataFrame) -> DataFrame:
    """From ``runs``: folds of three or more consecutive calls to one function, with total, upper median and max."""
    key = [*LIST, "run_id"]
    g = r.groupBy(*key).agg(
        F.first("func").alias("func"), F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("dur_us"), F.lit(0.0)).alias("total_us"),
        F.max("dur_us").alias("max_us"), F.min("start_us").alias("start_us"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"),
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")).where(F.col("calls") >= MIN_RUN)
    members = r.join(g.select(*key), key, "left_semi")
    med = order_stats(members, key, "dur_us", {"median_us": F.floor(F.col("n") / 2)}).drop("n")
    return g.join(med, key, "left")


def pieces(r: DataFrame) -> DataFrame:
    """From ``runs``: the calls a fold could hold or step over, with the ``piece`` of the list they are scanned in.

    Inside a fold, calls of one function are at most ``REACH`` places apart. A call that is not one of three such calls in a row
    belongs to no fold, and folds step over two of these at most: where three follow each other no fold can cross,
    and the scan of the whole list would stand there. Pieces are what lies between; they share no fold.
    """
    s = r.where(F.col("list_len") >= MIN_RUN).select(*LIST, "func", "chunk", "ord", "idx")
    s = cut(running(s, [*LIST, "func"], "chunk", ["ord"], [("_p", "prev", "idx"), ("_n", "next", "idx")]))
    near = lambda c: F.coalesce(F.abs(F.col("idx") - F.col(c)) <= REACH, F.lit(False)).cast("int")
    s = cut(s.withColumns({"_p": near("_p"), "_n": near("_n")}))
    s = running(s, [*LIST, "func"], "chunk", ["ord"], [("_pp", "prev", "_p"), ("_nn", "next", "_n")])
    often = (F.col("_p") + F.col("_n") == 2) | (F.col("_p") + F.coalesce("_pp", F.lit(0)) == 2) | (F.col("_n") + F.coalesce("_nn", F.lit(0)) == 2)
    s = cut(s.withColumn("_at", F.when(often, F.col("idx"))).drop("_p", "_n", "_pp", "_nn"))
    s = running(s, LIST, "chunk", ["ord"], [("_last", "maxb", "_at")])
    first = F.col("_at").isNotNull() & (F.col("_last").isNull() | (F.col("idx") - F.col("_last") > STRAYS + 1))
    s = cut(s.where(F.col("_at").isNotNull() | (F.col("idx") - F.col("_last") <= STRAYS)).withColumn("_first", F.when(first, F.col("idx"))))
    return running(s, LIST, "chunk", ["ord"], [("piece", "max", "_first")]).drop("_at", "_last", "_first", "chunk")


def folds(r: DataFrame) -> DataFrame:
    """From ``runs``: members of every fold of a sibling list, each call in one fold at most.

    One scan from the left: at each call a run of three or more equal functions is
    a fold of kind ``group`` (unit_len 1); otherwise the unit of 2 to 8 calls that repeats at least three times with most
    members is one of kind ``loop``, where one or two stray calls between repetitions are stepped over and stay single. What follows a
    choice depends on where it ends, so ``pieces`` are scanned one by one, as function names alone; their members join the calls by place.
    """
    p = pieces(r).select(*LIST, "piece", "idx", "func").repartition(*LIST, "piece").sortWithinPartitions(*LIST, "piece", "idx")
    found = p.mapInArrow(_fold_pieces, "trace_id string, list_id bigint, task_key string, kind string, fold_id bigint, unit_len int, reps int, pos int, rep int, idx bigint")
    return r.select(*LIST, "idx", "span_id", "func", "dur_us", "start_us", "ord").join(found, [*LIST, "idx"]).select(*_FOLD_COLUMNS)


def loop_folds(r: DataFrame) -> DataFrame:
    """From ``runs``: members of loops alone."""
    return folds(r).where(F.col("kind") == "loop").drop("kind")


#: members of a batch that a scan gives
_MEMBERS = 1 << 14
_FOUND = {"trace_id": pa.string(), "list_id": pa.int64(), "task_key": pa.string(), "kind": pa.string(), "fold_id": pa.int64(), "unit_len": pa.int32(),
          "reps": pa.int32(), "pos": pa.int32(), "rep": pa.int32(), "idx": pa.int64()}
_FOLD_COLUMNS = ["trace_id", "list_id", "task_key", "kind", "fold_id", "unit_len", "reps", "pos", "rep", "span_id", "func", "dur_us", "start_us", "ord"]


def scan(names: list[int]) -> list[tuple[str, int, int, int, int, int, int]]:
    """Members of the folds of a list of functions: (kind, fold, unit length, repetitions, place in unit, repetition, place in list)."""
    n, rows, p = len(names), [], 0
    while p < n:
        q = p
        while q < n and names[q] == names[p]:
            q += 1
        if q - p >= MIN_RUN:
            rows += [("group", p, 1, q - p, 0, k - p, k) for k in range(p, q)]
            p = q
            continue
        best = _best_loop(names, p)
        if best is None:
            p += 1
            continue
        unit, starts, end = best
        rows += [("loop", p, unit, len(starts), k, r, a + k) for r, a in enumerate(starts) for k in range(unit)]
        p = end
    return rows


def _sorted_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[int]]]:
    """(key, functions as numbers) of every piece; a piece may go on over several batches."""
    key, names, number = None, [], {}
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(c) for c in (*LIST, "piece")]
        # where a row differs from the row before in any key column, a piece begins
        new = np.zeros(b.num_rows, dtype=bool)
        for c in cols:
            codes = c.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        starts = [0, *np.flatnonzero(new).tolist()]
        keys = list(zip(*[c.take(pa.array(starts)).to_pylist() for c in cols]))
        words = b.column("func").dictionary_encode()
        codes = [number.setdefault(w, len(number)) for w in words.dictionary.to_pylist()]
        funcs = [-1 if i is None else codes[i] for i in words.indices.to_pylist()]
        for k, lo, hi in zip(keys, starts, [*starts[1:], b.num_rows]):
            if k != key:
                if names:
                    yield key, names
                key, names = k, []
            names += funcs[lo:hi]
    if names:
        yield key, names


def _fold_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds of the pieces of a partition, which come one after the other; a task holds one piece and a batch of members."""
    out = [[] for _ in _FOUND]

    def flush():
        full = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, _FOUND.values())], names=list(_FOUND))
        for c in out:
            c.clear()
        return full

    for (trace, lst, task, first), names in _sorted_pieces(batches):
        found = scan(names)
        for lo in range(0, len(found), _MEMBERS):
            part = found[lo:lo + _MEMBERS]
            for c, v in zip(out, (trace, lst, task)):
                c += [v] * len(part)
            kind, fold, unit, reps, pos, rep, idx = zip(*part)
            for c, v in zip(out[3:], (kind, [f + first for f in fold], unit, reps, pos, rep, [i + first for i in idx])):
                c += v
            if len(out[0]) >= _MEMBERS:
                yield flush()
    if out[0]:
        yield flush()


def _best_loop(names: list[int], p: int) -> tuple[int, list[int], int] | None:
    """(unit length, start of every repetition, end) of the loop at ``p`` with most members."""
    best = None
    for unit in UNIT_LENGTHS:
        if p + unit * MIN_RUN > len(names):
            break
        body, starts, q = names[p:p + unit], [p], p + unit
        while True:
            step = next((k for k in range(STRAYS + 1) if names[q + k:q + k + unit] == body), None)
            if step is None:
                break
            starts.append(q + step)
            q += step + unit
        if len(starts) >= MIN_RUN and (best is None or len(starts) * unit > len(best[1]) * best[0]):
            best = (unit, starts, q)
    return best


def loops(members: DataFrame) -> DataFrame:
    """One row per loop: unit, repetitions, total."""
    unit = F.transform(F.sort_array(F.collect_set(F.when(F.col("rep") == 0, F.struct("pos", "func")))), lambda x: x["func"])
    return members.groupBy(*LIST, "fold_id", "unit_len", "reps").agg(
        unit.alias("unit"), F.coalesce(F.sum("dur_us"), F.lit(0.0)).alias("total_us"), F.min("start_us").alias("start_us"),
        F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


def groups(members: DataFrame) -> DataFrame:
    """One row per run of one function: calls, total, upper median and max."""
    key = [*LIST, "fold_id"]
    g = members.groupBy(*key).agg(
        F.first("func").alias("func"), F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("dur_us"), F.lit(0.0)).alias("total_us"), F.max("dur_us").alias("max_us"),
        F.min("start_us").alias("start_us"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))
    return g.join(order_stats(members, key, "dur_us", {"median_us": F.floor(F.col("n") / 2)}).drop("n"), key, "left")


def loop_positions(members: DataFrame) -> DataFrame:
    """The k-th call of a loop's unit as a group of its own; median of the middle two."""
    key = [*LIST, "fold_id", "pos"]
    q = order_stats(members, key, "dur_us", median_picks())
    g = members.groupBy(*key, "func").agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("dur_us"), F.lit(0.0)).alias("total_us"),
                                          F.coalesce(F.max("dur_us"), F.lit(0.0)).alias("max_us"))
    return g.join(q.select(*key, ((F.col("mid_lo") + F.col("mid_hi")) / 2).alias("median_us")), key, "left")


def fold_outliers(st: DataFrame, outliers: DataFrame, members: DataFrame) -> DataFrame:
    """Members of folds that are or contain an outlier, slowest first (rank)."""
    o = st.join(outliers.select("trace_id", "span_id"), ["trace_id", "span_id"], "left_semi").select(
        "trace_id", F.explode("path").alias("span_id")).distinct()
    return members.join(o, ["trace_id", "span_id"], "left_semi")


def story(st: DataFrame, events: DataFrame | None = None, gaps: DataFrame | None = None) -> DataFrame:
    """Every sibling list folded, in time order: kind is span, group, loop, event or gap.

    Interrupts are taken out before folding and shown as single calls at their time.
    """
    m = cut(folds(cut(runs(siblings(st)))))
    g = groups(m.where(F.col("kind") == "group"))
    lp = loops(m.where(F.col("kind") == "loop"))
    folded = m.select("trace_id", "span_id")
    loose = st.withColumn("list_id", F.coalesce("parent_id", F.lit(-1))).join(folded, ["trace_id", "span_id"], "left_anti")
    nul = lambda t: F.lit(None).cast(t)
    items = (loose.select(*LIST, F.lit("span").alias("kind"), F.col("start_us").alias("t_us"), "ord", "span_id", "func",
                          F.lit(1).cast("bigint").alias("calls"), F.col("dur_us").alias("total_us"))
             .unionByName(g.select(*LIST, F.lit("group").alias("kind"), F.col("start_us").alias("t_us"), F.col("first_ord").alias("ord"),
                                   nul("bigint").alias("span_id"), "func", "calls", "total_us"))
             .unionByName(lp.select(*LIST, F.lit("loop").alias("kind"), F.col("start_us").alias("t_us"), F.col("first_ord").alias("ord"),
                                    nul("bigint").alias("span_id"), F.array_join("unit", ", ").alias("func"),
                                    (F.col("unit_len") * F.col("reps")).cast("bigint").alias("calls"), "total_us")))
    if events is not None:
        items = items.unionByName(events.select(
            "trace_id", F.coalesce("span_id", F.lit(-1)).alias("list_id"), "task_key", F.lit("event").alias("kind"), F.col("ts_us").alias("t_us"),
            F.col("event_id").alias("ord"), F.col("event_id").alias("span_id"), F.col("name").alias("func"), F.lit(1).cast("bigint").alias("calls"),
            nul("double").alias("total_us")))
    if gaps is not None:
        roots = st.where(F.col("parent_id").isNull()).select("trace_id", "task_key", "cpu").distinct()
        ends = st.groupBy("trace_id", "task_key").agg(F.min("start_us").alias("_a"), F.max(F.col("start_us") + F.coalesce("dur_us", F.lit(0.0))).alias("_z"))
        gg = gaps.join(roots, ["trace_id", "cpu"]).join(ends, ["trace_id", "task_key"]).where(F.col("ts_us").between(F.col("_a"), F.col("_z")))
        items = items.unionByName(gg.select(
            "trace_id", F.lit(-1).cast("bigint").alias("list_id"), "task_key", F.lit("gap").alias("kind"), F.col("ts_us").alias("t_us"),
            F.col("line_no").alias("ord"), nul("bigint").alias("span_id"), nul("string").alias("func"), F.col("lost").alias("calls"), nul("double").alias("total_us")))
    return items


def row_share(st: DataFrame) -> DataFrame:
    """Share of its parent's time per call."""
    p = st.select("trace_id", F.col("span_id").alias("parent_id"), F.col("dur_us").alias("_pd"))
    j = st.join(p, ["trace_id", "parent_id"])
    return j.where(F.col("_pd") > 0).select("trace_id", "span_id", F.least(F.lit(1.0), F.col("dur_us") / F.col("_pd")).alias("share"))


def fold_share(st: DataFrame, tracks: DataFrame, members: DataFrame) -> DataFrame:
    """Shares of rows in folds: (list, fold_id, kind, row, pos, span_id, share).

    A fold (row ``fold``) is measured against its parent's time, or its track's length in a list of roots; a place of a loop's unit
    (``position``) against the loop's total; a member (``member``) against the slowest of its group or place. ``members``: of ``folds``.
    """
    t = F.coalesce("dur_us", F.lit(0.0))
    p = st.select("trace_id", F.col("span_id").alias("list_id"), "task_key", F.col("dur_us").alias("_whole")).unionByName(
        tracks.select("trace_id", F.lit(-1).cast("bigint").alias("list_id"), "task_key", (F.col("t1_us") - F.col("t0_us")).alias("_whole")))
    key = [*LIST, "fold_id", "kind"]
    place = F.when(F.col("kind") == "loop", F.col("pos")).otherwise(-1)
    m = members.withColumns({"pos": place, "dur_us": t})
    by_pos = m.groupBy(*key, "pos").agg(F.sum("dur_us").alias("total"), F.max("dur_us").alias("_most"))
    by_fold = by_pos.groupBy(*key).agg(F.sum("total").alias("total"))
    no_id = F.lit(None).cast("bigint").alias("span_id")
    out = lambda df, row, pos, span, part, whole: df.where(F.col(whole) > 0).select(
        *key, F.lit(row).alias("row"), pos, span, F.least(F.lit(1.0), F.col(part) / F.col(whole)).alias("share"))
    no_pos = F.lit(None).cast("int").alias("pos")
    placed = F.when(F.col("pos") >= 0, F.col("pos")).alias("pos")
    return (out(by_fold.join(p, LIST), "fold", no_pos, no_id, "total", "_whole")
            .unionByName(out(by_pos.where("pos >= 0").join(by_fold.withColumnRenamed("total", "_whole"), key), "position", placed, no_id, "total", "_whole"))
            .unionByName(out(m.join(by_pos.drop("total"), [*key, "pos"]), "member", placed, "span_id", "dur_us", "_most")))
