"""Tokens to call trees: task attribution, matching, nesting, interrupt runs, clock.

Everything is column expressions over bounded windows (``ordered.running``) and
equi-joins on (trace_id, line). Loops run over *levels that still change*, never
over rows; each round ends in a written table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..session import cut
from .contract import tree_values
from .ordered import beside, line_chunk, running, union_all
from .waits import mixed_traces, placed, stretches

# --- fixed values: interrupt names the parser marks --------------------------
IRQ_NAMES = [
    "common_interrupt", "asm_common_interrupt", "__common_interrupt", "handle_irq_event", "irq_enter_rcu",
    "irq_exit_rcu", "__irq_exit_rcu", "irq_exit", "handle_softirqs", "__do_softirq", "do_softirq",
    "raw_irqentry_exit_cond_resched", "irqentry_exit_cond_resched", "dynamic_irqentry_exit_cond_resched",
    "irqentry_enter", "irqentry_exit",
]
IRQ_PREFIXES = "^(?:sysvec_|__sysvec_|asm_sysvec_)"

EPS = 1e-6

#: what a line tells about calls, events, switches and gaps
LINE = ["trace_id", "line_no", "kind", "abs_us", "cpu", "pid", "dur_us", "indent", "func", "caller", "has_args", "ret_text", "ret", "event_name", "payload",
        "lost", "irq_mark", "prev_pid", "next_pid", "byte_start", "byte_end"]


@dataclass
class Trace:
    """The tables of one or many traces."""

    spans: DataFrame
    events: DataFrame
    switches: DataFrame
    gaps: DataFrame
    tracks: DataFrame
    tasks: DataFrame
    meta: DataFrame


def task_key(pid: Column, cpu: Column) -> Column:
    """A task is its pid; the idle task (pid 0) exists once per CPU."""
    return F.when(pid == 0, F.concat(F.lit("0/"), cpu.cast("string"))).otherwise(pid.cast("string"))


def attribute(tokens: DataFrame, keep=lambda df: df) -> DataFrame:
    """Give every call, event and gap its task; carry interrupt markers; find the next call per CPU.

    A line that names no task belongs to the task last switched to on its CPU;
    before the first switch, to the task that switch leaves. A CPU all of whose lines are calls that name their task needs no
    neighbours: its lines stay where they are (``next_call`` is for other lines, and null there). ``keep`` is given the rest.
    """
    t = tokens.where(F.col("kind").isin("open", "leaf", "close", "fn", "event", "marker", "banner", "lost"))
    cpu = F.coalesce("cpu", F.lit(-1))
    t = t.withColumns({"cpu0": cpu, "chunk": line_chunk(), "_own": task_key(F.col("pid"), cpu)})
    asks = (~F.col("kind").isin("open", "leaf", "close", "fn") | F.col("_own").isNull() | F.col("prev_pid").isNotNull() | F.col("next_pid").isNotNull()
            | F.col("irq_mark").isNotNull())
    lanes = cut(t.groupBy("trace_id", "cpu0").agg(F.bool_or(asks).alias("asks")).coalesce(1))
    plain = t.withColumns({"next_call": F.lit(None).cast("bigint"), "task_key": F.col("_own"), "irq_on": F.lit(False)}).drop("_own")
    if lanes.where("asks").isEmpty():
        return plain
    if lanes.where("not asks").isEmpty():
        return keep(_from_neighbours(t))
    lane = lambda cond: lanes.where(cond).select("trace_id", "cpu0")
    return keep(_from_neighbours(t.join(lane("asks"), ["trace_id", "cpu0"], "left_semi"))).unionByName(plain.join(lane("not asks"), ["trace_id", "cpu0"], "left_semi"))


def _from_neighbours(t: DataFrame) -> DataFrame:
    cpu = F.col("cpu0")
    t = t.withColumns({
        "_set": F.coalesce(task_key(F.col("next_pid"), cpu), "_own"),
        "_claim": F.coalesce(task_key(F.col("prev_pid"), cpu), "_own"),
        "_call": F.when(F.col("kind").isin("open", "leaf", "close", "fn"), F.col("line_no")),
    })
    t = running(t, ["trace_id", "cpu0"], "chunk", ["line_no"], [
        ("_before", "prev", "_set"), ("_later", "next", "_claim"), ("_mark", "prev", "irq_mark"),
        ("next_call", "next", "_call")])
    return t.withColumns({
        "task_key": F.coalesce("_own", "_before", "_later", F.concat(F.lit("?/"), F.col("cpu0").cast("string"))),
        "irq_on": F.coalesce("_mark", F.lit(False)),
    }).drop("_own", "_set", "_claim", "_before", "_later", "_mark", "_call")


def clock_rows(rows: DataFrame) -> DataFrame:
    """Start of every row under the absolute clock, in µs after the trace's first stamp.

    Stamps are whole microseconds and durations have nanoseconds: a row starts at
    its stamp, or later when leaf calls before it in the same task fill the time,
    i.e. max over earlier rows j of (stamp_j + leaf time between j and this row).
    Rows of traces without any stamp have no such start and stay where they are.
    """
    t0 = cut(rows.where(F.col("abs_us").isNotNull()).groupBy("trace_id").agg(F.min_by("abs_us", "line_no").alias("t0_us")).coalesce(1))
    none = {"t0_us": F.lit(None).cast("double"), "at_us": F.lit(None).cast("double")}
    if t0.isEmpty():
        return rows.withColumns(none)
    r = cut(rows.join(t0, "trace_id").withColumn("_w", F.when(F.col("kind") == "leaf", F.col("dur_us"))))
    r = running(r, ["trace_id", "task_key"], "chunk", ["line_no"], [("_pre", "sum", "_w")])
    r = cut(r.withColumn("_lead", F.col("abs_us") - F.col("t0_us") - F.col("_pre")))
    r = running(r, ["trace_id", "task_key"], "chunk", ["line_no"], [("_shift", "max", "_lead")])
    r = cut(r.withColumn("at_us", F.round(F.col("_pre") + F.col("_shift"), 6)).drop("_w", "_pre", "_lead", "_shift"))
    return r.unionByName(rows.join(t0, "trace_id", "left_anti").withColumns(none))


def match_calls(rows: DataFrame) -> DataFrame:
    """Match opens with closes and find the enclosing call of every row.

    Each row is copied as a *boundary* into the deeper levels its neighbours reach
    (linear in total). Inside (trace, task, level) a close matches the open directly
    before it; the last boundary is the row that encloses a call, the next boundary
    the one that ends its stretch. A task whose lines lie in one chunk needs one shuffle for both steps.
    ``deeper``: the line before it in its task was deeper; only such a row can end a stretch.
    """
    task = ["trace_id", "task_key"]
    many = cut(rows.groupBy(*task).agg(F.min("chunk").alias("_lo"), F.max("chunk").alias("_hi")).where("_lo < _hi").select(*task))
    if many.isEmpty():
        return _match(rows, lambda df: df, False)
    return _match(rows.join(many, task, "left_anti"), lambda df: df, False).unionByName(_match(rows.join(many, task, "left_semi"), cut, True))


def _levels(r: DataFrame) -> DataFrame:
    d = F.col("indent")
    deep = F.greatest(d, F.col("_p.indent"), F.col("_q.indent"))
    levels = F.when(deep > d, F.sequence(d, deep)).otherwise(F.array(d))
    r = r.withColumns({"deeper": F.coalesce(F.col("_p.indent") > d, F.lit(False)), "level": levels}).drop("_p", "_q")
    return r.withColumn("level", F.explode("level")).withColumn("me", F.col("level") == d)


def _match(rows: DataFrame, keep, chunks: bool) -> DataFrame:
    x = keep(_levels(beside(keep(rows), ["trace_id", "task_key"], "chunk", "line_no", [
        ("_p", "prev", F.struct("indent")), ("_q", "next", F.struct("indent"))], chunks)))
    x = beside(x, ["trace_id", "task_key", "level"], "chunk", "line_no", [
        ("before", "prev", F.struct("kind", "me")),
        ("after", "next", F.struct("me", "line_no", "kind", "dur_us", "at_us", "func", "ret_text", "ret", "byte_end")),
        ("up", "last", F.when(~F.col("me"), F.struct("line_no", "kind", "indent")))], chunks)
    x = x.where("me")
    closed = (F.col("kind") == "open") & F.coalesce(F.col("after.me") & (F.col("after.kind") == "close"), F.lit(False))
    matched = (F.col("kind") == "close") & F.coalesce(F.col("before.me") & (F.col("before.kind") == "open"), F.lit(False))
    return x.withColumns({"closed": closed, "matched": matched, "close": F.when(closed, F.col("after")),
                          "end_line": F.when(F.col("kind") == "open", F.col("after.line_no"))}).drop("before", "after", "level", "me")


def stretch_ends(rows: DataFrame) -> DataFrame:
    """(trace_id, span_id, down_line): for call lines, the next boundary at their level."""
    r = rows.select("trace_id", "task_key", "chunk", "line_no", "indent")
    x = _levels(beside(cut(r), ["trace_id", "task_key"], "chunk", "line_no", [("_p", "prev", F.struct("indent")), ("_q", "next", F.struct("indent"))], True))
    x = cut(x.withColumn("_edge", F.when(~F.col("me"), F.col("line_no"))))
    x = running(x, ["trace_id", "task_key", "level"], "chunk", ["line_no"], [("down_line", "next", "_edge")])
    return x.where("me").select("trace_id", F.col("line_no").alias("span_id"), "down_line")


def enclosing(rows: DataFrame) -> DataFrame:
    """Add ``top``, the open call a row lies in, and its indent. A row that follows a sibling (not an open)
    takes that sibling's enclosing call; regular traces need no extra round."""
    rows = cut(rows)
    links = rows.select("trace_id", "line_no", F.col("up.line_no").alias("up_line"), F.col("up.kind").alias("up_kind"))
    state = links
    while True:
        todo = state.where(F.col("up_kind") != "open")
        if todo.isEmpty():
            break
        hop = links.select("trace_id", F.col("line_no").alias("up_line"), F.col("up_line").alias("_l"),
                           F.col("up_kind").alias("_k"))
        moved = todo.join(hop, ["trace_id", "up_line"]).select("trace_id", "line_no", F.col("_l").alias("up_line"),
                                                               F.col("_k").alias("up_kind"))
        state = cut(state.where((F.col("up_kind") == "open") | F.col("up_kind").isNull()).unionByName(moved))
    if state is links:
        return rows.withColumns({"top": F.col("up.line_no"), "top_indent": F.col("up.indent")})
    tops = rows.where(F.col("kind") == "open").select("trace_id", F.col("line_no").alias("top"), F.col("indent").alias("top_indent"))
    rows = rows.join(state.select("trace_id", "line_no", F.col("up_line").alias("top")), ["trace_id", "line_no"])
    return cut(rows.join(tops, ["trace_id", "top"], "left"))


def _innermost(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """For events, gaps and flat calls: the call that is open at their line in their task (``span_id``)."""
    both = rows.select("trace_id", "task_key", "line_no", F.lit(None).cast("string").alias("_k")).unionByName(
        calls.select("trace_id", "task_key", "line_no", F.col("kind").alias("_k")))
    both = both.withColumns({"chunk": line_chunk(),
                             "_c": F.when(F.col("_k").isNotNull(), F.struct(F.col("line_no").alias("l"), F.col("_k").alias("k")))})
    at = running(both, ["trace_id", "task_key"], "chunk", ["line_no"], [("_prev", "prev", "_c")]).where(
        F.col("_k").isNull()).select("trace_id", "line_no", F.col("_prev.l").alias("_pl"), F.col("_prev.k").alias("_pk"))
    tops = calls.where(F.col("kind") != "open").select("trace_id", F.col("line_no").alias("_pl"), F.col("top").alias("_top"))
    at = at.join(tops, ["trace_id", "_pl"], "left")
    return at.select("trace_id", "line_no", F.when(F.col("_pk") == "open", F.col("_pl")).otherwise(F.col("_top")).alias("span_id"))


def make_spans(calls: DataFrame, flat: DataFrame) -> DataFrame:
    """Span rows from matched calls (opens, leaves, orphan closes) and flat function lines."""
    irq_name = F.coalesce(F.col("func").isin(IRQ_NAMES) | F.col("func").rlike(IRQ_PREFIXES), F.lit(False))
    c = calls.where(~F.col("matched"))
    is_open, is_close = F.col("kind") == "open", F.col("kind") == "close"
    ret_text = F.when(is_open, F.col("close.ret_text")).otherwise(F.col("ret_text"))
    ret = F.when(is_open, F.col("close.ret")).otherwise(F.col("ret"))
    gone = F.when(F.col("closed"), F.coalesce(F.col("close.dur_us"), F.greatest(F.lit(0.0), F.col("close.at_us") - F.col("at_us")), F.lit(0.0)))
    base = c.select(
        "trace_id", F.col("line_no").alias("span_id"), "task_key", "cpu", "indent",
        F.coalesce("func", F.when(is_open, F.col("close.func")), F.lit("?")).alias("func"),
        F.when(is_open, gone).otherwise(F.col("dur_us")).alias("dur_us"),
        (~is_open | F.col("close.dur_us").isNotNull()).alias("printed"),
        F.col("top").alias("parent_id"), F.col("top"), "at_us", "caller", "has_args",
        ret_text.alias("ret_text"), ret.alias("ret"),
        F.when(is_close, "orphan").when(is_open & ~F.col("closed"), "unclosed").when(is_open, "call").otherwise("leaf").alias("shape"),
        "irq_on", irq_name.alias("irq_name"), F.col("close.line_no").alias("close_line"), "end_line",
        "byte_start", F.coalesce("close.byte_end", "byte_end").alias("byte_end"), "deeper", "top_indent")
    f = flat.select(
        "trace_id", F.col("line_no").alias("span_id"), "task_key", "cpu", F.lit(None).cast("int").alias("indent"), "func",
        F.lit(None).cast("double").alias("dur_us"), F.lit(False).alias("printed"), F.col("span_id").alias("parent_id"),
        F.col("span_id").alias("top"), "at_us", "caller", F.lit(False).alias("has_args"), "ret_text", "ret",
        F.lit("flat").alias("shape"), "irq_on", F.lit(False).alias("irq_name"),
        F.lit(None).cast("bigint").alias("close_line"), F.lit(None).cast("bigint").alias("end_line"),
        "byte_start", "byte_end", F.lit(False).alias("deeper"), F.lit(None).cast("int").alias("top_indent"))
    s = base.unionByName(f)
    jump = F.coalesce((F.col("shape") != "flat") & (F.col("shape") != "orphan") & (F.col("indent") > F.col("top_indent") + 1), F.lit(False))
    # printed one level too deep, an interrupt entered through an untraced stub
    own = F.when(F.col("shape") == "flat", F.lit(False)).otherwise(F.col("irq_name") | F.col("irq_on") | jump)
    return s.withColumn("irq_own", own).drop("top_indent", "irq_name", "irq_on")


def _fits(s: DataFrame) -> bool:
    """Whether no call printed less than its children took."""
    sums = s.where(F.col("parent_id").isNotNull()).groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.sum("dur_us").alias("_load"))
    timed = s.where(F.col("shape").isin("call", "leaf") & F.col("dur_us").isNotNull()).select("trace_id", "span_id", "dur_us")
    return timed.join(sums, ["trace_id", "span_id"]).where(F.col("_load") > F.col("dur_us") + 1e-9).isEmpty()


def adopt_runs(spans: DataFrame, lines: DataFrame) -> tuple[DataFrame, bool]:
    """Re-parent calls printed deeper than the next line at their level. ``lines``: the call lines. Also tells whether no call then
    printed less than its children took, as far as that is known.

    An orphan close takes the deeper calls before it. An entry takes a deeper run
    directly before it as its first children (``lead``): an interrupt that landed in
    the tracer's entry hook. Where printed durations show that a run cannot be
    inside, it goes back to the level of the call, before it (lead) or after it (a
    trailing interrupt run); deepest calls decide first.
    """
    odd = cut(spans.where(F.col("deeper")).select("trace_id", F.col("span_id").alias("down_line"), F.col("top").alias("_dt"), F.col("shape").alias("_ds")))
    spans = spans.drop("deeper")
    if odd.isEmpty():
        s = spans.withColumn("lead", F.lit(False))
    else:
        hit = stretch_ends(lines.join(odd.select("trace_id").distinct(), "trace_id", "left_semi")).join(odd, ["trace_id", "down_line"])
        s = spans.join(hit, ["trace_id", "span_id"], "left")
        take = F.col("_ds").isNotNull() & F.col("_dt").eqNullSafe(F.col("top")) & (F.col("shape") != "flat")
        s = cut(s.withColumns({
            "parent_id": F.when(take, F.col("down_line")).otherwise(F.col("parent_id")),
            "lead": F.coalesce(take & F.col("_ds").isin("call", "leaf", "unclosed"), F.lit(False)),
        }).drop("_dt", "_ds", "down_line"))
    if _fits(s):
        return s, True
    while True:
        kid = s.where(F.col("parent_id").isNotNull())
        w = F.coalesce("dur_us", F.lit(0.0))
        loose = F.col("irq_own") & ~F.col("lead")
        sums = kid.groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(
            F.sum(w).alias("_load"), F.sum(F.when(F.col("lead"), w)).alias("_lead_load"),
            F.max(F.when(~loose, F.col("span_id"))).alias("_plain"), F.max("span_id").alias("_last"))
        bad = (s.where(F.col("shape").isin("call", "leaf") & F.col("printed") & F.col("dur_us").isNotNull())
               .join(sums, ["trace_id", "span_id"])
               .where((F.col("_load") > F.col("dur_us") + EPS)
                      & (F.col("_lead_load").isNotNull() | (F.col("_last") > F.coalesce("_plain", F.lit(-1))))))
        bad = bad.select("trace_id", F.col("span_id").alias("parent_id"), F.col("parent_id").alias("_gp"),
                         F.col("lead").alias("_gl"), F.col("indent").alias("_pi"), F.col("dur_us").alias("_d"),
                         "_load", "_lead_load", "_plain", (F.col("shape") == "leaf").alias("_leaf"))
        bad = cut(bad)
        if bad.isEmpty():
            return s, False
        deepest = bad.groupBy("trace_id").agg(F.max("_pi").alias("_pi"))
        bad = bad.join(deepest, ["trace_id", "_pi"], "left_semi")
        tail = (kid.join(bad.select("trace_id", "parent_id", "_plain"), ["trace_id", "parent_id"])
                .where(F.col("span_id") > F.coalesce("_plain", F.lit(-1)))
                .groupBy("trace_id", "parent_id").agg(F.sum(w).alias("_tail_load")))
        bad = bad.join(tail, ["trace_id", "parent_id"], "left")
        room = F.col("_d") + EPS
        tail_fits = F.col("_load") - F.coalesce("_tail_load", F.lit(0.0)) <= room
        lead_fits = F.col("_load") - F.coalesce("_lead_load", F.lit(0.0)) <= room
        has_tail, has_lead = F.col("_tail_load").isNotNull(), F.col("_lead_load").isNotNull()
        bad = bad.withColumns({
            "_hoist": has_tail & ~(~tail_fits & has_lead & lead_fits),
            "_free": has_lead & ~(has_tail & tail_fits)})
        s2 = s.join(bad.select("trace_id", "parent_id", "_gp", "_gl", "_plain", "_hoist", "_free"),
                    ["trace_id", "parent_id"], "left")
        moves = F.coalesce((F.col("lead") & F.col("_free"))
                           | (~F.col("lead") & F.col("_hoist") & (F.col("span_id") > F.coalesce("_plain", F.lit(-1)))), F.lit(False))
        s = cut(s2.withColumns({"parent_id": F.when(moves, F.col("_gp")).otherwise(F.col("parent_id")),
                                "lead": F.when(moves, F.col("_gl")).otherwise(F.col("lead"))})
                .drop("_gp", "_gl", "_plain", "_hoist", "_free"))


def _stretch(s: DataFrame) -> DataFrame:
    """A call whose children add up to more than its printed duration covers their sum."""
    kids = s.where(F.col("parent_id").isNotNull() & (F.col("shape") != "orphan"))
    sums = kids.groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.sum("dur_us").alias("_load"))
    timed = F.col("shape").isin("call", "leaf") & F.col("dur_us").isNotNull()
    if s.where(timed).join(sums, ["trace_id", "span_id"]).where(F.col("_load") > F.col("dur_us") + 1e-9).isEmpty():
        return s
    # calls with a duration give their sum upwards, others what they have
    n = s.where(timed).select("trace_id", F.col("span_id").alias("node"), "parent_id", F.col("dur_us").alias("least"))
    fixed = kids.where(~timed).groupBy("trace_id", F.col("parent_id").alias("node")).agg(F.sum("dur_us").alias("own"))
    up = n.select("trace_id", F.col("node").alias("parent_id"), F.col("node").alias("parent"))
    n = n.join(fixed, ["trace_id", "node"], "left").join(up, ["trace_id", "parent_id"], "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
    v = tree_values(cut(n.select("trace_id", "node", "parent", "least", "own"))).select("trace_id", F.col("node").alias("span_id"), "value")
    long = F.col("value") > F.col("dur_us") + 1e-9
    return cut(s.join(v, ["trace_id", "span_id"], "left").withColumn("dur_us", F.when(long, F.col("value")).otherwise(F.col("dur_us"))).drop("value"))


def _extent(s: DataFrame) -> DataFrame:
    """Time a call takes up in a reconstructed clock: its duration, or what its timed children take."""
    s = s.withColumn("ext", F.when(F.col("shape") != "orphan", F.col("dur_us")))
    gap = s.where(F.col("ext").isNull())
    if gap.isEmpty():
        return s
    n = gap.select("trace_id", F.col("span_id").alias("node"), "parent_id")
    up = n.select("trace_id", F.col("node").alias("parent_id"), F.col("node").alias("parent"))
    timed = s.where(F.col("ext").isNotNull() & F.col("parent_id").isNotNull()).groupBy("trace_id", F.col("parent_id").alias("node")).agg(F.sum("ext").alias("own"))
    n = n.join(timed, ["trace_id", "node"], "left").join(up, ["trace_id", "parent_id"], "left")
    v = tree_values(cut(n.select("trace_id", "node", "parent", F.lit(None).cast("double").alias("least"), F.coalesce("own", F.lit(0.0)).alias("own"))))
    return cut(s.join(v.select("trace_id", F.col("node").alias("span_id"), "value"), ["trace_id", "span_id"], "left")
               .withColumn("ext", F.coalesce("ext", "value")).drop("value"))


def lay_out(s: DataFrame, lines: DataFrame, fits: bool = False) -> DataFrame:
    """Per span: ``base`` and ``delta`` so that start = base + sum of delta along the path. ``lines``: the call lines with CPU and task;
    ``fits``: no call printed less than its children took."""
    s = s if fits else _stretch(s)
    s = s.withColumns({"chunk": line_chunk("span_id"), "_pp": F.coalesce("parent_id", F.lit(S.NO_PARENT)),
                       "_lane": F.when(F.col("parent_id").isNull(), F.coalesce("cpu", F.lit(-1))).otherwise(F.lit(-2))})
    absolute = s.where(F.col("at_us").isNotNull())
    printed = s.where(F.col("at_us").isNull())
    parts = []
    if not absolute.isEmpty():
        parts.append(_fit(_orphan_starts(absolute)))
    if not printed.isEmpty():
        parts += _reconstruct(printed, lines.where(F.col("at_us").isNull()).select("trace_id", "line_no", "cpu0", "task_key"))
    return union_all(parts) if parts else s.withColumns({"base": F.lit(0.0), "delta": F.lit(0.0)})


def _orphan_starts(s: DataFrame) -> DataFrame:
    """An orphan ends at its line; it starts where its duration says, not before what precedes it."""
    if s.where(F.col("shape") == "orphan").isEmpty():
        return s.withColumn("base", F.col("at_us"))
    end = F.when(F.col("shape") == "orphan", F.col("at_us")).otherwise(F.col("at_us") + F.coalesce("dur_us", F.lit(0.0)))
    s = running(cut(s.withColumn("_end", end)), ["trace_id", "_pp", "task_key"], "chunk", ["span_id"], [("_low", "maxb", "_end")])
    s = cut(s)
    first = s.where(F.col("parent_id").isNotNull()).groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(
        F.min("at_us").alias("_first"), F.max("_end").alias("_kid_end"))
    up = s.select("trace_id", F.col("span_id").alias("parent_id"), F.col("shape").alias("_us"), F.col("at_us").alias("_ua"))
    s = s.join(first, ["trace_id", "span_id"], "left").join(up, ["trace_id", "parent_id"], "left")
    low = F.greatest(F.col("_low"), F.when(F.col("_us") != "orphan", F.col("_ua")))
    start = F.least(F.coalesce(F.col("at_us") - F.col("dur_us"), F.lit(0.0)), F.col("_first"))
    start = F.greatest(start, low)
    stop = F.greatest(F.col("at_us"), F.col("_kid_end"), start)
    orphan = F.col("shape") == "orphan"
    return s.withColumns({"base": F.when(orphan, start).otherwise(F.col("at_us")),
                          "dur_us": F.when(orphan, stop - start).otherwise(F.col("dur_us"))}).drop(
        "_end", "_low", "_first", "_kid_end", "_us", "_ua")


def _fit(s: DataFrame) -> DataFrame:
    """Slide children inside their parent's exact duration, keeping order and durations."""
    up = s.where(F.col("shape").isin("call", "leaf") & F.col("dur_us").isNotNull()).select(
        "trace_id", F.col("span_id").alias("_pp"), F.col("base").alias("_s"), F.col("dur_us").alias("_d"))
    k = s.join(up, ["trace_id", "_pp"], "left")
    k = cut(k.withColumn("_w", F.coalesce("dur_us", F.lit(0.0))))
    k = running(k, ["trace_id", "_pp", "task_key"], "chunk", ["span_id"], [("_pre", "sum", "_w")])
    k = cut(k.withColumn("_lead", F.greatest("base", "_s") - F.col("_pre")))
    k = running(k, ["trace_id", "_pp", "task_key"], "chunk", ["span_id"], [("_m", "max", "_lead")])
    k = cut(k)
    whole = k.where(F.col("_s").isNotNull()).groupBy("trace_id", "_pp").agg(
        F.sum("_w").alias("_all"), F.max(F.col("_pre") + F.col("_m") + F.col("_w")).alias("_stop"))
    k = k.join(whole, ["trace_id", "_pp"], "left")
    forward = F.col("_pre") + F.col("_m")
    limit = F.col("_s") + F.col("_d")
    late = F.least(forward, limit - (F.col("_all") - F.col("_pre")))
    pos = (F.when(F.col("_s").isNull(), F.col("base"))
           .when(F.col("_stop") <= limit + 1e-9, forward)
           .when(F.col("_all") > F.col("_d") + 1e-9, F.col("_s") + F.col("_pre")).otherwise(late))
    return k.withColumn("delta", pos - F.col("base")).drop("_s", "_d", "_w", "_pre", "_lead", "_m", "_all", "_stop")


def _reconstruct(s: DataFrame, lines: DataFrame) -> list[DataFrame]:
    """No stamps: time adds up along CPUs; where tasks move between CPUs or take turns, they also wait for each other."""
    s = _extent(s)
    mixed = mixed_traces(lines)
    if mixed.isEmpty():
        return [_in_order(s)]
    s = cut(s)
    traces, lines, across = stretches(lines.join(mixed, "trace_id", "left_semi"), s.join(mixed, "trace_id", "left_semi"))
    if traces.isEmpty():
        return [_in_order(s)]
    return [_in_order(s.join(traces, "trace_id", "left_anti")), _with_waits(s.join(traces, "trace_id", "left_semi"), lines, across)]


def _with_waits(s: DataFrame, lines: DataFrame, across: DataFrame) -> DataFrame:
    """Calls inside a stretch follow each other from the start of their parent; the others start when their CPU and task are
    free, and slide to fit into what their parent printed."""
    s = cut(placed(s, lines, across))
    inner = s.where(F.col("abs").isNull())
    inner = running(inner, ["trace_id", "_pp"], "chunk", ["span_id"], [("delta", "sum", "ext")])
    outer = _fit(s.where(F.col("abs").isNotNull()).withColumn("base", F.col("abs")))
    up = s.select("trace_id", F.col("span_id").alias("_pp"), F.col("abs").alias("_up"))
    outer = outer.join(up, ["trace_id", "_pp"], "left").withColumn("delta", F.col("delta") + F.col("abs") - F.coalesce("_up", F.lit(0.0)))
    return inner.unionByName(outer.drop("_up", "base")).drop("abs", "ext").withColumn("base", F.lit(0.0))


def _in_order(s: DataFrame) -> DataFrame:
    """Siblings follow each other, roots follow each other on their CPU."""
    s = running(s, ["trace_id", "_pp", "_lane"], "chunk", ["span_id"], [("_at", "sum", "ext"), ("_prior", "prev", "span_id")])
    orphan = F.col("shape") == "orphan"
    # the first thing a task shows may have begun before the trace: it keeps its printed duration
    free = orphan & F.col("_prior").isNull() & F.col("parent_id").isNull()
    dur = F.when(free, F.greatest(F.coalesce("dur_us", F.lit(0.0)), "ext")).otherwise(F.col("ext"))
    early = F.when(free, dur - F.col("ext")).otherwise(0.0)
    childless = free & (F.col("ext") == 0)
    return s.withColumns({
        "base": F.lit(0.0), "delta": F.col("_at") - F.when(childless, 0.0).otherwise(early),
        "dur_us": F.when(orphan, dur).otherwise(F.col("dur_us"))}).drop("_at", "_prior", "ext")


def paths(s: DataFrame, leaves: bool = True) -> DataFrame:
    """Root-to-self ids and names of every span by pointer doubling: log2(depth) joins.

    Along with the path each round adds up ``delta`` and ors the interrupt flag. ``leaves``: whether a call on one line may hold others.
    """
    above = F.lit(True) if leaves else ~F.col("shape").isin("leaf", "flat")
    st = cut(s.select("trace_id", "span_id", F.col("parent_id").alias("ptr"), F.array("span_id").alias("path"),
                      F.array("func").alias("func_path"), F.col("delta").alias("slide"), F.col("irq_own").alias("irq_any"), above.alias("_above")))
    while not st.where(F.col("ptr").isNotNull()).isEmpty():
        t = st.where("_above").select("trace_id", F.col("span_id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("path").alias("_p"),
                      F.col("func_path").alias("_f"), F.col("slide").alias("_sl"), F.col("irq_any").alias("_i"))
        up = st.where(F.col("ptr").isNotNull()).join(t, ["trace_id", "ptr"]).select(
            "trace_id", "span_id", F.col("_ptr").alias("ptr"), F.concat("_p", "path").alias("path"),
            F.concat("_f", "func_path").alias("func_path"), (F.col("slide") + F.col("_sl")).alias("slide"),
            (F.col("irq_any") | F.col("_i")).alias("irq_any"), "_above")
        st = cut(st.where(F.col("ptr").isNull()).unionByName(up))
    return s.join(st.drop("ptr", "_above"), ["trace_id", "span_id"])


def assemble(tokens: DataFrame) -> Trace:
    """All tables of a trace from its tokens (which must carry line_no; byte columns are optional)."""
    for c in ("byte_start", "byte_end"):
        if c not in tokens.columns:
            tokens = tokens.withColumn(c, F.lit(None).cast("bigint"))
    tokens = cut(tokens)
    rows = clock_rows(attribute(tokens.select(*LINE), cut))
    lines = rows.where(F.col("kind").isin("open", "leaf", "close"))
    calls = enclosing(match_calls(lines))
    others = rows.where(F.col("kind").isin("fn", "event", "lost"))
    alone = others.isEmpty()
    if alone:
        inner = tokens.sparkSession.createDataFrame([], "trace_id string, line_no bigint, span_id bigint")
    else:
        inner = cut(_innermost(others, calls))
    flat = rows.where(F.col("kind") == "fn").join(inner, ["trace_id", "line_no"])
    s = make_spans(calls, flat)
    s, fits = adopt_runs(s if alone else cut(s), lines)
    s = cut(lay_out(s, lines, fits))
    # what encloses a line is an open call; only calls that were moved can lie in others
    moved = s.where(F.col("parent_id").isNotNull() & ~F.col("parent_id").eqNullSafe(F.col("top"))).select("trace_id", F.col("parent_id").alias("span_id"))
    still = moved.isEmpty()
    s = paths(s, not still)

    # calls open when events were lost on their CPU: those around the innermost one
    lost = rows.where(F.col("kind") == "lost").join(inner, ["trace_id", "line_no"])
    whole = alone or lost.isEmpty()
    if not (still and whole):
        s = cut(s)
    if whole:
        s = s.withColumn("gap_line", F.lit(None).cast("bigint"))
    else:
        hit = (lost.select("trace_id", F.col("line_no").alias("gap_line"), "span_id")
               .join(s.select("trace_id", "span_id", "path"), ["trace_id", "span_id"])
               .select("trace_id", "gap_line", F.explode("path").alias("span_id"))
               .groupBy("trace_id", "span_id").agg(F.max("gap_line").alias("gap_line")))
        s = s.join(hit, ["trace_id", "span_id"], "left")
    if still:
        s = s.withColumn("_kids", F.lit(None).cast("boolean"))
    else:
        s = s.join(moved.distinct().withColumn("_kids", F.lit(True)), ["trace_id", "span_id"], "left")
    gap = F.coalesce((F.col("gap_line") > F.col("span_id")) & (F.col("gap_line") < F.coalesce("end_line", F.lit(1 << 62))), F.lit(False))
    bit = lambda c, b: F.when(c, F.lit(b)).otherwise(F.lit(0))
    shape = F.col("shape")
    flags = (bit(shape.isin("leaf", "flat") & F.col("_kids").isNull(), S.LEAF) + bit(shape == "unclosed", S.UNCLOSED)
             + bit(shape == "orphan", S.ORPHAN) + bit(F.col("irq_any"), S.IRQ)
             + bit(F.col("ret").isNotNull(), S.HAS_RET) + bit(F.col("has_args"), S.HAS_ARGS)
             + bit(gap & (shape != "orphan"), S.GAP) + bit(shape == "flat", S.NO_DUR))
    spans = cut(s.select(
        "trace_id", "span_id", "func", F.round(F.col("base") + F.col("slide"), 6).alias("start_us"),
        F.round("dur_us", 6).alias("dur_us"), "parent_id", (F.size("path") - 1).alias("depth"),
        F.col("span_id").alias("ord"), "cpu", "task_key", flags.alias("flags"), "ret_text", "ret", "caller",
        F.col("span_id").alias("line_no"), "close_line", "byte_start", "byte_end", "path", "func_path",
        F.col("slide").alias("slide_us")))

    events = _events(rows, inner, spans)
    switches = _switches(rows, events, spans)
    gaps = _gaps(rows, spans)
    tasks = _tasks(tokens)
    tracks = make_tracks(spans, tasks)
    meta = make_meta(tokens, spans, events, gaps)
    return Trace(spans.drop("slide_us"), events, switches, gaps, tracks, tasks, meta)


def _cpu_clock(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Time of rows that carry no stamp: where the next call on their CPU starts, else the last end there."""
    nxt = spans.select("trace_id", F.col("span_id").alias("next_call"), F.col("start_us").alias("_ns"))
    shut = spans.where(F.col("close_line").isNotNull()).select(
        "trace_id", F.col("close_line").alias("next_call"), (F.col("start_us") + F.col("dur_us")).alias("_ce"))
    end = spans.groupBy("trace_id", F.coalesce("cpu", F.lit(-1)).alias("cpu0")).agg(
        F.max(F.col("start_us") + F.coalesce("dur_us", F.lit(0.0))).alias("_last"))
    r = (rows.join(nxt, ["trace_id", "next_call"], "left").join(shut, ["trace_id", "next_call"], "left")
         .join(end, ["trace_id", "cpu0"], "left"))
    return r.withColumn("ts_us", F.coalesce("at_us", "_ns", "_ce", F.when(F.col("next_call").isNull(), F.col("_last")), F.lit(0.0))).drop(
        "_ns", "_ce", "_last")


def _events(rows: DataFrame, inner: DataFrame, spans: DataFrame) -> DataFrame:
    from ..sources.tokens import event_fields

    e = rows.where(F.col("kind") == "event").join(inner, ["trace_id", "line_no"])
    e = e.join(spans.select("trace_id", "span_id", "slide_us"), ["trace_id", "span_id"], "left")
    e = _cpu_clock(e, spans)
    return e.select(
        "trace_id", F.col("line_no").alias("event_id"), F.col("event_name").alias("name"),
        F.when(F.col("at_us").isNotNull(), F.col("at_us") + F.coalesce("slide_us", F.lit(0.0))).otherwise(F.col("ts_us")).alias("ts_us"),
        "cpu", "task_key", "span_id", "line_no", "byte_start", "byte_end", "payload",
        event_fields(F.col("payload")).alias("fields"))


def _switches(rows: DataFrame, events: DataFrame, spans: DataFrame) -> DataFrame:
    """Context switches from events and from banners; banners count only before the first switch event of a trace."""
    sw = rows.where(F.col("prev_pid").isNotNull() & F.col("next_pid").isNotNull())
    first = sw.where(F.col("kind") == "event").groupBy("trace_id").agg(F.min("line_no").alias("_first"))
    sw = sw.join(first, "trace_id", "left").where(
        (F.col("kind") == "event") | F.col("_first").isNull() | (F.col("line_no") < F.col("_first")))
    sw = _cpu_clock(sw, spans)
    return sw.select(
        "trace_id", F.col("line_no").alias("seq"), "ts_us", "cpu",
        task_key(F.col("prev_pid"), F.col("cpu0")).alias("prev_key"),
        task_key(F.col("next_pid"), F.col("cpu0")).alias("next_key"),
        F.when(F.col("kind") == "event", F.col("line_no")).alias("event_id"))


def _gaps(rows: DataFrame, spans: DataFrame) -> DataFrame:
    g = _cpu_clock(rows.where(F.col("kind") == "lost"), spans)
    return g.select("trace_id", "cpu", "lost", "ts_us", "line_no")


def _tasks(tokens: DataFrame) -> DataFrame:
    """Task dimension: the latest real command name of every task."""
    cpu = F.coalesce("cpu", F.lit(-1))
    named = [tokens.where(F.col(p).isNotNull()).select(
        "trace_id", "line_no", task_key(F.col(p), cpu).alias("task_key"), F.col(p).alias("pid"), F.col(c).alias("comm"))
        for p, c in (("pid", "comm"), ("prev_pid", "prev_comm"), ("next_pid", "next_comm"))]
    real = F.when(F.col("comm").isNotNull() & (F.col("comm") != "<...>"), F.col("line_no"))
    return union_all(named).groupBy("trace_id", "task_key").agg(
        F.first("pid").alias("pid"), F.coalesce(F.max_by("comm", real), F.first("comm")).alias("comm"),
        F.min("line_no").alias("first_line"))


def make_tracks(spans: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """One lane per task that has calls."""
    end = F.col("start_us") + F.coalesce("dur_us", F.lit(0.0))
    t = spans.groupBy("trace_id", "task_key").agg(
        F.count(F.lit(1)).alias("n_spans"), F.max("depth").alias("max_depth"), F.min("start_us").alias("t0_us"),
        F.max(end).alias("t1_us"), F.sum(F.when(F.col("depth") == 0, F.col("dur_us"))).alias("busy_us"),
        F.min(F.struct("start_us", "cpu"))["cpu"].alias("first_cpu"))
    if tasks is None:
        return t.withColumn("name", F.concat(F.lit("task "), F.col("task_key"))).drop("first_cpu")
    t = t.join(tasks.select("trace_id", "task_key", "pid", "comm"), ["trace_id", "task_key"], "left")
    name = (F.when(F.col("pid") == 0, F.concat(F.lit("idle/"), F.col("first_cpu").cast("string")))
            .when(F.col("pid").isNull(), F.concat(F.lit("cpu"), F.substring_index("task_key", "/", -1)))
            .otherwise(F.concat_ws(" ", "comm", F.col("pid").cast("string"))))
    return t.withColumn("name", name).drop("pid", "comm", "first_cpu")


def make_meta(tokens: DataFrame, spans: DataFrame, events: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row per trace: format, source, clock, options seen, counts and warnings in words."""
    k, sh = F.col("kind"), F.col("shape")
    graph = sh.isin("graph", "banner", "marker") | k.isin("open", "leaf", "close")
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    call = k.isin("open", "leaf", "close")
    tok = tokens.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("lines"), F.max("byte_end").alias("bytes"),
        F.max_by("tracer", F.when(F.col("tracer").isNotNull(), F.col("line_no"))).alias("tracer"),
        F.min_by("abs_us", F.when(F.col("abs_us").isNotNull(), F.col("line_no"))).alias("t0_us"),
        any_of(graph & (k != "unparsed")).alias("_graph"), any_of(k == "fn").alias("_fn"), any_of(k == "event").alias("_event"),
        any_of("trace_cmd").alias("_cmd"), any_of(k == "header").alias("_header"),
        F.struct(
            any_of((sh == "graph") & F.col("pid").isNotNull()).alias("proc"),
            any_of(F.col("abs_us").isNotNull()).alias("abstime"),
            any_of(sh.isin("graph", "banner", "marker")).alias("cpu"),
            any_of(F.col("has_dur_col") | F.col("dur_us").isNotNull()).alias("duration"),
            any_of(call & F.col("ret").isNotNull()).alias("retval"), any_of("has_args").alias("args"),
            any_of((sh == "latency") | ((sh == "graph") & F.col("lat_flags").isNotNull())).alias("latency"),
            any_of(call & F.col("retaddr").isNotNull()).alias("retaddr")).alias("options"),
        any_of(sh.isin("bracket", "latency") & F.col("lat_flags").isNotNull()).alias("_flags"),
        F.count_if(k == "unparsed").alias("unparsed"))
    flag = lambda b: F.count_if(F.col("flags").bitwiseAND(F.lit(b)) != 0)
    sp = spans.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("spans"), flag(S.ORPHAN).alias("orphans"), flag(S.UNCLOSED).alias("unclosed"),
        F.max(F.col("start_us") + F.coalesce("dur_us", F.lit(0.0))).alias("_end"),
        F.collect_set("cpu").alias("_cpus"))
    ev = events.groupBy("trace_id").agg(F.count(F.lit(1)).alias("events"), F.max("ts_us").alias("_ee"), F.collect_set("cpu").alias("_ecpus"))
    gp = gaps.groupBy("trace_id").agg(F.count(F.lit(1)).alias("gaps"), F.sum("lost").alias("lost"))
    m = tok.join(sp, "trace_id", "left").join(ev, "trace_id", "left").join(gp, "trace_id", "left").na.fill(
        0, ["spans", "orphans", "unclosed", "events", "gaps", "lost"])
    clock = F.when(F.col("t0_us").isNull(), "reconstructed").otherwise("absolute")
    say = lambda cond, *parts: F.when(cond, F.concat(*parts))
    n = lambda c: F.col(c).cast("string")
    only = (F.col("orphans") > 0) & (F.col("orphans") == F.col("spans"))
    warnings = F.array_compact(F.array(
        say((clock == "reconstructed") & (F.col("spans") > 0), F.lit("No timestamps: times come from the printed durations, CPU by CPU.")),
        say(F.col("lost") > 0, n("lost"), F.lit(" events were lost in "), n("gaps"), F.lit(" gaps; calls open across one are incomplete.")),
        say(only, F.lit("Only closing lines were printed (tracing_thresh): faster calls are missing.")),
        say((F.col("orphans") > 0) & ~only, n("orphans"), F.lit(" calls began before the trace; only their ends are in it.")),
        say(F.col("unclosed") > 0, n("unclosed"), F.lit(" calls never closed.")),
        say(F.col("unparsed") > 0, n("unparsed"), F.lit(" lines were not understood."))))
    return m.select(
        "trace_id",
        F.when(F.col("_graph"), "function_graph").when(F.col("_fn"), "function").when(F.col("_event"), "events").otherwise("unknown").alias("format"),
        F.when(F.col("_cmd"), "trace-cmd").when(F.col("_header") | F.col("_flags") | F.col("options.cpu"), "tracefs").otherwise("unknown").alias("source"),
        "tracer", clock.alias("clock"), (F.col("t0_us") / 1e6).alias("t0_abs_s"),
        F.greatest(F.coalesce("_end", F.lit(0.0)), F.coalesce("_ee", F.lit(0.0)), F.lit(0.0)).alias("duration_us"),
        "lines", "bytes", "options",
        F.struct("spans", "events", "lost", "gaps", "orphans", "unclosed", "unparsed").alias("counts"),
        F.sort_array(F.array_distinct(F.concat(F.coalesce("_cpus", F.array().cast("array<int>")), F.coalesce("_ecpus", F.array().cast("array<int>"))))).alias("cpus"),
        warnings.alias("warnings"))
