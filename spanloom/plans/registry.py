"""Registered queries over the driver's tables, and the SQL that checks them.

Stage tables (a view, its time split, its statistics) are written once per session
and folder, as a job pipeline would, and shared by the queries that start from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.categories import categorize
from ..functions.words import errno_table
from ..operators import explain as X
from ..operators import outliers as O
from ..operators import quality, search, stats, story, timeline, times
from ..operators.assemble import assemble, attribute, make_tracks
from ..operators.ordered import running
from ..session import FILE_ROWS, cut
from ..sources import adapters as A
from ..sources.adapters import stage
from ..sources.tokens import event_fields, quarantine, token_table, tokenize
from . import findings as fnd

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r4(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 4)


# ---- stage tables -------------------------------------------------------------

def tree(s, d):
    return stage(s, d, "tree", lambda: cut(A.tree(s, d)))


def tree_times(s, d):
    return stage(s, d, "tree_times", lambda: cut(times.span_times(tree(s, d))))


def tree_stats(s, d):
    return stage(s, d, "tree_stats", lambda: cut(stats.func_stats(tree_times(s, d))))


def tree_meta(s, d):
    return stage(s, d, "tree_meta", lambda: cut(A.meta_of(tree(s, d))))


def tree_outliers(s, d):
    return stage(s, d, "tree_outliers", lambda: cut(O.outliers(tree_times(s, d), tree_stats(s, d), tree_meta(s, d))))


def tree_explained(s, d):
    def make():
        o = tree_outliers(s, d)
        ex, con, steps = X.explain(tree_times(s, d), tree_stats(s, d), tree_meta(s, d), o, o)
        return cut(ex), con, steps
    return stage(s, d, "tree_explained", make)


def flat(s, d):
    return stage(s, d, "flat", lambda: cut(A.flat(s, d)))


def flat_times(s, d):
    """Leaf calls without switches or interrupts: all time is their own."""
    return plain_times(flat(s, d))


def plain_times(spans):
    return spans.withColumns({"irq_ctx": F.lit(False), "irq_root": F.lit(False), "irq_us": F.lit(0.0), "off_us": F.lit(0.0),
                              "off_direct_us": F.lit(0.0), "self_us": F.col("dur_us"), "n_children": F.lit(0).cast("bigint")})


def spiky_times(s, d):
    return stage(s, d, "spiky", lambda: cut(plain_times(A.spiky(s, d))))


def spiky_stats(s, d):
    return stage(s, d, "spiky_stats", lambda: cut(stats.func_stats(spiky_times(s, d))))


def spiky_outliers(s, d):
    return stage(s, d, "spiky_out", lambda: cut(O.outliers(spiky_times(s, d), spiky_stats(s, d), A.meta_of(spiky_times(s, d)))))


def long_calls(s, d):
    """Events as calls of value seconds, long enough to be switched out."""
    return stage(s, d, "long", lambda: cut(A.flat(s, d, F.round(F.col("value") * 1000000, 0))))


def switches(s, d):
    return stage(s, d, "sw", lambda: cut(A.sw(s, d)))


def intervals(s, d):
    return stage(s, d, "off", lambda: cut(times.off_intervals(switches(s, d))))


def text(s, d):
    return stage(s, d, "text", lambda: cut(A.graph_text(s, d), FILE_ROWS))


def parsed(s, d):
    return stage(s, d, "parsed", lambda: assemble(tokenize(text(s, d))))


def flat_runs(s, d):
    """Root lists per user, folded into runs of one event type."""
    return stage(s, d, "runs", lambda: cut(story.runs(story.siblings(flat_times(s, d)))))


def tree_runs(s, d):
    return stage(s, d, "tree_runs", lambda: cut(story.runs(story.siblings(tree_times(s, d)))))


def tree_loops(s, d):
    return stage(s, d, "tree_loops", lambda: cut(story.loop_folds(tree_runs(s, d))))


def _key(df, *cols):
    return df.select("trace_id", *cols)


# ---- text to tables -------------------------------------------------------------

@query
def parse_graph_roundtrip(s, d):
    p = parsed(s, d).spans
    return p.select("trace_id", "func", r4("start_us").alias("start_us"), r4("dur_us").alias("dur_us"), "depth", "task_key", "cpu", "flags",
                    F.try_element_at("func_path", F.lit(-2)).alias("parent_func"))


@query
def parse_bracket_roundtrip(s, d):
    t = token_table(A.bracket_text(s, d)).where("kind = 'fn'")
    t0 = t.groupBy("trace_id").agg(F.min_by("abs_us", "line_no").alias("t0"))
    return t.join(t0, "trace_id").select("line_no", "func", "caller", F.round(F.col("abs_us") - F.col("t0"), 0).alias("start_us"), "cpu", "comm", "pid")


@query
def reconstructed_clock(s, d):
    p = parsed(s, d).spans.where("depth = 0")
    return p.select("trace_id", "task_key", r4("start_us").alias("start_us"), r4(F.col("start_us") + F.col("dur_us")).alias("end_us"))


@query
def reconstructed_clock_whole(s, d):
    """Calls of every depth."""
    return parsed(s, d).spans.select("trace_id", "task_key", "depth", "func", r4("start_us").alias("start_us"), r4(F.col("start_us") + F.col("dur_us")).alias("end_us"))


@query
def migrated_calls(s, d):
    """Tasks that wander between two CPUs, without stamps: calls wait for their CPU and for their task."""
    p = assemble(tokenize(A.moved_text(s, d))).spans
    return p.select("trace_id", "task_key", "cpu", "func", "line_no", "flags", r4("start_us").alias("start_us"), r4(F.col("start_us") + F.col("dur_us")).alias("end_us"))


@query
def trace_meta(s, d):
    m = parsed(s, d).meta
    return m.select("trace_id", "format", "clock", "lines", F.col("counts.spans").alias("spans"), F.col("counts.orphans").alias("orphans"),
                    F.col("counts.unclosed").alias("unclosed"), F.col("counts.unparsed").alias("unparsed"), r4("duration_us").alias("duration_us"),
                    F.col("options.proc").alias("proc"), F.size("warnings").alias("warnings"))


def _damaged(s, d):
    return A.bracket_text(s, d).withColumn("value", F.when(F.col("line_no") % 50 == 3, F.concat(F.lit("damaged "), F.col("line_no").cast("string"), F.lit(" line")))
                                           .otherwise(F.col("value")))


@query
def parse_quarantine(s, d):
    return quarantine(token_table(_damaged(s, d))).select("trace_id", "line_no", F.col("text"))


@query
def token_kinds(s, d):
    return token_table(text(s, d)).groupBy("trace_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query
def line_numbering(s, d):
    x = A.bracket_text(s, d).select("trace_id", F.col("line_no").alias("event_id"), (F.octet_length("value") + 1).cast("bigint").alias("octets"))
    x = x.withColumns({"chunk": F.shiftright("event_id", 12), "one": F.lit(1).cast("bigint")})
    x = running(x, ["trace_id"], "chunk", ["event_id"], [("line_no", "sum", "one"), ("byte_start", "sum", "octets")])
    return x.select("event_id", "line_no", "byte_start", (F.col("byte_start") + F.col("octets")).alias("byte_end"))


@query
def task_attribution(s, d):
    f = flat(s, d).select("trace_id", F.col("span_id").alias("e"), "func", "cpu", (F.col("task_key").cast("bigint") + 1).alias("pid"), "dur_us")
    f = f.withColumn("chunk", F.shiftright("e", 16))
    f = running(f, ["trace_id", "cpu"], "chunk", ["e"], [("prev", "prev", "pid")])
    call = F.struct((F.col("e") * 2 + 1).alias("line_no"), F.format_string(" %d) %10.3f us   |  %s();", "cpu", "dur_us", "func").alias("value"))
    turn = F.struct((F.col("e") * 2).alias("line_no"), F.format_string(" %d)  user-%d   =>  user-%d", "cpu", "prev", "pid").alias("value"))
    lines = f.select("trace_id", F.explode(F.when(F.col("prev") != F.col("pid"), F.array(turn, call)).otherwise(F.array(call))).alias("l"))
    t = attribute(token_table(lines.select("trace_id", "l.line_no", "l.value")))
    return t.where("kind = 'leaf'").select(F.floor((F.col("line_no") - 1) / 2).cast("bigint").alias("event_id"), "task_key", "func")


@query
def tasks(s, d):
    return parsed(s, d).tasks.select("trace_id", "task_key", "pid", "comm")


@query
def tracks(s, d):
    return make_tracks(tree(s, d)).select("trace_id", "task_key", "n_spans", "max_depth", r4("t0_us").alias("t0_us"), r4("t1_us").alias("t1_us"), r4("busy_us").alias("busy_us"))


@query
def context_switches(s, d):
    return switches(s, d).select("seq", "cpu", "prev_key", "next_key", r4("ts_us").alias("ts_us"))


@query
def distinct_dimensions(s, d):
    t = tree(s, d)
    return t.groupBy("trace_id").agg(F.countDistinct("func").alias("functions"), F.countDistinct("task_key").alias("tasks"), F.countDistinct("cpu").alias("cpus"))


# ---- time decomposition -----------------------------------------------------------

@query
def off_intervals(s, d):
    return intervals(s, d).select("task_key", r4("off_us").alias("off_us"), r4("on_us").alias("on_us"))


@query
def off_overlap(s, d):
    return times.off_overlap(long_calls(s, d), intervals(s, d)).select("span_id", r4("off_us").alias("off_us"))


@query
def irq_context(s, d):
    return tree_times(s, d).where("irq_ctx").select("trace_id", "span_id", "irq_root")


@query
def irq_time(s, d):
    return tree_times(s, d).where("irq_us > 0").select("trace_id", "span_id", r4("irq_us").alias("irq_us"))


@query
def self_time(s, d):
    return tree_times(s, d).select("trace_id", "span_id", r4("self_us").alias("self_us"))


@query
def time_split(s, d):
    t = times.time_split(tree_times(s, d))
    return t.select("trace_id", "span_id", r4("self_part").alias("self_part"), r4("children_part").alias("children_part"), r4("off_part").alias("off_part"),
                    r4("irq_part").alias("irq_part"))


# ---- statistics ---------------------------------------------------------------------

@query
def func_stats(s, d):
    f = tree_stats(s, d)
    return f.select("trace_id", "func", "count", "timed", *[r4(c).alias(c) for c in ("total_us", "self_us", "min_us", "max_us", "p50", "p90", "p99")], "max_span")


@query
def total_no_recursion(s, d):
    same = lambda c, n: F.when(n == 1, c).otherwise("same")
    t = tree_times(s, d).withColumns({
        "func": same(F.col("func"), F.col("depth")), "func_path": F.transform("func_path", lambda f, i: same(f, i))})
    return stats.func_stats(t).select("trace_id", "func", "count", r4("total_us").alias("total_us"))


@query
def quantiles(s, d):
    q = stats.quantiles(flat(s, d))
    return q.select("func", "n", *[r4(c).alias(c) for c in ("p50", "p90", "p99")])


@query
def histogram(s, d):
    return stats.histogram(flat(s, d)).select("func", "bucket", r4("from_us").alias("from_us"), "calls")


@query
def call_edges(s, d):
    return stats.call_edges(tree_times(s, d)).select("trace_id", "caller_func", "callee_func", "caller_only", "calls", r4("total_us").alias("total_us"))


@query
def callees(s, d):
    return stats.callees(stats.call_edges(tree_times(s, d))).select("trace_id", "func", "callee_func", "calls", r4("total_us").alias("total_us"))


@query
def callers(s, d):
    return stats.callers(stats.call_edges(tree_times(s, d))).select("trace_id", "func", "caller_func", "calls", r4("total_us").alias("total_us"))


@query
def top_children(s, d):
    return stats.top_children(tree_times(s, d), 3).select("trace_id", "parent_id", "func", "calls", r4("total_us").alias("total_us"), r4("slowest_us").alias("slowest_us"), "rank")


@query
def profile(s, d):
    t = tree_times(s, d)
    p = stats.profile(t, t.where("depth = 0").select("trace_id", "span_id"))
    return p.select("trace_id", "func", F.array_join("rel_path", "/").alias("path"), "calls", "members", r4("total_us").alias("total_us"), r4("self_us").alias("self_us"))


@query
def category_shares(s, d):
    rules = [("irq", "^sysvec_"), ("entry", "^[0-9]-"), ("block", "^item_")]
    c = stats.category_shares(tree_times(s, d), categorize(tree(s, d), rules))
    return c.select("trace_id", "category", "calls", "functions", r4("self_us").alias("self_us"), r4("share").alias("share"))


@query
def function_categories(s, d):
    f = categorize(flat(s, d).unionByName(tree(s, d)))
    return f.select("func", "category")


@query
def irq_parts(s, d):
    return stats.irq_parts(tree_times(s, d)).select("trace_id", "span_id", "label", "count", r4("total_us").alias("total_us"))


@query
def group_stats(s, d):
    g = stats.group_stats(flat(s, d), ["trace_id", "task_key", "func"])
    return g.select("task_key", "func", "calls", *[r4(c).alias(c) for c in ("total_us", "median_us", "max_us")])


@query
def deviation_bins(s, d):
    key = ["trace_id", "func"]
    g = stats.group_stats(flat(s, d), key)
    return stats.deviation_bins(flat(s, d), key, g).select("func", "bin", "calls")


@query
def percent_rank(s, d):
    return stats.percent_rank(flat(s, d)).select("span_id", r4("faster_share").alias("faster_share"), "peers")


@query
def event_counts(s, d):
    return stats.event_counts(flat(s, d).withColumnRenamed("func", "name"), 4).select("name", "n", "rank")


@query
def switch_out_counts(s, d):
    return stats.switch_out_counts(switches(s, d)).select("task_key", "n")


@query
def lost_per_cpu(s, d):
    g = flat(s, d).where("span_id % 40 = 7").select("trace_id", "cpu", (F.col("span_id") % 9 + 1).alias("lost"))
    return stats.lost_per_cpu(g).select("cpu", "lost", "gaps")


@query
def error_returns(s, d):
    ret = F.when(F.col("span_id") % 5 == 0, -(F.col("span_id") % 3 + 2)).otherwise(F.col("span_id") % 10).cast("decimal(20,0)")
    e = stats.error_returns(flat(s, d).withColumn("ret", ret), errno_table(s))
    return e.select("func", "returns", "errors", "code", "n", "errno_name")


@query
def typical_peer(s, d):
    f = flat(s, d)
    return stats.typical_peer(f, f.select("trace_id", "span_id")).select("func", "span_id", "peer_id")


@query
def compare_with_typical(s, d):
    o = tree_outliers(s, d).select("trace_id", "span_id", "func")
    c = stats.compare_with_peer(tree_times(s, d), o)
    return c.select("trace_id", "target_id", "side", "span_id", "row", r4("x0_us").alias("x0_us"), r4("x1_us").alias("x1_us"))


# ---- outliers -------------------------------------------------------------------------

@query
def surprise(s, d):
    x = O.surprise(flat_times(s, d), stats.func_stats(flat_times(s, d)))
    return x.select("span_id", F.round("surprise", 3).alias("surprise"))


@query
def outlier_candidates(s, d):
    c = O.candidates(tree_times(s, d), tree_stats(s, d), tree_meta(s, d), rare_only=False)
    return c.select("trace_id", "span_id", "func", r4("dur_us").alias("dur_us"), r4("p50").alias("p50"))


@query
def rarity_cap(s, d):
    c = O.candidates(tree_times(s, d), tree_stats(s, d), tree_meta(s, d))
    return c.select("trace_id", "span_id", "func")


@query
def root_outliers(s, d):
    return tree_outliers(s, d).select("trace_id", "span_id", "func", r4("excess_us").alias("excess_us"), F.round("ratio", 3).alias("ratio"))


@query
def spiky_outlier_spans(s, d):
    return spiky_outliers(s, d).select("span_id", "func", r4("typical_us").alias("typical_us"), r4("excess_us").alias("excess_us"))


# ---- explanations -----------------------------------------------------------------------

@query
def path_stats(s, d):
    p = X.path_stats(tree_times(s, d), tree_outliers(s, d))
    return p.select("trace_id", "root_id", F.array_join("rel_path", "/").alias("path"), "calls", r4("self_us").alias("self_us"), r4("wall_us").alias("wall_us"))


@query
def contributors(s, d):
    c = tree_explained(s, d)[1]
    return c.select("trace_id", "span_id", "kind", F.array_join("rel_path", "/").alias("path"), F.round("part_us", 3).alias("part_us"), "calls")


@query
def blame_chain(s, d):
    b = tree_explained(s, d)[2]
    return b.select("trace_id", "span_id", "step", "at_span", "func", r4("dur_us").alias("dur_us"))


@query
def cause(s, d):
    return tree_explained(s, d)[0].select("trace_id", "span_id", "func", "cause", "peers", r4("typical_us").alias("typical_us"), "slow")


@query
def explanations(s, d):
    """Verdict sentences of all spiky calls."""
    t = spiky_times(s, d)
    o = spiky_outliers(s, d)
    ex = X.explain(t, spiky_stats(s, d), A.meta_of(t), o, o)[0]
    return ex.select("span_id", "cause", "verdict")


# ---- story ----------------------------------------------------------------------------------

@query
def same_func_steps(s, d):
    return story.same_func_steps(flat(s, d)).select("span_id", "prev_id", "next_id")


@query
def run_folds(s, d):
    r = story.run_folds(flat_runs(s, d))
    return r.select("task_key", "func", "first_ord", "last_ord", "calls", *[r4(c).alias(c) for c in ("total_us", "median_us", "max_us")])


@query
def loop_folds(s, d):
    return story.loops(tree_loops(s, d)).select("trace_id", "list_id", "fold_id", "unit_len", "reps", F.array_join("unit", ",").alias("unit"), r4("total_us").alias("total_us"))


@query
def loop_positions(s, d):
    p = story.loop_positions(tree_loops(s, d))
    return p.select("trace_id", "list_id", "fold_id", "pos", "func", "calls", r4("total_us").alias("total_us"), r4("median_us").alias("median_us"))


@query
def story_items(s, d):
    i = story.story(tree_times(s, d))
    return i.select("trace_id", "list_id", "kind", "func", "calls", r4("t_us").alias("t_us"), r4("total_us").alias("total_us"))


@query
def fold_outliers(s, d):
    r = flat_runs(s, d)
    key = [*story.LIST, "run_id"]
    members = r.join(story.run_folds(r).select(*key), key, "left_semi")
    return story.fold_outliers(spiky_times(s, d), spiky_outliers(s, d), members).select("span_id", "task_key", "func")


@query
def row_share(s, d):
    return story.row_share(tree(s, d)).select("trace_id", "span_id", F.round("share", 6).alias("share"))


# ---- search and filters -------------------------------------------------------------------------

@query
def fold_shares(s, d):
    """Shares of folds, of places in a loop and of single members."""
    t = tree_times(s, d)
    m = stage(s, d, "tree_folds", lambda: cut(story.folds(tree_runs(s, d))))
    return story.fold_share(t, make_tracks(t), m).select("trace_id", "list_id", "kind", "fold_id", "row", "pos", "span_id", F.round("share", 6).alias("share"))


@query
def search_calls(s, d):
    return search.matching_calls(tree(s, d), "URGENT").select("trace_id", "span_id", "func")


@query
def search_regex(s, d):
    return search.search_summary(tree_stats(s, d), "/^item_.F$/i").select("trace_id", "functions", "calls")


@query
def span_end(s, d):
    t = tree(s, d).withColumn("dur_us", F.when(F.col("span_id") % 10 != 3, F.col("dur_us")))
    return search.span_end(t, make_tracks(t)).select("trace_id", "span_id", r4("end_us").alias("end_us"))


@query
def time_range(s, d):
    t = search.span_end(tree(s, d), make_tracks(tree(s, d)))
    return search.time_range(t, 1000.0, 5000.0).select("trace_id", "span_id", "depth")


@query
def visible_depth(s, d):
    t = search.span_end(tree(s, d), make_tracks(tree(s, d)))
    return search.visible_depth(t, 1000.0, 5000.0)


@query
def flag_words(s, d):
    o = tree_outliers(s, d).select("trace_id", "func", "span_id", F.lit(True).alias("o"))
    t = tree(s, d).select("trace_id", "span_id", "func", (F.col("flags") + F.when(F.col("span_id") % 11 == 0, S.UNCLOSED).otherwise(0)).alias("flags"))
    # a table of function names: known to be small, it goes to the calls; only calls of functions with an outlier can be one
    some = cut(o.select(*stats.FUNC).distinct().coalesce(1))
    t = t.join(some, stats.FUNC, "left_semi").join(o, [*stats.FUNC, "span_id"], "left").unionByName(
        t.join(some, stats.FUNC, "left_anti").withColumn("o", F.lit(None).cast("boolean")))
    w = t.select("trace_id", "span_id", F.array_join(search.flag_words(F.col("o")), ", ").alias("words"))
    return w.where("words <> ''")


@query
def ancestors(s, d):
    return search.ancestors(tree(s, d)).select("trace_id", "span_id", "level", "ancestor_id", "ancestor_func")


@query
def subtree(s, d):
    t = tree_times(s, d)
    x = stats.subtree(t, t.where("depth = 1").select("trace_id", "span_id"))
    return x.select("trace_id", "root_id", "span_id", "row", r4("x0_us").alias("x0_us"), r4("x1_us").alias("x1_us"))


@query
def has_pattern(s, d):
    return search.has_pattern(tree_times(s, d), "^item_A").select("trace_id", "span_id")


@query
def nested_anti(s, d):
    t = tree(s, d).where("dur_us > 40")
    return O.outermost(t).select("trace_id", "span_id")


@query
def off_stretches(s, d):
    w = long_calls(s, d).select("trace_id", "span_id", "task_key", F.col("start_us").alias("t0_us"), (F.col("start_us") + F.col("dur_us")).alias("t1_us"))
    x = times.off_stretches(intervals(s, d), w)
    return x.select("span_id", r4("rel_off_us").alias("rel_off_us"), r4("rel_on_us").alias("rel_on_us"))


@query
def off_where(s, d):
    t = long_calls(s, d)
    st = stage(s, d, "long_times", lambda: cut(times.span_times(t, switches(s, d))))
    w = times.off_where(st, switches(s, d), t.select("trace_id", "span_id"))
    return w.select("span_id", "sleep_id", "ran_task")


@query
def gap_lanes(s, d):
    st = long_calls(s, d)
    gaps = st.where("span_id % 25 = 4").select("trace_id", "cpu", F.lit(1).cast("bigint").alias("lost"), (F.col("start_us") + 1000.0).alias("ts_us"), F.col("span_id").alias("line_no"))
    return timeline.gap_lanes(gaps, st, A.meta_of(st)).select("gap_line", "cpu", "task_key")


@query
def func_table(s, d):
    return search.func_table(tree_stats(s, d), "item", "total_us").select("trace_id", "func", r4("total_us").alias("total_us"))


@query
def slowest_calls(s, d):
    return search.slowest_calls(flat(s, d)).select("func", "span_id", r4("dur_us").alias("dur_us"), "rank")


@query
def track_order(s, d):
    t = search.track_order(make_tracks(tree(s, d)))
    return t.select("trace_id", "task_key", "is_idle", r4("len_us").alias("len_us"))


@query
def entry_points(s, d):
    e = fnd.entry_points(tree_times(s, d), tree_stats(s, d))
    return e.select("trace_id", "what", "func", r4("us").alias("us"), r4("share").alias("share"), "rank")


@query
def raw_lines(s, d):
    p = parsed(s, d).spans
    r = search.raw_lines(p, text(s, d), p.where("depth = 1").select("trace_id", "span_id"), head=4, tail=2)
    return r.select("trace_id", "span_id", "line_no", "value", "mark", "left_out")


@query
def raw_lines_whole(s, d):
    """Lines of every call, as many of each as the operator gives."""
    p = parsed(s, d).spans
    r = search.raw_lines(p, text(s, d), p.select("trace_id", "span_id"))
    return r.select("trace_id", "span_id", "line_no", "value", "mark", "left_out")


@query
def event_fields_map(s, d):
    e = A.table(s, d, "events").select("event_id", F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit(" kind="), F.col("event_type"),
                                                            F.lit(" note=\"a b\"")).alias("payload"))
    m = e.select("event_id", event_fields(F.col("payload")).alias("m"))
    return m.select("event_id", F.col("m")["user"].alias("user"), F.col("m")["kind"].alias("kind"), F.col("m")["note"].alias("note"))


@query
def call_details(s, d):
    f = flat(s, d)
    lines = f.select("trace_id", F.col("span_id").alias("line_no"), F.format_string(" %d)  1.0 us |  %s(id=%d, pos=(%d, 2)); /* <-top+0x%x ret=%d */", "cpu", "func", "span_id", "cpu", "cpu",
                                                                              -(F.col("span_id") % 3)).alias("value"))
    t = token_table(lines).select("trace_id", "line_no", "ret_text")
    sp = f.select("trace_id", "span_id", "func", F.col("span_id").alias("line_no"), F.lit(None).cast("bigint").alias("close_line"), F.lit(S.HAS_ARGS | S.HAS_RET).alias("flags"))
    c = search.call_details(sp.join(t, ["trace_id", "line_no"]), lines)
    return c.select("span_id", F.array_join(F.transform("args", lambda a: F.concat(a["name"], F.lit("="), a["value"])), ";").alias("args"), "ret_text", "errno_name", "ret_addr")


# ---- timeline -------------------------------------------------------------------------------------

@query
def track_busy(s, d):
    return make_tracks(tree(s, d)).groupBy("trace_id").agg(r4(F.sum("busy_us")).alias("busy_us"), r4(F.max("busy_us")).alias("longest_us"))


@query
def cpu_utilisation(s, d):
    t = long_calls(s, d).withColumn("dur_us", F.col("dur_us") / 10)
    u = timeline.cpu_utilisation(t, A.meta_of(t), 50)
    return u.select("cpu", "bin", F.round("busy", 3).alias("busy"))


@query
def timeline_tiles(s, d):
    t = timeline.timeline_tiles(tree(s, d), 0.0, 20000.0, 200)
    return t.select("trace_id", "task_key", "depth", "kind", "lead_span", "n", F.round("x0", 3).alias("x0"), F.round("x1", 3).alias("x1"))


@query
def timeline_tiles_whole(s, d):
    """Each trace over its own range."""
    t = tree(s, d).join(timeline.bounds(tree(s, d), tree_meta(s, d)), "trace_id")
    t = timeline.timeline_tiles(t, F.col("t0_us"), F.col("t1_us"), 200)
    return t.select("trace_id", "task_key", "depth", "kind", "lead_span", "n", F.round("x0", 3).alias("x0"), F.round("x1", 3).alias("x1"))


@query
def event_marks(s, d):
    e = flat(s, d).withColumnRenamed("start_us", "ts_us")
    return timeline.event_marks(e, 0.0, 86400000000.0, 96).select("task_key", F.col("col").cast("bigint").alias("col"), "n")


@query
def event_marks_whole(s, d):
    """Events over the whole range of their trace."""
    f = flat(s, d)
    e = f.join(timeline.bounds(f, A.meta_of(f)), "trace_id").withColumnRenamed("start_us", "ts_us")
    return timeline.event_marks(e, F.col("t0_us"), F.col("t1_us"), 96).select("task_key", F.col("col").cast("bigint").alias("col"), "n")


@query
def outlier_pins(s, d):
    t = spiky_times(s, d)
    return timeline.outlier_pins(spiky_outliers(s, d), t, A.meta_of(t), 200, 0).select(F.col("x").cast("bigint").alias("x"), "members", "slowest_span")


# ---- quality and findings ---------------------------------------------------------------------------

@query
def violations(s, d):
    return quality.violations(parsed(s, d).spans.drop("byte_start", "byte_end")).select("trace_id", "span_id", "rule")


@query
def violations_found(s, d):
    t = tree(s, d).withColumn("depth", F.when(F.col("span_id") % 1000 == 5, 7).otherwise(F.col("depth")))
    return quality.violations(t).select("trace_id", "span_id", "rule")


@query
def findings(s, d):
    p = parsed(s, d)
    ex, con, _ = tree_explained(s, d)
    f = fnd.findings(p.meta, p.spans, tree_times(s, d), tree_stats(s, d), p.tracks, p.tasks, p.events, p.switches, p.gaps, tree_outliers(s, d), ex, con)
    return f.select("trace_id", "rank", "id", "kind", "level", "title", "value", "detail")


@query
def slow_calls(s, d):
    """The flagship: text to call trees, then the calls that are slow among their peers and by how much."""
    p = parsed(s, d)
    st = stage(s, d, "parsed_times", lambda: cut(times.span_times(p.spans, p.switches, p.meta)))
    fs = cut(stats.func_stats(st))
    o = O.outliers(st, fs, p.meta)
    return o.select("trace_id", "func", r4("dur_us").alias("dur_us"), r4("typical_us").alias("typical_us"), r4("excess_us").alias("excess_us"), F.round("ratio", 3).alias("ratio"))
