"""Finding calls: names, time ranges, ancestors, raw lines, arguments."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.words import ERRNO, errno_of
from .ordered import running, top_rows


def name_filter(query: str, col: str = "func") -> Column:
    """Case-insensitive part of a name, or ``/pattern/flags``; an empty or invalid pattern filters nothing."""
    q = (query or "").strip()
    if not q:
        return F.lit(True)
    m = re.fullmatch(r"/(.+)/([a-z]*)", q, re.S)
    if not m:
        return F.contains(F.lower(F.col(col)), F.lit(q.lower()))
    try:
        re.compile(m[1])
    except re.error:
        return F.lit(True)
    return F.col(col).rlike(("(?i)" if "i" in m[2] else "") + m[1])


def search_summary(fs: DataFrame, query: str) -> DataFrame:
    return fs.where(name_filter(query)).groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("functions"), F.sum("count").alias("calls"))


def matching_calls(spans: DataFrame, query: str) -> DataFrame:
    """Calls of matching functions in time order."""
    return spans.where(name_filter(query)).orderBy("trace_id", "start_us", "span_id")


def span_end(spans: DataFrame, tracks: DataFrame) -> DataFrame:
    """Spans with ``end_us``: an unclosed call runs to the end of its track."""
    t = tracks.select("trace_id", "task_key", "t1_us")
    return spans.join(t, ["trace_id", "task_key"]).withColumn(
        "end_us", F.coalesce(F.col("start_us") + F.col("dur_us"), "t1_us")).drop("t1_us")


def trace_start(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("trace_id").agg(F.least(F.lit(0.0), F.min("t0_us")).alias("start_us"))


def time_range(spans_with_end: DataFrame, t0: float, t1: float) -> DataFrame:
    """Calls that touch [t0, t1]."""
    return spans_with_end.where((F.col("end_us") >= t0) & (F.col("start_us") <= t1))


def visible_depth(spans_with_end: DataFrame, t0: float, t1: float) -> DataFrame:
    return time_range(spans_with_end, t0, t1).groupBy("trace_id", "task_key").agg(F.max("depth").alias("visible_depth"))


def flag_words(outlier: Column | None = None) -> Column:
    """What is special about a call, in words."""
    bit = lambda b: F.col("flags").bitwiseAND(F.lit(b)) != 0
    words = [F.when(bit(S.IRQ), "interrupt"), F.when(bit(S.ORPHAN), "cut off"), F.when(bit(S.UNCLOSED), "never returned"),
             F.when(bit(S.GAP), "events lost inside")]
    if outlier is not None:
        words.append(F.when(outlier, "outlier"))
    return F.array_compact(F.array(*words))


def ancestors(spans: DataFrame) -> DataFrame:
    """(call, level, ancestor) pairs, root first."""
    z = F.arrays_zip(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("id"),
                     F.slice("func_path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("f"))
    return spans.select("trace_id", "span_id", F.posexplode(z).alias("level", "a")).select(
        "trace_id", "span_id", "level", F.col("a.id").alias("ancestor_id"), F.col("a.f").alias("ancestor_func"))


def has_pattern(st: DataFrame, pattern: str) -> DataFrame:
    """Calls whose subtree (interrupts left out) has a function that matches."""
    hit = st.where(F.col("func").rlike(pattern) & ~F.col("irq_ctx"))
    return hit.select("trace_id", F.explode("path").alias("span_id")).distinct()


def func_table(fs: DataFrame, query: str = "", by: str = "self_us", descending: bool = True) -> DataFrame:
    """The function table: filtered and sorted by any column, ties by name."""
    key = F.coalesce(F.col(by), F.lit(0.0)) if by != "func" else F.col("func")
    return fs.where(name_filter(query)).orderBy(key.desc() if descending else key.asc(), "trace_id", "func")


def slowest_calls(st: DataFrame, limit: int = 20) -> DataFrame:
    s = st.where(F.col("dur_us").isNotNull()).select("trace_id", "func", "span_id", "dur_us")
    return top_rows(s, ["trace_id", "func"], [F.desc("dur_us"), "span_id"], limit)


def track_order(tracks: DataFrame) -> DataFrame:
    """Tracks longest first, idle ones last; ``busy_rank`` orders by time in calls instead."""
    idle = F.col("name").rlike("^idle|swapper")
    t = tracks.withColumns({"is_idle": idle, "len_us": F.col("t1_us") - F.col("t0_us")})
    return t.orderBy("trace_id", "is_idle", F.desc("len_us"), "task_key")


# ---- raw lines and details ----------------------------------------------------

def raw_lines(spans: DataFrame, lines: DataFrame, targets: DataFrame, head: int = 200, tail: int = 20) -> DataFrame:
    """Text lines of target calls: the first ``head`` and last ``tail``, with the number left out between.

    The numbers wanted, ``head + tail`` at most per call, are written out and joined on (trace, line number).
    """
    t = (spans.join(targets.select("trace_id", "span_id"), ["trace_id", "span_id"], "left_semi")
         .select("trace_id", "span_id", F.col("line_no").alias("_first"), F.coalesce("close_line", "line_no").alias("_last")))
    t = t.withColumn("n_lines", F.col("_last") - F.col("_first") + 1)
    span = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    top = span(F.col("_first"), F.least(F.col("_last"), F.col("_first") + head - 1))
    rest = span(F.greatest(F.col("_first") + head, F.col("_last") - tail + 1), F.col("_last"))
    j = t.withColumn("line_no", F.explode(F.concat(top, rest))).join(lines.select("trace_id", "line_no", "value"), ["trace_id", "line_no"])
    mark = F.when(F.col("line_no") == F.col("_first"), "entry").when(F.col("line_no") == F.col("_last"), "close")
    return j.select("trace_id", "span_id", "line_no", "value", mark.alias("mark"),
                    F.greatest(F.lit(0), F.col("n_lines") - head - tail).alias("left_out"))


def split_args(text: Column) -> Column:
    """Arguments of a call split on top-level commas (nesting of (), [] and {} kept), trimmed."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("depth"))

    def step(acc, ch):
        opens, shuts = ch.isin("(", "[", "{"), ch.isin(")", "]", "}")
        comma = (ch == ",") & (acc["depth"] == 0)
        return F.struct(
            F.when(comma, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"]).alias("out"),
            F.when(comma, F.lit("")).otherwise(F.concat(acc["cur"], ch)).alias("cur"),
            (acc["depth"] + F.when(opens, 1).when(shuts, -1).otherwise(0)).alias("depth"))

    parts = F.aggregate(F.split(text, ""), start, step, lambda a: F.concat(a["out"], F.array(a["cur"])))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def call_details(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """Arguments, return text, errno name and return address of calls whose lines print them."""
    want = spans.where(F.col("flags").bitwiseAND(F.lit(S.HAS_ARGS | S.HAS_RET)) != 0)
    j = want.select("trace_id", "span_id", "func", "line_no", "close_line", "ret_text").join(
        lines.select("trace_id", "line_no", F.col("value").alias("entry")), ["trace_id", "line_no"])
    shut = lines.select("trace_id", F.col("line_no").alias("close_line"), F.col("value").alias("shut"))
    j = j.join(shut, ["trace_id", "close_line"], "left")
    at = F.expr("substring(entry, instr(entry, concat(func, '(')) + length(func) + 1)")
    # the text up to the parenthesis that closes the argument list: args end before `) {`, `);` or `) /*`
    inner = F.regexp_extract(at, r"^(.*)\)\s*(?:[;{]|$|\s/\*)", 1)
    inner = F.regexp_replace(F.regexp_replace(inner, r"\)\s*[;{]?\s*/\*.*$", ""), r"\)\s*[;{]\s*$", "")
    pairs = F.transform(split_args(inner), lambda a: F.when(
        F.instr(a, "=") > 1, F.struct(F.trim(F.substring_index(a, "=", 1)).alias("name"), F.trim(F.regexp_replace(a, "^[^=]*=", "")).alias("value")))
        .otherwise(F.struct(F.lit("").alias("name"), a.alias("value"))))
    ra = lambda c: F.regexp_extract(c, r"/\*[^*]*<-(\S+)[^*]*\*/", 1)
    addr = F.coalesce(F.when(ra(F.col("shut")) != "", ra(F.col("shut"))), F.when(ra(F.col("entry")) != "", ra(F.col("entry"))))
    names = F.create_map(*[x for k, v in ERRNO.items() for x in (F.lit(k), F.lit(v))])
    return j.select("trace_id", "span_id", "func", F.when(inner != "", pairs).otherwise(F.array().cast("array<struct<name:string,value:string>>")).alias("args"),
                    "ret_text", F.try_element_at(names, errno_of(F.col("ret_text"))).alias("errno_name"), addr.alias("ret_addr"))
