"""Invariants of a span table as one table of violations (empty when all hold)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .ordered import running, union_all

EPS = 1e-6


def violations(spans: DataFrame, chunk_bits: int = 16) -> DataFrame:
    """(trace_id, span_id, rule) for every broken invariant."""
    closed = (F.col("flags").bitwiseAND(F.lit(S.UNCLOSED)) == 0) & F.col("dur_us").isNotNull()
    end = F.when(closed, F.col("start_us") + F.col("dur_us"))
    s = spans.withColumns({"_end": end, "_closed": closed})
    p = s.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(True).alias("_has"), F.col("start_us").alias("_ps"), F.col("_end").alias("_pe"),
                 F.col("depth").alias("_pd"), F.col("task_key").alias("_pt"), F.col("path").alias("_pp"))
    c = s.where(F.col("parent_id").isNotNull()).join(p, ["trace_id", "parent_id"], "left")
    w = s.withColumns({"_l": F.coalesce("parent_id", F.lit(-1)), "chunk": F.shiftright("ord", chunk_bits),
                       "_e2": F.coalesce("_end", "start_us")})
    w = running(w, ["trace_id", "_l", "task_key"], "chunk", ["ord"], [("_prev_end", "prev", "_e2"), ("_prev_start", "prev", "start_us")])
    twice = s.groupBy("trace_id", "span_id").agg(F.count(F.lit(1)).alias("_n"))
    # every table is read once, whatever the number of its rules
    bad = lambda df, rules: df.select("trace_id", "span_id", F.explode(F.array_compact(F.array(*[F.when(c, rule) for c, rule in rules]))).alias("rule"))
    own = [(F.col("parent_id").isNull() & (F.col("depth") != 0), "root depth"), (F.col("start_us").isNull(), "no start")]
    if "byte_start" in spans.columns:
        own.append((F.col("byte_end") <= F.col("byte_start"), "empty byte range"))
    return union_all([
        bad(c, [
            (F.col("_has").isNull(), "parent missing"),
            (F.col("depth") != F.col("_pd") + 1, "depth"),
            (F.col("task_key") != F.col("_pt"), "task differs from parent"),
            (~F.slice("path", 1, F.size("path") - 1).eqNullSafe(F.col("_pp")), "path"),
            (F.col("start_us") < F.col("_ps") - EPS, "starts before parent"),
            (F.col("_end") > F.col("_pe") + EPS, "ends after parent")]),
        bad(w, [
            (F.col("start_us") < F.col("_prev_end") - EPS, "overlaps sibling"),
            (F.col("start_us") < F.col("_prev_start"), "siblings out of order")]),
        bad(s, own),
        bad(twice, [(F.col("_n") > 1, "id twice")])])


def raw_name_violations(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """Calls whose own line does not contain their function's name."""
    j = spans.where(F.col("func") != "?").join(lines.select("trace_id", "line_no", "value"), ["trace_id", "line_no"])
    return j.where(~F.contains(F.col("value"), F.col("func"))).select("trace_id", "span_id", F.lit("line does not name the call").alias("rule"))
