"""Calls that are slow among their peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..session import cut
from .ordered import median_picks, order_stats
from .stats import FUNC
from .times import has, timed


def min_excess(duration: Column) -> Column:
    """Smallest excess worth calling slow: a share of the trace, between 10 and 50 µs."""
    return F.greatest(F.lit(S.EXCESS_LO_US), F.least(F.lit(S.EXCESS_HI_US), duration * S.EXCESS_SHARE))


def surprise(st: DataFrame, fs: DataFrame) -> DataFrame:
    """log2(duration / median), never negative; 0 with too few peers."""
    j = st.select("trace_id", "func", "span_id", "dur_us", "flags").join(fs.select(*FUNC, "timed", "p50"), FUNC)
    ok = timed() & (F.col("timed") - 1 >= S.MIN_PEERS) & (F.col("p50") > 0)
    return j.select("trace_id", "func", "span_id", "dur_us",
                    F.when(ok, F.greatest(F.lit(0.0), F.log2(F.col("dur_us") / F.col("p50")))).otherwise(0.0).alias("surprise"))


def candidates(st: DataFrame, fs: DataFrame, meta: DataFrame, rare_only: bool = True) -> DataFrame:
    """Robust candidates: far from the median of log durations in units of the spread.

    The cheap tests (3 x the median, the absolute excess) run first; the spread is only
    computed for functions that still have a call in question.
    """
    f = fs.where((F.col("timed") - 1 >= S.MIN_PEERS) & (F.col("p50") > 0)).withColumn(
        "med_log", (F.log2(F.greatest("mid_lo", F.lit(1e-3))) + F.log2(F.greatest("mid_hi", F.lit(1e-3)))) / 2
    ).select(*FUNC, "timed", "p50", "med_log")
    m = meta.select("trace_id", min_excess(F.col("duration_us")).alias("min_excess"))
    t = st.where(timed()).select("trace_id", "func", "span_id", "dur_us", "flags", "path")
    j = t.join(f, FUNC)
    far = cut(j.where(~has(S.GAP) & (F.col("dur_us") >= S.RATIO_MIN * F.col("p50"))).join(m, "trace_id")
           .where(F.col("dur_us") - F.col("p50") >= F.greatest("min_excess", "p50")))
    hot = far.select(*FUNC).distinct()
    dev = (j.join(hot, FUNC, "left_semi")
           .select(*FUNC, F.abs(F.log2(F.greatest("dur_us", F.lit(1e-3))) - F.col("med_log")).alias("dev")))
    mad = order_stats(dev, FUNC, "dev", median_picks()).select(*FUNC, ((F.col("mid_lo") + F.col("mid_hi")) / 2).alias("mad"))
    z = (F.log2("dur_us") - F.col("med_log")) / F.greatest(S.MAD_SCALE * F.col("mad"), F.lit(S.SIGMA_FLOOR))
    c = far.join(mad, FUNC).withColumn("z", z).where(F.col("z") >= S.Z_MIN)
    c = c.select("trace_id", "func", "span_id", "dur_us", "p50", "timed", "z", "path")
    c = cut(c)
    return rarity(c) if rare_only else c


def rarity(c: DataFrame) -> DataFrame:
    """Drop all candidates of a function that has too many: a wide spread, not outliers."""
    n = c.groupBy(*FUNC).agg(F.count(F.lit(1)).alias("_n"), F.first("timed").alias("_t"))
    keep = n.where(F.col("_n") <= F.greatest(F.lit(1), F.floor(S.MAX_SHARE * F.col("_t")))).select(*FUNC)
    return c.join(keep, FUNC, "left_semi")


def outermost(c: DataFrame) -> DataFrame:
    """Candidates that do not lie inside another candidate."""
    anc = c.select("trace_id", F.col("span_id").alias("inner_id"), F.explode(
        F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("span_id"))
    nested = anc.join(c.select("trace_id", "span_id"), ["trace_id", "span_id"], "left_semi").select(
        "trace_id", F.col("inner_id").alias("span_id"))
    return c.join(nested, ["trace_id", "span_id"], "left_anti")


def outliers(st: DataFrame, fs: DataFrame, meta: DataFrame) -> DataFrame:
    """Root-cause outliers with typical duration, excess and ratio."""
    o = outermost(cut(candidates(st, fs, meta)))
    return o.select("trace_id", "span_id", "func", "dur_us", F.col("p50").alias("typical_us"), "timed",
                    (F.col("dur_us") - F.col("p50")).alias("excess_us"), (F.col("dur_us") / F.col("p50")).alias("ratio"))
