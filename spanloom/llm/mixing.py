"""Mixing sources to target weights by entropy balancing.

Rates r_i per document minimise the relative entropy of tokens, sum of size_i * (r_i ln r_i - r_i), under one token
constraint per value of each family (here: the source). The dual is convex; its solution is an exponential tilt,
r_i = exp(sum of the multipliers of the document's families). Newton steps on the dual need the tokens (gradient) and
their tilted sum (Hessian) per constraint; both are Spark aggregates over cells, the distinct combinations of
families, which partial aggregation makes out of the documents first.

Rates become copies by systematic rounding: a source's documents are ranked by size, and the
fractional parts, equal inside a source, are spent evenly along the ranks, so the tokens taken differ from the
target by about one document; then at most ``MENDS`` documents per source gain or lose the copy that misses. Ranks come from counts per (source, size step, slice); no task
orders a whole source.

Null text has size 0; a null source is a source of its own, last in order; repeated rows (same id, source and text)
get equal copies; an
empty table gives no rows. Names that clash with the result's columns (size, source_size, target, rate, copies, taken) are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import append, cut, fresh, not_space, pieces, put_back, set_aside, word_spans

CAP = 3.0
PATTERN = (1, 2, 3)
STEPS = 60
PRECISION = 1e-9
#: items that a task ranks together, and size steps per doubling in the order of ranks
RANK_ROWS = 4096
SIZE_STEPS = 16
MENDS = 2


def count_words(col: pa.Array) -> list[pa.Array]:
    out = np.zeros(len(col), np.int64)
    on = not_space()
    for lo, hi, data, off in pieces(col):
        out[lo:hi] = np.diff(word_spans(data, off, on)[2])
    return [pa.array(out)]


def with_size(docs: DataFrame, text: str = "text", size: str = "size") -> DataFrame:
    """Add the number of ``[^\\x20\\x09-\\x0D]+`` in the text."""
    return append(docs.drop(size) if size in docs.columns and size != text else docs, text, [T.StructField(size, T.LongType())], count_words)


def targets(totals: DataFrame, cap: float = CAP) -> DataFrame:
    """Token targets per source: shares by the weights 1, 2, 3 in code point order, held under ``cap`` times the source.

    ``totals``: source, total. What is cut from capped sources is shared again by weight among the rest until none is above.
    """
    # one row per source, not per document
    order = Window.orderBy(F.col("source").isNull(), "source")
    rows = cut(totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in PATTERN]), ((F.row_number().over(order) - 1) % len(PATTERN) + 1).cast("int")))
               .withColumn("most", F.col("total") * F.lit(cap)))
    total = rows.agg(F.sum("total")).first()[0] or 0
    level = 0.0
    while True:
        # sources whose share at this level is above their cap stay there; the level only rises
        free = F.col("weight") * F.lit(level) < F.col("most")
        fixed, weight = rows.agg(F.sum(F.when(~free, F.col("most"))), F.sum(F.when(free, F.col("weight")))).first()
        if not weight:
            break
        step = (total - (fixed or 0.0)) / weight
        if step <= level * (1 + 1e-15):
            break
        level = step
    return rows.select("source", "total", F.least(F.col("most"), F.col("weight") * F.lit(level)).alias("target"))


def balance(cells: DataFrame, wanted: dict[str, DataFrame], steps: int = STEPS, precision: float = PRECISION) -> DataFrame:
    """Multipliers by Newton's method: ``cells`` (families, tokens) with their ``rate``.

    ``wanted``: per family a table (family, target). Within a family the constraints don't overlap, so the Hessian is
    diagonal there; families take turns. A target of 0 gives rate 0.
    """
    cells = cut(cells.withColumn("tilt", F.lit(0.0)))
    for _ in range(steps):
        worst = 0.0
        for family, want in wanted.items():
            now = cells.groupBy(family).agg(F.sum(F.col("tokens") * F.exp("tilt")).alias("have"))
            pair = now.alias("n").join(want.alias("w"), F.col(f"n.{family}").eqNullSafe(F.col(f"w.{family}")))
            # gradient over Hessian, both of the dual; a step is held to 1, where exp is still near its tangent
            step = F.when(F.col("target") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("target") - F.col("have")) / F.col("have"))))
            moves = pair.where("have > 0").select(F.col(f"n.{family}").alias("_f"), F.coalesce(step, F.lit(float("-inf"))).alias("_step"),
                                                  F.when(F.col("target") > 0, F.abs(F.col("have") / F.col("target") - 1)).alias("_miss"))
            moved = cut(cells.join(moves, F.col(family).eqNullSafe(F.col("_f")), "left")
                        .withColumn("tilt", F.col("tilt") + F.coalesce("_step", F.lit(0.0))).drop("_f", "_step"))
            worst = max(worst, moved.agg(F.max("_miss")).first()[0] or 0.0)
            cells = moved.drop("_miss")
        if worst <= precision:
            break
    return cells.withColumn("rate", F.when(F.col("tokens") > 0, F.exp("tilt")).otherwise(F.lit(1.0)))


def identity(key: str, source: str, text: str) -> Column:
    """One number per (key, source, text); rows that share it are repeats and are treated alike. A hash skips nulls, so they are told by flags."""
    parts = [F.col(c).cast("string") for c in (key, source, text)]
    return F.xxhash64(*[p.isNull() for p in parts], *parts)


def item_copies(rows: DataFrame, cap: float = CAP) -> DataFrame:
    """Per item its copies and the figures of its source. ``rows``: item, source, size; one row per document."""
    items = cut(rows.groupBy("item", "source").agg(F.sum("size").alias("w")))
    # 1. token constraints and rates, on totals per source
    totals = items.groupBy("source").agg(F.sum("w").alias("total"))
    goal = cut(targets(totals, cap))
    rates = balance(goal.select("source", F.col("total").cast("double").alias("tokens")), {"source": goal.select("source", "target")})
    plan = cut(goal.alias("g").join(rates.alias("r"), F.col("g.source").eqNullSafe(F.col("r.source"))).select(
        F.col("g.source").alias("_s"), F.col("total").alias("source_size"), "target", F.least(F.col("rate"), F.lit(cap)).alias("rate")))
    # 2. rank inside the source by (size step, slice): prefix sums of counts, then a row number inside the slice
    items = items.withColumn("z", F.when(F.col("w") > 0, F.floor(F.log2(F.col("w")) * SIZE_STEPS)).otherwise(F.lit(-1)).cast("int"))
    steps = items.groupBy(F.col("source").alias("_s"), F.col("z").alias("_z")).agg(F.ceil(F.count(F.lit(1)) / F.lit(RANK_ROWS)).cast("bigint").alias("_parts"))
    cell = F.col("source").eqNullSafe(F.col("_s")) & (F.col("z") == F.col("_z"))
    items = items.join(steps, cell).withColumn("b", F.pmod(F.col("item"), F.col("_parts"))).drop("_s", "_z", "_parts")
    ahead = Window.partitionBy("_s").orderBy("_z", "_b").rowsBetween(Window.unboundedPreceding, -1)
    per = (items.groupBy(F.col("source").alias("_s"), F.col("z").alias("_z"), F.col("b").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
           .withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n"))
    inside = Window.partitionBy("source", "z", "b").orderBy("w", "item")
    ranked = items.withColumn("r", F.row_number().over(inside)).join(per, cell & (F.col("b") == F.col("_b"))).select(
        "item", "source", "w", (F.col("r") + F.col("_before")).alias("r"))
    # 3. copies: the whole part, and one more whenever the running fraction passes a half
    out = ranked.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    whole = F.floor(F.col("rate") + F.lit(1e-9))
    part = F.greatest(F.col("rate") - whole, F.lit(0.0))
    extra = F.floor(F.col("r") * part + 0.5) - F.floor((F.col("r") - 1) * part + 0.5)
    out = cut(out.select("item", "source", "w", "source_size", "target", "rate", F.least(whole + extra, F.lit(int(cap))).cast("bigint").alias("copies")))
    for _ in range(MENDS):
        out = mend(out, cap)
    return out.drop("w")


def with_copies(rows: DataFrame, item: str, source: str, got: DataFrame) -> DataFrame:
    """Every row with the figures of its item; an item is told by its number and its source, so no row meets two."""
    it, of = fresh(rows, "it", "of")
    got = got.withColumnsRenamed({"item": it, "source": of})
    return rows.join(got, (F.col(item) == F.col(it)) & F.col(source).cast("string").eqNullSafe(F.col(of))).drop(it, of)


def mend(items: DataFrame, cap: float) -> DataFrame:
    """Move one copy in each source where that brings its tokens nearer to the target: of the item whose size is nearest to what is missing."""
    miss = items.groupBy(F.col("source").alias("_s")).agg((F.first("target") - F.sum(F.col("copies") * F.col("w"))).alias("_miss"))
    short = F.col("_miss") > 0
    can = F.when(short, F.col("copies") < F.least(F.ceil("rate"), F.lit(int(cap)))).otherwise(F.col("copies") > F.floor("rate"))
    off = F.abs(F.col("w") - F.abs("_miss"))
    best = (items.join(miss, F.col("source").eqNullSafe(F.col("_s"))).where(can & (off < F.abs("_miss")))
            .groupBy("_s").agg(F.min(F.struct(off.alias("o"), F.col("item").alias("i"), F.when(short, 1).otherwise(-1).alias("d"))).alias("_m")))
    done = items.join(best.select("_s", "_m.i", "_m.d"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("item") == F.col("i")), "left")
    return cut(done.withColumn("copies", F.col("copies") + F.coalesce("d", F.lit(0))).drop("_s", "i", "d"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cap: float = CAP) -> DataFrame:
    """Add size, source_size, target, rate, copies and taken to all rows (0 to ``cap`` copies; the same on every run)."""
    docs = docs.drop(*[c for c in ("size", "source_size", "target", "rate", "copies", "taken") if c not in (key, text, source)])
    [item] = fresh(docs, "item")
    rows = with_size(docs.withColumn(item, identity(key, source, text)), text)
    narrow = cut(rows.select(F.col(item).alias("item"), F.col(source).cast("string").alias("source"), "size"))
    return with_copies(rows, item, source, item_copies(narrow, cap)).drop(item).withColumn("taken", F.col("copies") * F.col("size"))


def mixing_query(docs: DataFrame) -> DataFrame:
    """Contract columns of every document; the text is read once and left behind."""
    rows = with_size(docs.select("doc_id", F.col("source").cast("string").alias("source"), identity("doc_id", "source", "text").alias("item"), "text"))
    rows = cut(rows.select("doc_id", "source", "item", "size"))
    got = item_copies(rows.select("item", "source", "size"))
    return with_copies(rows, "item", "source", got).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with its own columns."""
    own, names = set_aside(docs)
    got = mix(own, names["doc_id"], names["text"], names["source"]).where("copies > 0")
    return put_back(got.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), names)
