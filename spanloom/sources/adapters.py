"""The driver's star schema seen as traces.

tree    customer > orders > lineitem as calls of three levels; one trace per nation,
        one task per customer, siblings laid out one after the other
flat    events as leaf calls without nesting (one trace)
spiky   flat with a regular duration and rare slow calls
sw      context switches: the next user on a CPU replaces the previous one
text    tree rendered as call-graph lines, bracket lines from flat
moved   orders as tasks that wander between two CPUs, one trace per customer, without stamps

Every ordered step uses the two-level ``running`` helper, so one customer, order
or CPU holding a large share of the rows is still split into chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.ordered import running
from ..session import cut

ORDER_BASE = 10 ** 12
ITEM_STEP = 2 * 10 ** 12


_STAGES: dict[tuple[str, str, str], object] = {}


def stage(spark: SparkSession, sf: str, name: str, make):
    """A stage table or result, made once per application and folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STAGES:
        _STAGES[key] = make()
    return _STAGES[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "_items", lambda: cut(_make_items(spark, sf_dir)))


def _make_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_returnflag", "l_linestatus",
        F.shiftright(F.col("l_linenumber"), 12).alias("chunk"), F.lit(1).cast("bigint").alias("one"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    li = running(li, ["l_orderkey"], "chunk", order, [("before", "sum", "one"), ("at", "sum", "l_quantity")])
    name = F.concat(F.when(F.col("l_returnflag") == "R", "sysvec_item_").otherwise("item_"),
                    "l_returnflag", "l_linestatus")
    return li.select(
        F.col("l_orderkey").alias("o_orderkey"), (F.col("before") + 1).alias("ord"),
        F.col("at").alias("rel_us"), F.col("l_quantity").alias("dur_us"), name.alias("func"),
        F.when(F.col("l_returnflag") == "R", S.LEAF | S.IRQ).otherwise(S.LEAF).alias("flags"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "_orders", lambda: cut(_make_orders(spark, sf_dir)))


def _make_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _items(spark, sf_dir).groupBy("o_orderkey").agg(F.sum("dur_us").alias("s"), F.count("*").alias("n_items"))
    o = (table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
         .join(per, "o_orderkey", "left")
         .withColumn("n_items", F.coalesce("n_items", F.lit(0)))
         .withColumn("dur_us", F.coalesce("s", F.lit(0.0)) + 10
                     + F.when(F.col("o_orderkey") % 97 == 0, 4000.0).otherwise(0.0))
         .withColumn("n_lines", F.when(F.col("n_items") > 0, F.col("n_items") + 2).otherwise(1))
         .withColumn("one", F.lit(1).cast("bigint"))
         .withColumn("chunk", F.shiftright("o_orderkey", 16)).drop("s"))
    o = running(cut(o), ["o_custkey"], "chunk", ["o_orderkey"],
                [("rel_us", "sum", "dur_us"), ("rel_line", "sum", "n_lines"), ("before", "sum", "one")])
    return o.select("o_orderkey", "o_custkey", "dur_us", "rel_us", "rel_line", "n_items", "n_lines",
                    (F.col("before") + 1).alias("ord"),
                    F.regexp_replace("o_orderpriority", " ", "_").alias("func"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "_customers", lambda: cut(_make_customers(spark, sf_dir)))


def _make_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _orders(spark, sf_dir).groupBy("o_custkey").agg(
        F.sum("dur_us").alias("s"), F.sum("n_lines").alias("l"), F.count("*").alias("n_orders"))
    c = (table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
         .join(per.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
         .withColumn("dur_us", F.coalesce("s", F.lit(0.0)) + 5)
         .withColumn("n_orders", F.coalesce("n_orders", F.lit(0)))
         .withColumn("n_lines", F.when(F.col("n_orders") > 0, F.col("l") + 2).otherwise(1))
         .withColumn("chunk", F.shiftright("c_custkey", 16)))
    c = running(cut(c), ["c_nationkey"], "chunk", ["c_custkey"],
                [("start_us", "sum", "dur_us"), ("line_no", "sum", "n_lines")])
    return c.select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("func"), "dur_us", "start_us",
                    "line_no", "n_lines", "n_orders")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-level span table."""
    c, o, i = _customers(spark, sf_dir), _orders(spark, sf_dir), _items(spark, sf_dir)
    trace = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    task = (F.col("c_custkey") + 1).cast("string")
    cpu = (F.col("c_nationkey") % 4).cast("int")
    top = c.select(
        trace.alias("trace_id"), F.col("c_custkey").alias("span_id"), "func", "start_us", "dur_us",
        F.lit(None).cast("bigint").alias("parent_id"), F.lit(0).alias("depth"), F.col("c_custkey").alias("ord"),
        cpu.alias("cpu"), task.alias("task_key"),
        F.when(F.col("n_orders") == 0, S.LEAF).otherwise(0).alias("flags"),
        F.array("c_custkey").alias("path"), F.array("func").alias("func_path"))
    c2 = c.select(F.col("c_custkey").alias("o_custkey"), "c_custkey", "c_nationkey",
                  F.col("func").alias("cf"), F.col("start_us").alias("cs"))
    oc = o.join(c2, "o_custkey").select(
        trace.alias("trace_id"), (F.col("o_orderkey") + ORDER_BASE).alias("span_id"), "func",
        (F.col("cs") + F.col("rel_us")).alias("start_us"), "dur_us", F.col("c_custkey").alias("parent_id"),
        F.lit(1).alias("depth"), "ord", cpu.alias("cpu"), task.alias("task_key"),
        F.when(F.col("n_items") == 0, S.LEAF).otherwise(0).alias("flags"),
        "c_custkey", "cf", "o_orderkey")
    mid = oc.select(*top.columns[:-2],
                    F.array("c_custkey", "span_id").alias("path"), F.array("cf", "func").alias("func_path"))
    p = oc.select("trace_id", "o_orderkey", F.col("span_id").alias("parent_id"), F.col("start_us").alias("os"),
                  "cpu", "task_key", "c_custkey", "cf", F.col("func").alias("of"))
    low = i.join(p, "o_orderkey").select(
        "trace_id", (F.col("ord") * ITEM_STEP + F.col("o_orderkey")).alias("span_id"), "func",
        (F.col("os") + F.col("rel_us")).alias("start_us"), "dur_us", "parent_id", F.lit(2).alias("depth"), "ord",
        "cpu", "task_key", "flags",
        F.array(F.col("c_custkey"), F.col("parent_id"), F.col("ord") * ITEM_STEP + F.col("o_orderkey")).alias("path"),
        F.array("cf", "of", "func").alias("func_path"))
    return top.unionByName(mid).unionByName(low)


def flat(spark: SparkSession, sf_dir: str, dur: Column | None = None) -> DataFrame:
    """Events as leaf calls; time 0 is the first event."""
    e = table(spark, sf_dir, "events").select(
        F.lit("events").alias("trace_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "user_id", "event_type", "value")
    t0 = e.groupBy("trace_id").agg(F.min("us").alias("t0"))
    return e.join(t0, "trace_id").select(
        "trace_id", F.col("event_id").alias("span_id"), F.col("event_type").alias("func"),
        (F.col("us") - F.col("t0")).cast("double").alias("start_us"),
        (F.col("value") if dur is None else dur).alias("dur_us"),
        F.lit(None).cast("bigint").alias("parent_id"), F.lit(0).alias("depth"), F.col("event_id").alias("ord"),
        (F.col("user_id") % 4).cast("int").alias("cpu"), F.col("user_id").cast("string").alias("task_key"),
        F.lit(S.LEAF).alias("flags"), F.array("event_id").alias("path"), F.array("event_type").alias("func_path"))


def spiky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``flat`` with 10 µs calls of which every 97th takes 400 µs more."""
    d = (F.lit(10.0) + (F.col("event_id") % 7) * F.lit(0.1)
         + F.when(F.col("event_id") % 97 == 0, 400.0).otherwise(0.0))
    return flat(spark, sf_dir, F.round(d, 4))


def sw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context switches between users on a CPU."""
    f = (flat(spark, sf_dir).select("trace_id", F.col("span_id").alias("seq"), F.col("start_us").alias("ts_us"),
                                    "cpu", F.col("task_key").alias("next_key"))
         .withColumn("chunk", F.shiftright("seq", 16)))
    f = running(f, ["trace_id", "cpu"], "chunk", ["seq"], [("prev_key", "prev", "next_key")])
    return (f.where(F.col("prev_key").isNotNull() & (F.col("prev_key") != F.col("next_key")))
            .select("trace_id", "seq", "ts_us", "cpu", "prev_key", "next_key",
                    F.lit(None).cast("bigint").alias("event_id")))


def meta_of(spans: DataFrame) -> DataFrame:
    """The part of trace_meta that analysis needs, from a span table."""
    return spans.groupBy("trace_id").agg(
        F.max(F.col("start_us") + F.coalesce("dur_us", F.lit(0.0))).alias("duration_us"),
        F.lit("absolute").alias("clock"))


def graph_text(spark: SparkSession, sf_dir: str, proc: bool = True) -> DataFrame:
    """``tree`` printed as call-graph lines: (trace_id, line_no, value)."""
    c, o, i = _customers(spark, sf_dir), _orders(spark, sf_dir), _items(spark, sf_dir)
    trace = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    head = F.concat(F.lit(" "), (F.col("c_nationkey") % 4).cast("string"), F.lit(")"),
                    F.concat(F.lit("  cust-"), (F.col("c_custkey") + 1).cast("string"), F.lit("  |"))
                    if proc else F.lit(""))
    us = F.format_string("%10.3f us   |  ", F.col("dur_us"))
    none = F.lit("               |  ")

    def line(at, *parts):
        return F.struct(at.cast("bigint").alias("line_no"), F.concat(head, *parts).alias("value"))

    def calls(df, at, n_lines, pad):
        opened = F.array(line(at, none, F.lit(pad), F.col("func"), F.lit("() {")),
                         line(at + n_lines - 1, us, F.lit(pad), F.lit("} /* "), F.col("func"), F.lit(" */")))
        return df.select(trace.alias("trace_id"), F.explode(
            F.when(n_lines > 1, opened).otherwise(F.array(line(at, us, F.lit(pad), F.col("func"), F.lit("();"))))
        ).alias("l")).select("trace_id", "l.line_no", "l.value")

    top = calls(c, F.col("line_no"), F.col("n_lines"), "")
    oc = o.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_custkey", "c_nationkey",
                         F.col("line_no").alias("cl")), "o_custkey")
    mid = calls(oc, F.col("cl") + 1 + F.col("rel_line"), F.col("n_lines"), "  ")
    ic = i.join(oc.select("o_orderkey", "c_custkey", "c_nationkey", "cl", "rel_line"), "o_orderkey")
    low = calls(ic, F.col("cl") + 1 + F.col("rel_line") + F.col("ord"), F.lit(1), "    ")
    return top.unionByName(mid).unionByName(low)


def bracket_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``flat`` printed as function-tracer lines; the caller is the CPU's name."""
    f = flat(spark, sf_dir)
    return f.select(
        "trace_id", F.col("span_id").alias("line_no"),
        F.format_string("   user-%d   [%03d] .....  %d.%06d: %s <-caller_%d",
                        F.col("task_key").cast("bigint") + 1, "cpu",
                        F.floor(F.col("start_us") / 1e6).cast("bigint"),
                        (F.col("start_us").cast("bigint") % 1000000), "func", "cpu").alias("value"))


#: what a moved task prints of its last call: it is entered on one CPU and closes on another
REPLY_US = 40.0


def moved_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks of their customer's trace, line by line in turns: every item is a call of its quantity, on the CPU that order and
    place give; a call that waits for a reply is entered after them and closes two places later. (trace_id, line_no, value)"""
    item = _items(spark, sf_dir).select("o_orderkey", F.col("ord").alias("place"), F.lit("leaf").alias("what"), "func", "dur_us")
    reply = _orders(spark, sf_dir).select("o_orderkey", F.explode(F.array(
        F.struct((F.col("n_items") + 1).alias("place"), F.lit("open").alias("what"), F.lit(None).cast("double").alias("dur_us")),
        F.struct((F.col("n_items") + 3).alias("place"), F.lit("close").alias("what"), F.lit(REPLY_US).alias("dur_us")))).alias("r")).select(
        "o_orderkey", "r.place", "r.what", F.lit("wait_reply").alias("func"), "r.dur_us")
    rows = item.unionByName(reply).join(_orders(spark, sf_dir).select("o_orderkey", "o_custkey"), "o_orderkey").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("trace_id"), "*")
    rows = cut(rows.withColumns({"one": F.lit(1).cast("bigint"), "chunk": F.shiftleft("place", 40) + F.shiftright("o_orderkey", 16)}))
    rows = running(rows, ["trace_id"], "chunk", ["place", "o_orderkey"], [("line_no", "sum", "one")])
    cpu = F.pmod(F.col("o_orderkey") + F.floor(F.col("place") / 2), F.lit(2)).cast("string")
    took = F.when(F.col("what") == "open", F.lit(" " * 14)).otherwise(F.format_string("%10.3f us ", F.col("dur_us")))
    body = (F.when(F.col("what") == "leaf", F.concat("func", F.lit("();"))).when(F.col("what") == "open", F.concat("func", F.lit("() {")))
            .otherwise(F.concat(F.lit("} /* "), "func", F.lit(" */"))))
    value = F.concat(F.lit(" "), cpu, F.lit(")  order-"), (F.col("o_orderkey") + 1).cast("string"), F.lit("  | "), took, F.lit("  |  "), body)
    return rows.select("trace_id", "line_no", value.alias("value"))
