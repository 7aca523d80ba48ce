"""Work is dealt out by rows: no task gets all rows of a trace, no table is read once per rule."""

from pyspark.sql import functions as F

from spanloom import schema as S
from spanloom.operators import quality, timeline
from spanloom.operators.ordered import with_value_chunk
from spanloom.session import FILE_ROWS, cut


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_lines_lie_in_files_of_bounded_rows(spark):
    t = cut(spark.range(3 * FILE_ROWS + 5).coalesce(1), FILE_ROWS)
    assert len(t.inputFiles()) == 4 and t.count() == 3 * FILE_ROWS + 5


def test_methods_are_small_enough_to_be_compiled(spark):
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_chunks_of_a_single_trace_do_not_gather_its_rows(spark):
    t = cut(spark.range(1000).select(F.lit("t").alias("trace_id"), (F.col("id") * 7 % 1000).alias("id")))
    x = with_value_chunk(t, ["trace_id"], "id", rows=100)
    assert "SortMergeJoin" not in plan(x)
    got = x.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("chunk").collect()
    assert len(got) >= 10 and max(r["n"] for r in got) <= 101
    assert all(a["hi"] < b["lo"] for a, b in zip(got, got[1:]))


def test_small_groups_stay_whole(spark):
    t = spark.createDataFrame([(None, 1.0), (None, 9.0), ("a", 5.0)], "trace_id string, v double")
    assert [r["chunk"] for r in with_value_chunk(t, ["trace_id"], "v", rows=2).collect()] == [0, 0, 0]


def test_the_range_of_a_trace_is_joined_without_gathering_it(spark):
    t = cut(spark.range(1000).select(F.lit("t").alias("trace_id"), F.col("id").cast("double").alias("start_us"), F.lit(1.0).alias("dur_us")))
    meta = t.groupBy("trace_id").agg(F.max(F.col("start_us") + F.col("dur_us")).alias("duration_us"))
    j = t.join(timeline.bounds(t, meta), "trace_id")
    assert "BroadcastHashJoin" in plan(j) and j.select("t0_us", "t1_us").distinct().collect() == [(0.0, 1000.0)]


def test_every_rule_is_checked_in_one_reading(spark):
    cols = ("trace_id string, span_id long, parent_id long, start_us double, dur_us double, depth int, ord long, task_key string, flags int, path array<long>, "
            "byte_start long, byte_end long")
    ok = lambda i, up, at, took, path, **kw: {**dict(trace_id="t", span_id=i, parent_id=up, start_us=at, dur_us=took, depth=len(path) - 1, ord=i, task_key="1",
                                                    flags=S.LEAF, path=path, byte_start=0, byte_end=9), **kw}
    rows = [ok(1, None, 0.0, 100.0, [1]), ok(2, 1, 10.0, 5.0, [1, 2]), ok(3, 1, 12.0, 5.0, [1, 3]), ok(4, 1, 11.0, 500.0, [9, 4]),
            ok(5, 77, 1.0, 1.0, [77, 5]), ok(6, 1, 30.0, 1.0, [1, 6], depth=5), ok(7, None, 200.0, 1.0, [7], depth=3), ok(8, 1, None, 1.0, [1, 8]),
            ok(9, 1, 40.0, 1.0, [1, 9], task_key="2", byte_end=0), ok(10, 7, 100.0, 1.0, [7, 10], depth=4), ok(11, 7, 200.2, 0.1, [7, 11], depth=4),
            ok(11, 7, 200.4, 0.1, [7, 11], depth=4)]
    s = spark.createDataFrame([tuple(r.values()) for r in rows], cols)
    v = quality.violations(s)
    assert plan(v).count("Join") <= 2
    assert sorted((r["span_id"], r["rule"]) for r in v.collect()) == [
        (3, "overlaps sibling"), (4, "ends after parent"), (4, "overlaps sibling"), (4, "path"), (4, "siblings out of order"), (5, "parent missing"), (5, "path"),
        (6, "depth"), (6, "overlaps sibling"), (7, "root depth"), (8, "no start"), (9, "empty byte range"), (9, "task differs from parent"), (10, "starts before parent"),
        (11, "id twice")]
