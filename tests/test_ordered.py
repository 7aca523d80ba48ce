"""Ordered helpers: linear in the rows, chunks bounded by rows."""

import time

import pytest
from pyspark.sql import functions as F

from spanloom.operators.ordered import running, with_value_chunk


def frame(spark, n):
    return spark.range(n).select(F.lit("k").alias("key"), (F.col("id") / 65536).cast("bigint").alias("chunk"), F.col("id").alias("pos"), F.when(F.col("id") % 1000 == 7, F.col("id")).alias("v"))


def test_next_is_linear(spark):
    took = []
    for n in (60_000, 60_000, 120_000):
        t = time.time()
        r = running(frame(spark, n), ["key"], "chunk", ["pos"], [("after", "next", "v"), ("before", "prev", "v")])
        assert r.agg(F.sum("after"), F.sum("before")).first()[0] > 0
        took.append(time.time() - t)
    assert took[2] < 4 * max(took[1], 0.5)


def test_next_and_prev_against_a_list(spark):
    rows = [("k", i // 7, i, i if i % 5 == 3 else None) for i in range(60)]
    got = running(spark.createDataFrame(rows, "key string, chunk bigint, pos bigint, v bigint"), ["key"], "chunk", ["pos"], [("after", "next", "v"), ("before", "prev", "v")]).collect()
    for r in got:
        later, earlier = [v for *_, p, v in rows if p > r.pos and v is not None], [v for *_, p, v in rows if p < r.pos and v is not None]
        assert (r.after, r.before) == (later[0] if later else None, earlier[-1] if earlier else None)


@pytest.mark.parametrize("far", [0.0, 1e15])
def test_value_chunks_are_bounded_by_rows(spark, far):
    df = spark.range(20_000).select(F.lit("a").alias("k"), F.when(F.col("id") == 0, F.lit(far)).otherwise(F.col("id") / 1000.0).alias("t"))
    got = with_value_chunk(df, ["k"], "t", rows=1000).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("a"), F.max("t").alias("z")).orderBy("chunk").collect()
    assert max(r.n for r in got) <= 2001 and len(got) >= 10
    assert all(x.z < y.a for x, y in zip(got, got[1:]))


def test_keys_in_one_chunk_meet_no_summary(spark):
    """Many small keys: the rows are not joined with a summary as long as the list of keys."""
    df = spark.range(5000).select((F.col("id") / 2).cast("bigint").alias("key"), F.shiftright("id", 16).alias("chunk"), F.col("id").alias("pos"))
    r = running(df, ["key"], "chunk", ["pos"], [("sum", "sum", "pos"), ("all", "total", "pos"), ("before", "prev", "pos"), ("after", "next", "pos")])
    rows = r.collect()
    assert len(rows) == 5000 and all(
        (x.sum, x.all, x.before, x.after) == ((x.pos - 1, 2 * x.pos - 1, x.pos - 1, None) if x.pos % 2 else (0, 2 * x.pos + 1, None, x.pos + 1)) for x in rows)
    assert "Join" not in r._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_keys_of_one_and_of_several_chunks(spark):
    rows = [("k", i // 7, i, i % 4) for i in range(60)] + [("one", 3, i, 1) for i in range(21, 25)] + [(None, 0, 0, 5)]
    got = running(spark.createDataFrame(rows, "key string, chunk bigint, pos bigint, v bigint"), ["key"], "chunk", ["pos"], [
        ("sum", "sum", "v"), ("top", "max", "v"), ("all", "total", "v")]).collect()
    for r in got:
        mine = [(p, v) for k, _, p, v in rows if k == r.key]
        assert (r.sum, r.top, r.all) == (sum(v for p, v in mine if p < r.pos), max(v for p, v in mine if p <= r.pos), sum(v for _, v in mine) if r.key else None)
