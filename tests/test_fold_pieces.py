"""Pieces of sibling lists are scanned partition by partition, not group by group."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from spanloom.operators import story


def test_a_piece_may_go_on_over_batches():
    rng, rows, want = random.Random(4), [], {}
    for lst in range(40):
        names = [rng.choice("abc") for _ in range(rng.randrange(1, 60))] if lst % 3 else list("ab" * 20) + [None] * 4
        for i, f in enumerate(names):
            rows.append(("t", lst, "7", 100, 100 + i, f))
        want[lst] = [(k, f + 100, u, n, p, r, i + 100) for k, f, u, n, p, r, i in story.scan(names)]
    cols = ["trace_id", "list_id", "task_key", "piece", "idx", "func"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=cols)
    for size in (1, 7, len(rows)):
        got = {}
        for b in story._fold_pieces(iter([batch.slice(k, size) for k in range(0, len(rows), size)] + [batch.slice(0, 0)])):
            for r in b.to_pylist():
                got.setdefault(r["list_id"], []).append(tuple(r[c] for c in ("kind", "fold_id", "unit_len", "reps", "pos", "rep", "idx")))
        assert got == {k: v for k, v in want.items() if v}


def test_many_short_lists_take_no_call_each(spark):
    st = spark.range(3000).select(
        F.lit("t").alias("trace_id"), F.floor(F.col("id") / 3).cast("bigint").alias("parent_id"), F.lit("1").alias("task_key"), F.col("id").alias("span_id"),
        F.lit("f").alias("func"), F.col("id").cast("double").alias("start_us"), F.lit(1.0).alias("dur_us"), F.col("id").alias("ord"))
    f = story.folds(story.runs(story.siblings(st)))
    assert "FlatMapGroups" not in f._jdf.queryExecution().executedPlan().toString()
    got = f.groupBy("kind", "unit_len", "reps").count().collect()
    assert [tuple(r) for r in got] == [("group", 1, 3, 3000)]
