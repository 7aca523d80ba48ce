"""Joins are planned by rows, not by how well files compress."""

from pyspark.sql import functions as F

from spanloom.session import cut


def test_a_small_file_of_many_rows_is_not_sent_to_the_driver(spark):
    wide = spark.range(400_000).select("id", F.lit("n1").alias("trace_id"), *[F.lit(0.0).alias(f"c{i}") for i in range(30)])
    t = cut(wide.coalesce(1))
    ids = t.select("trace_id", F.col("id").alias("parent"))
    j = t.join(ids, (t["trace_id"] == ids["trace_id"]) & (t["id"] == ids["parent"]))
    assert "BroadcastHashJoin" not in j._jdf.queryExecution().sparkPlan().toString()


def test_a_tiny_table_still_is(spark):
    t, names = cut(spark.range(400_000)), cut(spark.range(5).coalesce(1))
    assert "BroadcastHashJoin" in t.join(names, "id")._jdf.queryExecution().sparkPlan().toString()
