"""What near-dups of vectors send: centroids alone to tasks, no table of ids by the size of its files."""

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanloom.llm import neardup_vectors
from spanloom.session import JOINS, cut


class Sent:
    dtypes = [("id", "bigint"), ("vec", "array<double>"), ("n", "bigint")]

    def select(self, *_):
        return self

    def mapInArrow(self, fn, _schema):
        return fn


def test_tasks_are_sent_the_centroids_alone():
    c = np.random.default_rng(1).normal(size=(1000, 16))
    assert len(cloudpickle.dumps(neardup_vectors.visits(Sent(), c))) < 2 * c.nbytes


@pytest.fixture
def joins(spark):
    before = {k: spark.conf.get(k, None) for k in JOINS}
    yield spark.conf
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_edges_of_many_vectors_are_not_sent_to_the_driver(spark, joins, monkeypatch):
    joins.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    joins.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")

    def query(s, _):
        e = cut(s.range(1_000_000).select(F.col("id").alias("hi"), (F.col("id") % 1000).alias("lo")))
        return e.join(e.groupBy("hi").agg(F.min("lo").alias("m")), "hi")

    monkeypatch.setitem(entry.llm.QUERIES, "op1_embedding_neardup", query)
    plan = entry.queries()["op1_embedding_neardup"](spark, "")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_vectors_meet_no_table_of_their_counts(spark):
    df = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 3), 1.0], 1) for i in range(60)], "id bigint, vec array<double>, n bigint")
    seen = neardup_vectors.visits(df, neardup_vectors.fit(df.select("id", "vec"), 60, cell=20))
    plan = neardup_vectors.compare(seen, 0.95, 8)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan
