"""Queries over the whole range of their tables, against their check SQL."""

from collections import Counter

import duckdb
import pytest

from spanloom.plans.oracles import ORACLES
from spanloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events"):
        db.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return db


def counted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(float(r[i]) if not isinstance(r[i], (str, type(None))) else r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", ["reconstructed_clock_whole", "raw_lines_whole", "timeline_tiles_whole", "event_marks_whole",
                                  "timeline_tiles", "event_marks", "violations_found"])
def test_against_check_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    want = tables.execute(ORACLES[name])
    assert counted(df.columns, df.collect()) == counted([c[0] for c in want.description], want.fetchall())


def test_no_row_is_left_out(spark, tables):
    size = lambda t: tables.execute(f"SELECT count(*) FROM {t}").fetchone()[0]
    calls = size("customer") + size("orders") + size("lineitem")
    total = lambda name: sum(r.n for r in QUERIES[name](spark, SF).collect())
    assert total("event_marks_whole") == size("events")
    assert total("timeline_tiles_whole") == calls
    assert QUERIES["reconstructed_clock_whole"](spark, SF).count() == calls
    assert QUERIES["raw_lines_whole"](spark, SF).select("trace_id", "span_id").distinct().count() == calls
