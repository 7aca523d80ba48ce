"""What plain call lines need not do, and that odd lines beside them change nothing."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import assemble as A
from spanloom.sources.tokens import token_table, tokenize

PLAIN = [" 0)  sh-7  |               |  a() {", " 0)  sh-7  |     1.000 us   |    b();", " 1)  vi-8  |     3.000 us   |  d();", " 0)  sh-7  |     2.000 us   |  } /* a */"] * 3


def shuffles(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("Window"), df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def noisy(seed, n=60, stamps=False):
    """Calls of three tasks on two CPUs with lines that fit nowhere: closes without open, deep runs, markers, switches, losses, events."""
    r = random.Random(seed)
    depth, out, now = {}, [], 100.0
    for _ in range(n):
        cpu, k = r.randrange(2), r.random()
        task = r.choice(["sh-7", "vi-8", "<idle>-0"])
        d = depth.get(task, 0)
        now += r.randrange(5) * 1e-6
        head = f"{now:.6f} |  " if stamps else " "
        who = f"{head}{cpu})  {task}  |" if r.random() < 0.9 else f"{head}{cpu})"
        pad = "  " * max(0, d + (r.randrange(3) if r.random() < 0.1 else 0))
        name = r.choice(["a", "b", "c", "do_IRQ", "irq_exit", "sysvec_x"])
        took = f"{r.randrange(1, 60) / 10:10.3f} us   |  "
        if k < 0.03:
            out.append(f" {cpu})   {r.choice(['==========>', '<=========='])} |")
        elif k < 0.05:
            out.append(f"CPU:{cpu} [LOST {r.randrange(1, 9)} EVENTS]")
        elif k < 0.08:
            out.append(f" {cpu})  sh-7   =>  vi-8  ")
        elif k < 0.11:
            out.append(f"{who}               |  {pad}/* mark: x={r.randrange(9)} */")
        elif k < 0.4:
            out.append(f"{who}{took}{pad}{name}();")
        elif k < 0.7 and d < 6:
            out.append(f"{who}               |  {pad}{name}() {{")
            depth[task] = d + 1
        else:
            depth[task] = max(0, d - 1)
            out.append(f"{who}{took}{'  ' * depth[task]}}} /* {name} */")
    return out


def table(df):
    return sorted(df.selectExpr("*").toJSON().collect())


@pytest.fixture
def many(spark):
    def make(traces):
        return spark.createDataFrame([(t, i, v) for t, ls in traces.items() for i, v in enumerate(ls)], "trace_id string, line_no bigint, value string")
    return make


def test_plain_call_lines_stay_where_they_are(many):
    t = token_table(many({"p": PLAIN}))
    rows = A.clock_rows(A.attribute(t))
    assert shuffles(rows) == (0, 0)
    assert {(r.task_key, r.irq_on, r.at_us) for r in rows.collect()} == {("7", False, None), ("8", False, None)}


def test_calls_are_matched_in_one_shuffle(many):
    t = token_table(many({"p": PLAIN})).withColumn("byte_end", F.lit(None).cast("bigint"))
    assert shuffles(A.match_calls(A.clock_rows(A.attribute(t))))[1] == 1


def test_traces_change_nothing_in_one_another(many):
    traces = {"p": PLAIN, "n": noisy(1), "s": noisy(2, stamps=True), "t": ["# tracer: function_graph", *PLAIN, "what is this"]}
    whole = A.assemble(tokenize(many(traces)))
    parts = [A.assemble(tokenize(many({k: v}))) for k, v in traces.items()]
    for name in ("spans", "events", "switches", "gaps", "meta"):
        assert table(getattr(whole, name)) == sorted(x for p in parts for x in table(getattr(p, name))), name


def test_chunks_change_nothing(many, monkeypatch):
    traces = {"p": PLAIN, "n": noisy(3), "s": noisy(4, stamps=True)}
    want = A.assemble(tokenize(many(traces)))
    monkeypatch.setattr(A, "line_chunk", lambda col="line_no", bits=3: F.shiftright(F.col(col), bits))
    got = A.assemble(tokenize(many(traces)))
    for name in ("spans", "events", "switches", "gaps"):
        assert table(getattr(got, name)) == table(getattr(want, name)), name
