"""Analysis of a trace with known slow calls."""

import random
import re

import pytest
from pyspark.sql import functions as F

import spanloom
from spanloom.operators import stats, story
from spanloom.session import cut
from tests.synthetic import Builder, mystery


@pytest.fixture(scope="module")
def case(spark):
    b, reads = mystery()
    t = b.trace_tables(spark)
    t.spans, t.switches = cut(t.spans), cut(t.switches)
    return t, spanloom.analyze(t), reads


def rows(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_time_split(case):
    t, a, reads = case
    s = rows(a.times, "span_id")
    assert s[reads[37]]["off_us"] > 140
    assert s[reads[5]]["irq_us"] == pytest.approx(63.2) and s[reads[6]]["irq_us"] == 0
    assert all(r["self_us"] >= 0 for r in s.values())
    assert all(r["self_us"] < 5 for r in s.values() if r["func"] == "io_schedule")


def test_outliers_once_each(case):
    t, a, reads = case
    o = rows(a.outliers, "span_id")
    assert set(o) == {reads[k] for k in (37, 112, 160, 5, 50, 90, 140)}
    for k in (37, 112, 160):
        assert re.search("io_schedule|submit_bio", o[reads[k]]["reason"])
    for k in (5, 50, 90, 140):
        assert "timer interrupt" in o[reads[k]]["reason"]
    assert rows(a.func_stats, "func")["__x64_sys_read"]["outliers"] == 7


def test_findings(case):
    t, a, reads = case
    f = a.findings.orderBy("rank").collect()
    assert f[0]["kind"] == "summary"
    out = [r for r in f if r["kind"] == "outlier"]
    irq = [r for r in f if r["kind"] == "irq"]
    assert len(out) == 1 and re.match(r"3/200 calls of `__x64_sys_read`: .* read from disk; by .*`submit_bio`.*asleep in `io_schedule`", out[0]["detail"])
    assert len(irq) == 1 and re.match(r"4/200 calls of `__x64_sys_read`: .*timer interrupt", irq[0]["detail"])


def test_explain(case, spark):
    t, a, reads = case
    targets = spark.createDataFrame([("t", reads[k]) for k in (10, 37, 50)], "trace_id string, span_id bigint")
    e = rows(spanloom.explain(t, a, targets), "span_id")
    assert e[reads[10]]["verdict"].startswith("Typical: ")
    assert e[reads[37]]["slow"] and re.search(r"off-CPU in `io_schedule`.*no such step", e[reads[37]]["verdict"])
    steps = a.blame.where(F.col("span_id") == reads[37]).select("func").collect()
    assert "filemap_add_folio" in {r[0] for r in steps}
    assert e[reads[50]]["cause"] == "irq" and re.search("timer interrupt.* remain, as usual", e[reads[50]]["verdict"])
    assert a.contributors.where((F.col("span_id") == reads[50]) & (F.col("rank") == 1)).first()["kind"] == "irq"


def test_story_folds_reads_into_one_loop(case):
    t, a, reads = case
    top = spanloom.story_children(t, a).where("list_id = -1").collect()
    assert len(top) == 1 and top[0]["kind"] == "loop" and top[0]["calls"] == 600
    m = story.loop_folds(story.runs(story.siblings(a.times))).where("list_id = -1")
    o = story.fold_outliers(a.times, a.outliers, m).orderBy(F.desc("dur_us"), "span_id").collect()
    assert o[0]["span_id"] == reads[37] and len(o) == 7
    pos = rows(story.loop_positions(m), "pos")
    assert pos[1]["calls"] == 200


def test_profile_and_detail(case, spark):
    t, a, reads = case
    m = a.times.where("func = '__x64_sys_read'").select("trace_id", "span_id")
    p = {tuple(r["rel_path"]): r for r in spanloom.profile(t, a, m).collect()}
    assert p[()]["calls"] == 200 and p[("vfs_read",)]["calls"] == 200
    assert p[("__sysvec_apic_timer_interrupt",)]["members"] == 4
    d = spanloom.func_detail(t, a, "__x64_sys_read")
    assert d["slowest"].orderBy("rank").first()["span_id"] == reads[37]
    assert d["callees"].first()["callee_func"] == "vfs_read"


def test_off_where(case, spark):
    from spanloom.operators.times import off_where
    t, a, reads = case
    w = off_where(a.times, t.switches, spark.createDataFrame([("t", reads[37])], "trace_id string, span_id bigint")).first()
    assert w["sleep_func"] == "io_schedule" and w["ran_task"] == "7"


def test_typical_peer(spark):
    b = Builder()
    for d in (10, 12, 14, 300):
        b.leaf("read", d)
    b.open("read", 2)
    b.rows[-1]["dur_us"] = None
    b.stack.pop()
    b.leaf("alone", 3)
    s = b.trace_tables(spark).spans
    peer = rows(stats.typical_peer(s, s.select("trace_id", "span_id")), "span_id")
    assert peer[3]["peer_id"] == 1 and peer[1]["peer_id"] == 2 and peer[5]["peer_id"] is None


def test_recursion_counts_once(spark):
    b = Builder()
    b.open("rec")
    b.ts += 1
    b.leaf("rec", 2)
    b.ts = 10
    b.close(10.0)
    t = b.trace_tables(spark)
    a = spanloom.analyze(t)
    assert a.func_stats.first()["total_us"] == 10 and a.outliers.count() == 0
    e = spanloom.explain(t, a, t.spans.where("depth = 0")).first()
    assert "too few" in e["verdict"]


def test_every_call_is_in_one_fold_at_most(spark):
    names = "a b b b a b b b a b b b z a b a b a b b b b".split()
    assert [(k, n) for k, n in fold_sizes(names)] == [("loop", 12), ("loop", 6), ("group", 3)]
    rng = random.Random(4)
    for _ in range(200):
        names = [rng.choice("aab") if rng.random() < 0.9 else "z" for _ in range(rng.randint(0, 80))]
        at = [r[-1] for r in story.scan(names)]
        assert len(at) == len(set(at))
    df = spark.createDataFrame([("t", i, None, "k", n, float(i), 1.0, i) for i, n in enumerate("a b b b a b b b a b b b z a b a b a b b b b".split())],
                               "trace_id string, span_id bigint, parent_id bigint, task_key string, func string, start_us double, dur_us double, ord bigint")
    items = story.story(df).orderBy("t_us", "ord").collect()
    assert [(r.kind, r.calls) for r in items] == [("loop", 12), ("span", 1), ("loop", 6), ("group", 3)]


def fold_sizes(names):
    out = {}
    for kind, fold, *_ in story.scan(names):
        out[fold] = (kind, out.get(fold, (kind, 0))[1] + 1)
    return [out[f] for f in sorted(out)]


def test_pieces_give_the_folds_of_the_whole_list(spark):
    """Lists with stretches that no fold can cross, functions that come back far away, and loops with stray calls."""
    rng = random.Random(11)
    lists = []
    for _ in range(60):
        names = []
        for _ in range(rng.randint(0, 14)):
            unit = [rng.choice("abcdefg") for _ in range(rng.randint(1, 8))]
            for _ in range(rng.randint(1, 5)):
                names += unit + [rng.choice("abxyz") for _ in range(rng.choice([0, 0, 0, 1, 2, 3]))]
            names += [f"once{rng.randrange(40)}" for _ in range(rng.randint(0, 6))]
        lists.append(names)
    rows_ = [("t", 1000 * n + i, n, "k", f, float(i), 1.0, 1000 * n + i) for n, names in enumerate(lists) for i, f in enumerate(names)]
    st = spark.createDataFrame(rows_, "trace_id string, span_id bigint, parent_id bigint, task_key string, func string, start_us double, dur_us double, ord bigint")
    r = cut(story.runs(story.siblings(st)))
    got = {}
    for m in story.folds(r).collect():
        got.setdefault(m.list_id, []).append((m.kind, m.fold_id, m.unit_len, m.reps, m.pos, m.rep, m.span_id - 1000 * m.list_id))
    for n, names in enumerate(lists):
        assert sorted(got.get(n, [])) == sorted(story.scan(names)), names
    assert story.pieces(r).select("list_id", "piece").distinct().count() > 2 * len(lists)


def test_report_holds_every_table(case, spark, tmp_path):
    t, a, _ = case
    spanloom.write_report(t, a, str(tmp_path / "report"))
    for name, df in {"blame": a.blame, "surprise": a.surprise, "story": spanloom.story_children(t, a)}.items():
        got = spark.read.parquet(str(tmp_path / "report" / name))
        assert set(got.columns) == set(df.columns) and got.count() == df.count() > 0


def test_fold_shares(spark):
    durs = {"a": [1.0, 2.0, 4.0], "x": [3.0, 6.0, 3.0], "y": [1.0, 1.0, 2.0]}
    calls = [("a", d) for d in durs["a"]] + [("b", 5.0)] + [c for x, y in zip(durs["x"], durs["y"]) for c in (("x", x), ("y", y))]
    at, rows_ = 0.0, [("t", 0, None, "1", "top", 0.0, 40.0, 0)]
    for i, (f, d) in enumerate(calls):
        rows_.append(("t", i + 1, 0, "1", f, at, d, i))
        at += d
    st = spark.createDataFrame(rows_, "trace_id string, span_id bigint, parent_id bigint, task_key string, func string, start_us double, dur_us double, ord bigint")
    tracks = spark.createDataFrame([("t", "1", 0.0, 50.0)], "trace_id string, task_key string, t0_us double, t1_us double")
    got = {}
    for r in story.fold_share(st, tracks, story.folds(story.runs(story.siblings(st)))).collect():
        got.setdefault((r.kind, r.row), []).append(r.share)
    assert got[("group", "fold")] == [7 / 40] and got[("loop", "fold")] == [16 / 40]
    assert sorted(got[("group", "member")]) == [0.25, 0.5, 1.0]
    assert sorted(got[("loop", "position")]) == [4 / 16, 12 / 16]
    assert sorted(got[("loop", "member")]) == [0.5, 0.5, 0.5, 0.5, 1.0, 1.0]
