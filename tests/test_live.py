"""Live traces against the batch jobs on the same text: line numbers, tasks, parents, flags, over rotated files and restarts."""

import hashlib
import random

from spanloom import schema as S
from spanloom.operators.assemble import IRQ_NAMES, assemble, attribute
from spanloom.operators.ordered import union_all
from spanloom.sources.lines import read_lines, stream_lines
from spanloom.session import cut
from spanloom.sources.tokens import tokenize
from spanloom.streaming.live import live_quarantine, live_rows, live_spans


class Feed:
    """Writes files into a folder and runs a streaming query over what is new."""

    def __init__(self, spark, folder, make):
        self.spark, self.make = spark, make
        self.src, self.out, self.cp = folder / "in", folder / "out", folder / "cp"
        self.src.mkdir(parents=True)

    def put(self, **files):
        """What the query has written once it has read these files and run a few batches more, in which timers can run out."""
        n = 0
        for name, text in files.items():
            (self.src / f"{name.replace('__', '.')}.txt").write_bytes(text.encode())
            n += text.count("\n") + (not text.endswith("\n"))
        q = (self.make(stream_lines(self.spark, str(self.src))).writeStream.format("parquet").outputMode("append")
             .option("path", str(self.out)).option("checkpointLocation", str(self.cp)).start())
        try:
            # a query with processing-time timers never goes idle
            for _ in range(240):
                seen = q.recentProgress
                read = [i for i in range(len(seen)) if sum(p.numInputRows for p in seen[:i + 1]) >= n]
                if read and len(seen) > read[0] + 3 or q.awaitTermination(0.25):
                    break
            assert q.exception() is None and read
        finally:
            q.stop()
        return self.spark.read.parquet(str(self.out))


def shape(rows):
    return sorted((r["span_id"], r["func"], r["parent_id"], r["depth"], r["flags"], tuple(r["func_path"])) for r in rows)


def named(rows):
    """Rows by the file they came from; traces are told by hashes."""
    out = {}
    for r in rows:
        out.setdefault(r["trace_id"], []).append(r)
    return out


def trace_of(folder, name):
    return hashlib.sha224(f"file:{folder}/in/{name}.txt".encode()).hexdigest()[:16]


# ---- files and numbers ------------------------------------------------------------

PART = " 0)  cat-5  |   {0}.0 us    |  c{0}();\n".format


def test_files_that_come_early_wait(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda s: live_rows(s, first=1))
    assert feed.put(run__2=PART(2), run__3=PART(3)).count() == 0
    got = feed.put(run__1=PART(1), other=PART(7))
    assert [(r["line_no"], r["func"]) for r in got.orderBy("func").collect()] == [(0, "c1"), (1, "c2"), (2, "c3"), (0, "c7")]


def test_files_that_never_come_are_skipped_and_late_ones_set_aside(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda s: live_quarantine(s, wait_ms=0, first=1))
    got = feed.put(run__2=PART(2) + "no trace line\n")
    assert [(r["line_no"], r["text"], r["late"]) for r in got.collect()] == [(1, "no trace line", False)]
    late = feed.put(run__1=PART(1)).where("late").collect()
    assert [(r["line_no"], r["text"]) for r in late] == [(None, None)]


BANNERS = """ 0)   1.0 us    |  early();
 1)   1.0 us    |  other();
 0)    foo-42     =>    <idle>-0
 0)   0.5 us    |  idle_thing();
 1)   ==========> |
 1)   2.0 us    |  in_irq();
 1)   <========== |
 1)   2.0 us    |  after_irq();
 0)    <idle>-0   =>    bar-7
 0)               |  f() {
CPU:0 [LOST 4 EVENTS]
 0)   3.0 us    |  }
 1)  named-9  |   1.0 us    |  own();
 1)   1.0 us    |  next();
 2)   1.0 us    |  never_named();
"""


def test_numbers_and_tasks_equal_the_batch_jobs(spark, tmp_path, lines):
    """Blocks of one file, rotated files that go on, lines that wait for the name of their task, and one that never gets it."""
    rng = random.Random(3)
    text = "".join(f" {rng.randrange(3)})  tàsk-{rng.randrange(5)}  |   1.0 us    |  f{i}();{rng.choice(['', ' ' * 40])}{rng.choice([chr(10), chr(13) + chr(10)])}"
                   for i in range(600)) + "the last line has no end"
    half, early = text.index("\n", len(text) // 2) + 1, BANNERS.index(" 0)    foo")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        feed = Feed(spark, tmp_path, lambda s: live_rows(s, kinds=None))
        feed.put(one=text, run__1=text[:half], cpus__1=BANNERS[:early])
        got = named(feed.put(run__2=text[half:], cpus__2=BANNERS[early:]).collect())
        want = read_lines(spark, str(tmp_path / "in" / "one.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    key = lambda rows: sorted((r["line_no"], r["byte_start"], r["byte_end"]) for r in rows)
    assert key(got[trace_of(tmp_path, "one")]) == key(got[trace_of(tmp_path, "run")]) == key(want) and len(want) == 601
    cpus = {r["line_no"]: (r["task_key"], r["irq"]) for r in got[trace_of(tmp_path, "cpus")] if r["kind"] != "banner"}
    tokens = cut(tokenize(lines(BANNERS.removesuffix("\n"))))
    tasks = {r["line_no"]: (r["task_key"], r["irq_on"]) for r in attribute(tokens).where("kind <> 'banner'").collect()}
    # the CPU that nothing ever names is still waiting; a banner has no task of its own
    assert cpus == {n: t for n, t in tasks.items() if t[0] != "?/2"}


# ---- parents and flags ------------------------------------------------------------

def random_text(rng, n_tasks=3, steps=160):
    """Nested calls of several tasks, with interrupt runs one level too deep, lost lines, and a start in the middle of calls."""
    depth, out = [rng.randint(0, 4) for _ in range(n_tasks)], []
    say = lambda task, dur, d, text: out.append(f" {task})  t-{task + 1}  | {'%10.3f us' % dur if dur is not None else ' ' * 13} |  {'  ' * d}{text}")
    for _ in range(steps):
        t = rng.randrange(n_tasks)
        for _ in range(rng.randint(1, 5)):
            d, roll = depth[t], rng.random()
            if roll < 0.12:  # an interrupt: one level too deep, or at its own level
                at = d + rng.choice([0, 0, 1])
                say(t, rng.choice([0.5, 30.0]), at, f"{rng.choice(IRQ_NAMES)}();")
                if rng.random() < 0.5:
                    say(t, rng.choice([1.0, 20.0]), at, "__sysvec_timer();")
            elif roll < 0.4 and d:
                depth[t] -= 1
                say(t, rng.choice([2.0, 9.0, 100.0, None]), d - 1, "}" + rng.choice(["", f" /* late{len(out)} */"]))
            elif roll < 0.65 and d < 6:
                say(t, None, d, f"f{len(out)}(" + rng.choice(["", "x=1"]) + ") {")
                depth[t] += 1
            else:
                say(t, rng.choice([0.4, 3.0]), d, f"g{len(out)}();" + rng.choice(["", " /* ret=0x1 */"]))
        if rng.random() < 0.06:  # lines are lost: the task goes on somewhere else
            out.append(f"CPU:{t} [LOST {rng.randint(1, 9)} EVENTS]")
            depth[t] = max(0, depth[t] + rng.choice([-2, -1, 0, 1, 2]))
    return "\n".join(out) + "\n"


ROTATED = " 0)  cat-5  |               |  f() {\n 0)  cat-5  |   1.0 us    |    g();\n", " 0)  cat-5  |   2.0 us    |    h();\n 0)  cat-5  |   5.0 us    |  }\n"
LOST = (" 0)   cat-9    |               |  a() {\n 0)   cat-9    |               |    b() {\n 0)   cat-9    |               |      c() {\n",
        "CPU:0 [LOST 12 EVENTS]\n 0)   cat-9    |   0.2 us    |    x();\n 0)   cat-9    |   5.0 us    |  }\n 0)   cat-9    |   1.0 us    |  y();\n")


def test_live_calls_equal_the_batch_job(spark, tmp_path, lines):
    texts = {f"seed{n}": random_text(random.Random(n)) for n in range(6)} | {"rotated": "".join(ROTATED), "lost": "".join(LOST)}
    spans = named(assemble(tokenize(union_all([lines(t.removesuffix("\n"), name) for name, t in texts.items()]))).spans.collect())
    want = {name: shape(rows) for name, rows in spans.items()}
    for bit in (S.GAP, S.ORPHAN, S.IRQ, S.UNCLOSED):
        assert sum(f & bit > 0 for rows in want.values() for *_, f, _ in rows) > 5

    # whole traces, after which all tasks have been silent for long enough
    whole = Feed(spark, tmp_path / "whole", lambda s: live_spans(s, idle_ms=0))
    got = named(whole.put(**texts).collect())
    for name in texts:
        assert shape(got[trace_of(tmp_path / "whole", name)]) == want[name], name

    # over two files, cut anywhere: everything but what may still change is there, once, and the same
    parts = Feed(spark, tmp_path / "parts", live_spans)
    cuts = {name: len(ROTATED[0]) if name == "rotated" else len(LOST[0]) if name == "lost" else t.index("\n", len(t) // 2) + 1 for name, t in texts.items()}
    before = named(parts.put(**{f"{name}__1": t[:cuts[name]] for name, t in texts.items()}).collect())
    assert {r["func"] for r in before[trace_of(tmp_path / "parts", "rotated")]} == {"g"}
    after = named(parts.put(**{f"{name}__2": t[cuts[name]:] for name, t in texts.items()}).collect())
    for name in texts:
        rows = shape(after[trace_of(tmp_path / "parts", name)])
        assert set(rows) <= set(want[name]) and len(set(rows)) == len(rows) and len(rows) > len(want[name]) / 4, name
    assert shape(after[trace_of(tmp_path / "parts", "rotated")]) == want["rotated"] and shape(after[trace_of(tmp_path / "parts", "lost")]) == want["lost"]
    assert {f for _, f, *_, flags, _ in want["lost"] if flags & S.GAP} == {"a", "b", "c"}
