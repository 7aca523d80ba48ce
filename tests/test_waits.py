"""Traces without stamps: lines wait for their CPU and for their task, against a plain line-by-line simulation."""

import random

import pytest

from spanloom.operators.waits import longest_paths


def plain_paths(n, edges):
    value = [0.0] * n
    for node in range(n):
        value[node] = max([value[s] + w for d, s, w in edges if d == node], default=0.0)
    return value


def test_longest_paths_against_plain_order(spark):
    rng = random.Random(1)
    nodes, edges, size = [], [], {"chain": 60, "graph": 60, "wide": 40, "one": 1}
    for trace, n in size.items():
        links = {"chain": (1, 1), "wide": (0, 6)}.get(trace, (0, 3))
        nodes += [(trace, i) for i in range(n)]
        edges += [(trace, d, rng.randrange(max(0, d - 9), d), float(rng.randint(-2, 9))) for d in range(1, n) for _ in range(rng.randint(*links))]
    got = {(r.trace_id, r.node): r.value for r in longest_paths(
        spark.createDataFrame(nodes, "trace_id string, node bigint"),
        spark.createDataFrame(edges, "trace_id string, node bigint, source bigint, weight double")).collect()}
    for trace, n in size.items():
        assert [got[trace, i] for i in range(n)] == pytest.approx(plain_paths(n, [e[1:] for e in edges if e[0] == trace]))
    assert len(got) == len(nodes)


class Printer:
    """Prints lines of tasks on CPUs and keeps the clocks that a reader of these lines keeps."""

    def __init__(self):
        self.lines, self.start, self.cpu, self.task, self.stack = [], {}, {}, {}, {}

    def _line(self, cpu, task, dur, depth, text):
        took = f"{dur:10.3f} us" if dur is not None else " " * 13
        self.lines.append(f" {cpu})  t-{task}  | {took} |  {'  ' * depth}{text}")

    def now(self, cpu, task):
        return max(self.cpu.get(cpu, 0.0), self.task.get(task, 0.0))

    def open(self, cpu, task, name):
        t = self.now(cpu, task)
        stack = self.stack.setdefault(task, [])
        self._line(cpu, task, None, len(stack), f"{name}() {{")
        stack.append((name, t))
        self.start[name] = self.cpu[cpu] = self.task[task] = t

    def leaf(self, cpu, task, name, dur):
        t = self.now(cpu, task)
        self._line(cpu, task, dur, len(self.stack.setdefault(task, [])), f"{name}();")
        self.start[name] = t
        self.cpu[cpu] = self.task[task] = t + dur

    def close(self, cpu, task, dur=None, more=0.0, printed=True):
        name, t = self.stack[task].pop()
        dur = round(self.now(cpu, task) - t + more, 3) if dur is None else dur
        self._line(cpu, task, dur if printed else None, len(self.stack[task]), "}")
        self.cpu[cpu] = max(self.cpu.get(cpu, 0.0), t + dur)
        self.task[task] = t + dur
        return dur


FIXED = {
    "a task waits for itself on another CPU": (
        [" 0)  a-1  |   50.0 us   |  first();", " 1)  b-2  |    5.0 us   |  other();", " 1)  a-1  |    1.0 us   |  second();", " 1)  b-2  |    1.0 us   |  third();"],
        {"first": 0, "other": 0, "second": 50, "third": 51}),
    "a CPU waits for a call that was entered elsewhere": (
        [" 0)  a-1  |               |  schedule() {", " 0)  b-2  |   10.0 us   |  x();", " 1)  a-1  |   80.0 us   |  }", " 1)  c-3  |    1.0 us   |  y();", " 0)  b-2  |    1.0 us   |  z();"],
        {"schedule": 0, "x": 0, "y": 80, "z": 10}),
    "while f sleeps another task runs": (
        [" 0)  a-1  |               |  f() {", " 0)  a-1  |    1.0 us   |    g();", " 0)  b-2  |    5.0 us   |  x();", " 0)  a-1  |    2.0 us   |    h();", " 0)  a-1  |    8.0 us   |  }"],
        {"f": 0, "g": 0, "x": 1, "h": 6}),
    "what f calls slides back where f printed less": (
        [" 0)  a-1  |               |  f() {", " 0)  a-1  |    1.0 us   |    g();", " 0)  b-2  |    5.0 us   |  x();", " 0)  a-1  |    2.0 us   |    h();", " 0)  a-1  |    7.0 us   |  }",
         " 0)  b-2  |    5.0 us   |  y();"],
        {"f": 0, "g": 0, "x": 1, "h": 5, "y": 8}),
    "a call that printed no duration spans its waits": (
        [" 0)  a-1  |               |  f() {", " 0)  b-2  |    5.0 us   |  x();", " 0)  a-1  |    2.0 us   |    h();", " 0)  a-1  |               |  }"],
        {"f": 0, "x": 0, "h": 5}),
    "lines before the first banner belong to the task it switches from": (
        [" 0)   40.0 us   |  early();", " 0)    a-1     =>    b-2   ", " 1)   2.0 us    |  late();", " 1)    a-1     =>    c-3   ", " 1)   1.0 us    |  last();"],
        {"early": 0, "late": 40, "last": 42}),
    "calls without an entry or an end": (
        [" 0)  a-1  |    4.0 us   |      x();", " 1)  a-1  |    9.0 us   |    }  /* o */", " 1)  a-1  |               |  left() {", " 0)  b-2  |   20.0 us   |  y();",
         " 0)  a-1  |    1.0 us   |    z();"],
        {"x": 0, "o": 0, "left": 0, "y": 4, "z": 24}),
    "nothing waits": ([" 0)  a-1  |   5.0 us  |  p();", " 0)  a-1  |   1.0 us  |  q();"], {"p": 0, "q": 5}),
}


def random_trace(rng, n_cpus, n_tasks, steps):
    p, n = Printer(), 0
    for _ in range(steps):
        cpu, task = rng.randrange(n_cpus), rng.randint(1, n_tasks)  # pid 0 would be a task per CPU
        for _ in range(rng.randint(1, 6)):
            depth = len(p.stack.get(task, []))
            n += 1
            if depth and rng.random() < 0.35:
                p.close(cpu, task, more=rng.choice([0.0, 1.5]))
            elif depth < 5 and rng.random() < 0.5:
                p.open(cpu, task, f"f{n}")
            else:
                p.leaf(cpu, task, f"f{n}", rng.randint(1, 9) / 2)
    for task, stack in p.stack.items():
        while stack:
            p.close(rng.randrange(n_cpus), task)
    return p


def test_starts_against_fixed_answers_and_the_simulation(lines):
    from spanloom.operators.assemble import assemble
    from spanloom.operators.ordered import union_all
    from spanloom.sources.tokens import tokenize

    want, text = {(name, f): t for name, (_, starts) in FIXED.items() for f, t in starts.items()}, {name: rows for name, (rows, _) in FIXED.items()}
    for seed, (n_cpus, n_tasks) in enumerate([(2, 3), (3, 3), (1, 4), (4, 2), (2, 2), (3, 6)]):
        p = random_trace(random.Random(seed), n_cpus, n_tasks, 25)
        text[f"random {seed}"] = p.lines
        want |= {(f"random {seed}", f): t for f, t in p.start.items()}
    spans = assemble(tokenize(union_all([lines(rows, name) for name, rows in text.items()]))).spans.collect()
    got = {(r["trace_id"], r["func"]): r["start_us"] for r in spans}
    assert {k: got[k] for k in want} == pytest.approx(want, abs=1e-5)
    assert {r["dur_us"] for r in spans if r["trace_id"].startswith("a call that printed no") and r["func"] == "f"} == {7}
