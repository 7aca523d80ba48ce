"""The plans users run, with code generation on: random call trees against a stack."""

import random

import pytest

from spanloom.operators.assemble import assemble
from spanloom.operators.times import span_times
from spanloom.sources.tokens import tokenize


@pytest.fixture
def generated(spark):
    keys = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def grow(rng, out, calls, parent, depth):
    """Lines of one call and what a stack makes of them; returns its duration in ns."""
    at, func, pad = len(out), f"f{rng.randrange(6)}", "  " * depth
    kids = rng.choice([0, 0, 1, 2, 3]) if depth < 6 else 0
    out.append(None)
    calls[at] = None
    if kids == 0:
        ns = rng.randrange(100, 9000)
        out[at] = f" 0) {ns / 1000:10.3f} us    |  {pad}{func}();"
    else:
        out[at] = f" 0)               |  {pad}{func}() {{"
        inside = sum(grow(rng, out, calls, at, depth + 1) for _ in range(kids))
        ns = inside + rng.randrange(100, 900)
        out.append(f" 0) {ns / 1000:10.3f} us    |  {pad}}}")
        calls[at] = (func, depth, parent, ns, ns - inside)
        return ns
    calls[at] = (func, depth, parent, ns, ns)
    return ns


def test_random_trees_against_a_stack(lines, generated):
    rng, out, calls = random.Random(9), [], {}
    while len(out) < 700:
        grow(rng, out, calls, None, 0)
    t = assemble(tokenize(lines(out)))
    got = {r.span_id: (r.func, r.depth, r.parent_id, round(r.dur_us * 1000)) for r in t.spans.collect()}
    assert got == {k: v[:4] for k, v in calls.items()}
    own = {r.span_id: round(r.self_us * 1000) for r in span_times(t.spans).collect()}
    assert own == {k: v[4] for k, v in calls.items()}
