"""Near-dups, repeated stretches and page text against brute force, with awkward rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import fm, language, neardup_text, neardup_vectors, pages, passages, substrings
from spanloom.llm.components import components

ID_TEXT = "doc_id bigint, text string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def smallest_reachable(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    want = smallest_reachable({x for l in links for x in l}, links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got.get(n, n) == c for n, c in want.items())
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 12))
    near = np.repeat(base[:6], 30, axis=0) + rng.standard_normal((180, 12)) * 0.12
    x = [v.tolist() for v in np.concatenate((base, near, np.repeat(base[:1], 50, axis=0), base[:3] * 7.5))]
    odd = [None, [], [0.0] * 12, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, [1.0, 2.0], [1.0, 2.0]]
    rows = [(i, v, 0) for i, v in enumerate(x + odd)] + [(None, [1.0] * 12, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    ok = [(i, np.array(v)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(i, j) for n, (i, a) in enumerate(ok) for j, b in ok[:n] if len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.95]
    label = smallest_reachable([r[0] for r in rows if r[0] is not None], links)
    n = dict.fromkeys(label, 0)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    want = sorted([(i, n[i], c, i == c) for i, c in label.items()] + [(None, 0, None, True)], key=str)
    assert rows_of(neardup_vectors.near_dups(df)) == want
    few = lambda d: neardup_vectors.near_dups(d, block=16)
    assert rows_of(few(df.withColumn("cell", F.lit(1)).withColumn("n", F.lit("x")))) == want  # blocks and clashing names
    assert rows_of(neardup_vectors.near_dups(df.limit(0))) == []
    assert rows_of(neardup_vectors.near_dups(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id bigint, embedding array<double>"))) == [(1, 1, 1, True)] * 2


def test_visits_lose_no_link(spark):
    """Vectors of many cells: every link is found, whichever cells its ends lie in."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    u = x / np.sqrt((x * x).sum(1))[:, None]
    n = (u @ u.T >= 0.95).sum(1) - 1
    cell, neardup_vectors.fit.__defaults__ = neardup_vectors.fit.__defaults__, (20_000, 15, 4096)
    try:
        got = {r.vec_id: r.n_links for r in neardup_vectors.near_dups(df).collect()}
    finally:
        neardup_vectors.fit.__defaults__ = cell
    assert got == dict(enumerate(n.tolist()))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def five(t):
    w = [x.lower() for x in (t or "").split()]
    return [tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def test_alignment_against_plain_dynamic_programming():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randrange(12) for _ in range(rng.randint(1, 60))]
        b = list(a)
        for _ in range(rng.randrange(8)):
            p = rng.randrange(len(b)) if b else 0
            b[p:p + rng.randrange(2)] = [rng.randrange(12)] * rng.randrange(2)
        if b:
            m = lcs(a, b)
            s = m / (len(a) + len(b) - m)
            got = neardup_text.similarity(np.array(a, np.uint64), np.array(b, np.uint64), 0.8)
            assert got == pytest.approx(s) if s >= 0.8 else got < 0.8


def test_exactly_the_least_similarity_is_enough():
    """4k shingles wholly contained in 5k: M / (a + b - M) is 0.8 at every k."""
    for k in range(1, 2001):
        b = np.arange(5 * k, dtype=np.uint64)
        for a in (b[:4 * k], b[k:]):
            assert neardup_text.similarity(a, b, 0.8) == 0.8 == neardup_text.similarity(b, a, 0.8), k
        assert neardup_text.similarity(b[:4 * k - 1], b, 0.8) < 0.8


def test_texts_cut_off_at_an_end_are_linked(spark):
    rows = []
    for n, k in enumerate((7, 13, 26, 27, 52, 60, 103)):
        words = [f"w{n}x{i}" for i in range(5 * k + 4)]
        rows += [(10 * n, " ".join(words)), (10 * n + 1, " ".join(words[:4 * k + 4])), (10 * n + 2, " ".join(words[:4 * k + 3]))]
    got = {r.doc_id: r.class_id for r in neardup_text.near_dups_query(spark.createDataFrame(rows, ID_TEXT)).collect()}
    assert all(got[i] == i // 10 * 10 for i in got), got


@pytest.fixture(scope="module")
def near(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        for k in range(5):
            t = list(base)
            for _ in range(k):
                t[rng.randrange(len(t))] = "changed"
            rows.append((len(rows), " ".join(t)))
    rows += [(100, rows[0][1]), (101, rows[0][1].upper()), (102, None), (103, ""), (104, " \n"), (105, "a b"), (106, "a  B"), (107, "a b c"), (108, " ".join(reversed(rows[0][1].split()))),
             (109, "long " * 30000), (110, "long " * 30000), (3, rows[3][1]), (None, rows[0][1])]
    return rows, spark.createDataFrame(rows, ID_TEXT)


def test_texts_nothing_asks_for_are_not_shuffled(spark):
    rows = spark.range(-500, 4500).select(F.when(F.col("id") != 7, F.col("id")).alias("rep"), F.col("id").cast("string").alias("t"))
    ask = spark.createDataFrame([(i,) for i in [-500, -1, 0, 3, 4499, None, 10 ** 17]], "rep bigint")
    got = {r.rep for r in neardup_text.likely(rows, ask).collect()}
    assert {-500, -1, 0, 3, 4499} <= got and len(got) < 20
    assert neardup_text.likely(rows, ask.limit(0)).count() == 0


def test_sequences_of_repeated_ids(spark):
    """An id with several texts, a text under several ids: one sequence for each text asked for."""
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "m n"), (None, "m n")], ID_TEXT)
    sig = {r.id: r.h1 for r in neardup_text.signatures(docs.where("text <> 'g h i j k l' and doc_id is not null"), "doc_id", "text", 2, 2).collect()}
    ask = spark.createDataFrame([(sig[1], 1), (sig[3], 3)], "h1 bigint, rep bigint")
    got = {r.h1: len(r.sh) // 8 for r in neardup_text.sequences_of(docs, "doc_id", "text", ask).collect()}
    assert got == {sig[1]: 2, sig[3]: 1}


def test_text_near_dups(spark, near):
    rows, df = near
    seqs = {i: five(t) for i, t in rows if i is not None}
    links = []
    for i, a in seqs.items():
        for j, b in seqs.items():
            if j < i and a and b and min(len(a), len(b)) / max(len(a), len(b)) >= 0.8:
                m = len(a) if a == b else lcs(a, b) if len(a) < 1000 else 0
                if m / (len(a) + len(b) - m) >= 0.8:
                    links.append((i, j))
    want = smallest_reachable(list(seqs), links)
    got = neardup_text.near_dups_query(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got} == {**want, None: None}
    assert neardup_text.near_dups_query(df.limit(0)).count() == 0
    clash = df.withColumn("id", F.lit("own")).withColumn("h1", F.lit("own")).withColumn("class_id", F.lit("own"))
    kept = neardup_text.keep_first(clash)
    assert kept.columns == clash.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, c in want.items() if i == c)


def test_index_search_and_location():
    rng = np.random.default_rng(6)
    seq = rng.integers(0, 6, 500)
    seq[-1] = 0
    index = fm.FMIndex(seq, 5)
    for _ in range(50):
        p = rng.integers(1, 6, rng.integers(1, 6))
        row = np.concatenate((np.zeros(6 - len(p), np.int64), p))[None, :]
        _, lo, hi = index.search(row, np.array([len(p)]))
        places = sorted(index.locate(fm.expand(lo, hi)[0]).tolist()) if len(lo) else []
        assert places == [i for i in range(len(seq) - len(p) + 1) if (seq[i:i + len(p)] == p).all()]


@pytest.fixture(scope="module")
def shared(spark):
    rng = random.Random(8)
    some = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))
    passage, line = some(70), some(25)
    rows = [(i, some(rng.randint(0, 60)) + (" " + passage[rng.randrange(40):] if i % 3 == 0 else "") + "\n" + some(9) + (("\t" + line) * (i % 4))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "  \n "), (53, "x " * 300), (54, "x " * 90), (55, rows[0][1]), (56, rows[0][1]), (3, rows[3][1]), (57, passage + " " + passage), (None, passage),
             (58, "é" * 200), (59, "é" * 120), (60, some(30) + " " + "z" * 200), (61, rows[9][1][:400] * 40)]
    return rows, spark.createDataFrame(rows, ID_TEXT)


def test_bytes(spark, shared):
    rows, df = shared
    order = lambda i: -1 if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p:p + 50]] = min(order(i), first.get(b[p:p + 50], 1 << 60))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < order(i):
                gone[p:p + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    assert rows_of(substrings.substrings_query(df.withColumn("g", F.lit(1)))) == sorted(want, key=str)
    assert substrings.substrings_query(df.limit(0)).count() == 0


def test_words(spark, shared):
    rows, df = shared
    order = lambda i: -1 if i is None else i
    first = {}
    text = lambda t: [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in t or "").split(" ") if w]
    for i, t in rows:
        w = text(t)
        for p in range(len(w) - 19):
            k = tuple(w[p:p + 20])
            first[k] = min((order(i), p), first.get(k, (1 << 60, 0)))
    want = []
    for i, t in rows:
        w = text(t)
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if first[tuple(w[p:p + 20])] < (order(i), p):
                gone[p:p + 20] = [True] * 20
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    assert rows_of(passages.passages_query(df.withColumn("id", F.lit(1)))) == sorted(want, key=str)
    assert passages.passages_query(df.limit(0)).count() == 0


PAGE = """<html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie">We use cookies</div>
<article><h1>A &amp; B</h1><p>First <b>bold</b>ed text&nbsp;here.<br>Next<p>Second   one</p><div class="ad">Buy now</div></article><aside>More</aside><section class="comments"><p>Nice read</p></section><footer>(c)</footer></body></html>"""


def test_pages(spark):
    many = [(i, "u", PAGE.replace("Second", f"Second {i}")) for i in range(20)]
    rows = many + [(30, None, None), (31, "u", ""), (32, "u", "<"), (33, "u", "<p"), (34, "u", "<div><p>x</div></p></p><!-- "), (35, "u", "<script>never closed"), (36, "u", "<article>" + "<p>word one</p>" * 3000 + "</article>"), (5, "u", many[5][2])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("score", F.lit(1))
    got = pages.pages_query(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id < 20:
            assert r.text == f"A & B\n\nFirst bolded text here. Next\n\nSecond {r.page_id} one"
        if r.page_id in (30, 31, 35):
            assert r.text == ""
        if r.page_id == 36:
            assert r.text == "\n\n".join(["word one"] * 3000)
    assert pages.pages_query(df.limit(0)).count() == 0


def test_formulas_images_and_unclosed_elements():
    texts = lambda page: [t for _, t, _ in pages.blocks(page)]
    assert texts("<p>Let <math><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation encoding='tex'>x=1</annotation></math> be</p>") == ["Let x=1 be"]
    assert texts("<p>a<math><mspace width='1'/><mi>b</mi></math>c</p><p>d</p>") == ["abc", "d"]
    for inner in ("<img src='x'>", "<svg><text>no</text></svg>", "<svg/>", "<canvas>no</canvas>", "<object data='x'>no</object>"):
        assert texts(f"<p>One {inner} two</p><p>three</p>") == ["One two", "three"], inner
        assert texts(f"<p>One{inner}two</p>") == ["One two"], inner
    for tag in ("object", "canvas", "math", "template", "noscript", "svg"):
        assert " ".join(texts(f"<p>One</p><p><{tag}>two</p><p>three</p>")) == "One two three", tag
    for tag in ("script", "style", "textarea", "title", "iframe"):
        assert texts(f"<p>One</p><{tag}>two<p>three</p>") == ["One"], tag


def test_labeller_gradient():
    rng = np.random.default_rng(0)
    m = pages.Labeller()
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    d = pages.PATH_DIM + pages.WORD_DIM + pages.SHAPE_DIM
    x, y = rng.standard_normal((5, 3, d)), rng.integers(0, 2, (5, 3)).astype(float)
    mask = np.ones((5, 3), bool)
    mask[3:, 1] = False
    loss = lambda: -np.sum(np.where(mask, y * np.log(m.forward(x, mask)[0]) + (1 - y) * np.log(1 - m.forward(x, mask)[0]), 0)) / mask.sum()
    grad = m.gradients(x, mask, y)
    for k in ("xf", "hb", "bf", "o"):
        at = (1,) * m.w[k].ndim
        m.w[k][at if k != "o" else (3, 0)] += 1e-4
        up = loss()
        m.w[k][at if k != "o" else (3, 0)] -= 2e-4
        down = loss()
        m.w[k][at if k != "o" else (3, 0)] += 1e-4
        assert grad[k][at if k != "o" else (3, 0)] == pytest.approx((up - down) / 2e-4, abs=1e-4)


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dups", "decontamination", "mixing", "sharding"]
    out = corpus_pipeline.run(spark, sf)
    assert out.columns[:5] == docs.columns
    rows = out.collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    classes = {r.doc_id: r for r in neardup_text.near_dups_query(language.keep_known(docs)).collect()}
    assert all(classes[r.doc_id].kept for r in rows)
    sure = {r.doc_id for r in docs.collect()} & set(classes)
    assert len({r.doc_id for r in rows}) > 0.5 * sum(classes[i].kept for i in sure)
