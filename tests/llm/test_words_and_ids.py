"""Language ID, decontamination, sharding, mixing and chats against plain Python, with awkward rows."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from spanloom.llm import chat, decontaminate, language, mixing, shards

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EN = "the house and the garden with this water that they have from where there"
DE = "und der garten mit dem wasser das sie haben von dort wo ein haus nicht ist"


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(40):
        words = (EN if i % 2 else DE).split()
        rows.append((i, " ".join(words[i % 7:] + words[:i % 7] + [f"w{i}"]), "en" if i % 2 else "de", f"s{i % 3}", 0))
    rows += [(40, None, "en", None, 0), (41, "", None, "s0", 0), (42, " \t\n", "de", "s1", 0), (43, "123 ... 456", "en", "s1", 0),
             (44, "the " * 9000, "en", "s2", 0), (45, "Ünï çödé 漢字 ﬁ İ", None, "s2", 0), (1, rows[1][1], "en", "s1", 0), (None, "the house", "en", "s0", 0)]
    return spark.createDataFrame(rows, DOCS)


def test_language(spark, docs):
    got = {(r.doc_id, r.held_out): r for r in language.language_query(docs).collect()}
    assert sum(1 for _ in got) == 47  # the repeated row has the same answer
    for (i, held), r in got.items():
        if i is not None:
            assert held == (zlib.crc32(str(i).encode()) % 4 == 2)
        if i is not None and i < 40:
            assert r.lang_pred == ("en" if i % 2 else "de")
        assert 0 <= r.score <= 1
        if i in (40, 41, 42, 43):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert language.language_query(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.language_query(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    clash = docs.withColumn("pred", F.lit(1)).withColumn("score", F.lit("x"))
    kept = language.keep_known(clash)
    assert kept.columns == clash.columns and kept.count() == docs.count() - 4


def rank_order(text, profiles):
    s = re.sub(r"[^a-zäöüßﬁçï漢字éèê]+", "_", "_" + text.lower() + "_")
    n = {}
    for k in (1, 2, 3):
        for i in range(len(s) - k + 1):
            g = s[i:i + k]
            if g[1:-1].count("_") == 0 and g.strip("_"):
                n[g] = n.get(g, 0) + 1
    return n


def test_grams_against_plain_counting(spark):
    import numpy as np
    texts = ["the house, the!", "a", "", "bb  bb-b"]
    raw = "".join(texts).encode()
    off = np.cumsum([0] + [len(t.encode()) for t in texts])
    row, gram, n = language.gram_counts(np.frombuffer(raw, np.uint8), off)
    for i, t in enumerate(texts):
        want = rank_order(t, None)
        assert sorted(n[row == i].tolist()) == sorted(want.values())


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = language.language_query(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r > 0.97


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def contamination(docs, items):
    out = []
    for i, t in docs:
        w, hit, got = words(t), set(), set()
        for name, x in items:
            b = words(x)
            for s in range(max(1, len(b) - 12)) if b else ():
                win = b[s:s + 13]
                for p in range(len(w) - len(win) + 1):
                    if w[p:p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        got.add(str(name))
        out.append((i, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_decontamination(spark):
    long = " ".join(f"b{i}" for i in range(30))
    items = [(1, long), (2, "Short item here"), (2, "Short item here"), (10, "one"), (3, None), (4, " .. "), (5, " ".join(["rep"] * 15))]
    text = [(1, "x " + long.upper() + " y"), (2, " ".join(long.split()[:13])), (3, " ".join(long.split()[:12])), (4, None), (5, ""), (6, "a SHORT, item: here b one two"),
            (7, "rep " * 40), (8, " ".join(long.split()[5:20]) + " " + "z " * 500), (9, "nothing"), (9, "nothing"), (None, "one one")]
    d = spark.createDataFrame(text, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(decontaminate.decontamination_query(d, b)) == contamination(text, items)
    blocks = decontaminate.find_benchmark(d, b, block_bytes=40)  # several passes, same result
    assert rows(blocks.select("doc_id", "n_words", "n_hit")) == sorted([x[:3] for x in contamination(text, items)], key=str)
    assert rows(decontaminate.decontamination_query(d, b.limit(0)).select("n_hit")) == [(0,)] * len(text)
    assert decontaminate.decontamination_query(d.limit(0), b).count() == 0
    clash = d.withColumn("contaminated", F.lit("mine")).withColumn("items", F.lit(3))
    kept = decontaminate.keep_clean(clash, b)
    assert kept.columns == clash.columns and {r.contaminated for r in kept.collect()} == {"mine"}


def test_sharding(spark, docs):
    got = shards.shards_query(docs).collect()
    assert len(got) == docs.count() and {r.law for r in got} == {"bytes"}
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(16))
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        b = (text[r.doc_id] or "").encode()
        assert r.size == len(b) + 1 and r.text_crc32 == zlib.crc32(b)
    assert shards.shards_query(docs.limit(0)).count() == 0


def test_sharding_balances_a_hot_text_and_keeps_small_groups(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2500, "the same text").otherwise(F.concat(F.lit("t"), (F.col("id") % 1700).cast("string"))).alias("text"))
    got = shards.shard(rows, slice_rows=200).toPandas()
    size = got.assign(n=got.text.str.len() + 1).groupby("shard").n.sum()
    assert len(size) == 16 and size.max() / size.min() < 1.06
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    spread = got[got.text != "the same text"].groupby("text").shard.nunique()
    assert (spread > 1).sum() <= 15


def test_mixing(spark, docs):
    got = mixing.mixing_query(docs).toPandas()
    assert len(got) == docs.count()
    src = docs.select("doc_id", "source").toPandas()
    total = got["size"].sum()
    m = got.merge(src.drop_duplicates("doc_id"), on="doc_id")
    goal, free, left = {}, {s: (w, m[m.source == s]["size"].sum() if s else m[m.source.isna()]["size"].sum()) for s, w in zip(["s0", "s1", "s2", None], [1, 2, 3, 1])}, total
    while True:
        share = {s: left * w / sum(x for x, _ in free.values()) for s, (w, _) in free.items()}
        over = [s for s in free if share[s] > 3 * free[s][1]]
        if not over:
            goal.update(share)
            break
        for s in over:
            goal[s] = 3 * free[s][1]
            left -= goal[s]
            del free[s]
    for s in ("s0", "s1", "s2"):
        part = m[m.source == s]
        assert abs(part.target.max() - goal[s]) < 1e-6 * total
        biggest = part["size"][part["size"] < 5000].max()
        assert abs(part.taken.sum() - goal[s]) <= max(biggest, 9000 if s == "s2" else 0)
    assert ((got.taken <= 3 * got["size"]) & (got.taken >= 0)).all()
    again = mixing.mixing_query(docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert again[key].sort_values(key).values.tolist().__repr__() == got[key].sort_values(key).values.tolist().__repr__()
    assert mixing.mixing_query(docs.limit(0)).count() == 0
    clash = docs.withColumn("size", F.lit("mine")).withColumn("rate", F.lit(0))
    out = mixing.mix_documents(clash)
    assert out.columns == clash.columns and {r["size"] for r in out.collect()} == {"mine"}


def plain_chats(rows):
    convs = {}
    for c, t, role, text in rows + [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = []
    for c, ts in convs.items():
        ts.sort()
        said = "".join(f"{r}\n{x}\n" for *_, r, x in ts)
        loss = "".join(x for *_, r, x in ts if r == "assistant")
        out.append((c, len(ts), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nlook <\\| <\\\\| back"), (2, 1, "assistant", None), (2, 0, None, ""), (3, None, "a\n%b%0A", "x\n"),
            (4, 0, "user", "same"), (4, 0, "user", "same"), (5, 0, "assistant", "é漢\U0001F600" * 20000), (None, 0, "user", "no id"), (6, 0, "assistant", "%0A%25\\"), (7, 0, "<|im_end|>", "role")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat.chats_query(df.withColumn("parts", F.lit(1)).withColumn("head", F.lit("x"))).drop("formatted_chars")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_chats(rows)
    assert chat.chats_query(df.limit(0)).count() == 1


def test_chat_parts(spark):
    part = lambda k, t=None, r=None, u=None: (k, t, r, u)
    rows = [(1, 0, "user", [part("text", "see "), part("image", r="a.png", u=256), part("text", "<|image|>"), part("audio", r="b.wav", u=1001), part(None, "?")]), (1, 1, "assistant", None), (1, 2, "assistant", [part("document", r="c.pdf", u=2), part("text", "ok")])]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    r = chat.format_chats(df).first()
    assert r.formatted == "<|im_start|>user\nsee <|image|><\\|image|><|audio|>?<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n<|im_start|>assistant\n<|document|>ok<|im_end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 256), ("audio", "b.wav", 26), ("document", "c.pdf", 1024)]
    assert all(r.formatted[a.position:].startswith(f"<|{a.kind}|>") for a in r.attachments) and r.attachment_tokens == 1306
    assert [r.formatted[s.start:s.start + s.length] for s in r.loss_spans] == ["", "<|document|>ok"]


def test_mix_makes_no_rows(spark):
    """Nulls that swap places between id, source and text are different rows; repeats stay as many as they are."""
    rows = [(1, "a b c", "web"), (1, "web", None), (1, None, "web"), (2, "q r s t", "web"), (2, "q r s t", "news")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mixing_query(df).collect()
    assert sorted((r.doc_id, r["size"], r.source_size) for r in got) == [(1, 0, 7), (1, 1, 1), (1, 3, 7), (2, 4, 4), (2, 4, 7)]
    values = {"doc_id": [None, 1, 2], "text": [None, "", "1", "web", "a b"], "source": [None, "", "1", "web"]}
    every = [(i, t, s) for i in values["doc_id"] for t in values["text"] for s in values["source"]]
    many = spark.createDataFrame([*every, *every, *rows], "doc_id bigint, text string, source string").withColumn("it", F.lit(1)).withColumn("of", F.lit(2))
    mixed = mixing.mix(many)
    assert mixed.count() == 2 * len(every) + len(rows)
    per = {}
    for r in mixed.collect():
        per.setdefault((r.doc_id, r.text, r.source), set()).add((r["size"], r.copies, r.target, r.source_size))
    assert all(len(v) == 1 for v in per.values()) and len(per) == len({*every, *rows})
    total = {s: sum(len((t or "").split()) for _, t, q in [*every, *every, *rows] if q == s) for s in [*values["source"], "news"]}
    assert all(r.source_size == total[r.source] for r in mixed.collect())
