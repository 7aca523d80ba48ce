"""Whitening, importance resampling and token files against plain numpy, plain Python and exact round trips, with awkward rows."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import crc, importance, rans, token_files, whitening

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")


# ---- whitening ----------------------------------------------------------------

def plain_whitening(x, k):
    n = len(x)
    xc = (x * n - x.sum(0)) / n
    cov = xc.T @ xc / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    k = min(k, int((e > 1e-18 * np.trace(cov)).sum()))
    return xc @ q[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(cov)


def check_whitening(rows, x, ids, k=32):
    want, explained = plain_whitening(x, k)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(got) == want.size
    n, sums = len(x), x.sum(0)
    w = np.array([[got[i, c + 1].whitened for c in range(want.shape[1])] for i in ids])
    w *= np.sign((w * want).sum(0))
    assert np.abs(w - want).max() < 1e-8
    for i, row in zip(ids, x):
        for c in range(want.shape[1]):
            r = got[i, c + 1]
            assert r.n == n and r.deviation == sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums))
            assert r.explained == pytest.approx(explained[c], rel=1e-9) and r.identity_error < 1e-9


def test_whitening_of_the_whole_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in df.collect()}
    ids = sorted(vectors)
    x = np.array([[math.floor(64 * float(v)) + 1_000_000 for v in vectors[i]] for i in ids])
    check_whitening(whitening.whitening_query(df).collect(), x, ids)


@pytest.mark.parametrize("block", [1, 3, 8])
def test_blocks_of_directions_agree(spark, block):
    """Clustered and repeated eigenvalues, a constant and a doubled dimension; the classical form is a block of one."""
    rng = np.random.default_rng(5)
    x = np.rint(rng.standard_normal((300, 10)) * [900, 900, 500, 20, 20, 20, 3, 1, 1, 0]).astype(np.int64) + 1_000_000
    x[:, 8] = 2 * x[:, 0] - 1_000_000
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<bigint>")
    model = whitening.fit_rows(rows, 300, 10, 32, block)
    want, explained = plain_whitening(x, 32)
    assert len(model.eigenvalues) == want.shape[1] == 8
    assert np.allclose(model.eigenvalues / model.trace, explained, rtol=1e-9) and model.identity_error < 1e-8
    w = (x - x.mean(0)) @ model.components / np.sqrt(model.eigenvalues)
    assert np.abs(w.T @ want / 300 - np.diag(np.diag(w.T @ want / 300))).max() < 1e-5


def test_few_of_many_dimensions_converge_early(spark):
    rng = np.random.default_rng(6)
    x = np.rint(rng.standard_normal((400, 60)) * 2.0 ** -np.arange(60) * 2 ** 24).astype(np.int64)
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<bigint>")
    model = whitening.fit_rows(rows, 400, 60, 4, 4)
    _, explained = plain_whitening(x, 4)
    assert np.allclose(model.eigenvalues / model.trace, explained, rtol=1e-9)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 3.5]), (2, [0.5, -2.0, 1.0]), (3, [0.0, 0.0, 0.0]), (4, [4.0, 1.0, -1.0]), (5, [1.0, 2.0, 3.5])]
    bad = [(6, None), (7, [1.0, None, 2.0]), (8, [nan, 1.0, 1.0]), (9, [inf, 1.0, 1.0]), (10, []), (11, [1.0, 2.0]), (12, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "a") for i, v in good + bad], "vec_id bigint, embedding array<double>, x string")
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good])
    check_whitening(whitening.whitening_query(df).collect(), x, [i for i, _ in good])
    kept = whitening.whiten(df.withColumn("dims", F.lit(1)).withColumn("whitened", F.lit("old")))
    assert kept.columns == ["vec_id", "embedding", "x", "dims", "whitened"]
    rows = {r.vec_id: r for r in kept.collect()}
    assert set(rows) == {1, 2, 3, 4, 5} and rows[1].x == "a" and len(rows[1].whitened) == 3 and rows[1].whitened == rows[5].whitened
    assert whitening.whitening_query(df.limit(0)).collect() == []
    assert whitening.whitening_query(df.where("vec_id > 5 and vec_id not in (10, 11)")).collect() == []
    assert whitening.whitening_query(df.where("vec_id in (1, 5)")).collect() == []
    assert whitening.whiten(df.limit(0)).collect() == []
    assert {r.vec_id for r in whitening.whitening_query(df.where("vec_id in (1, 2)").withColumn("vec_id", F.lit(None).cast("bigint"))).collect()} == {None}


def test_deviation_beyond_64_bits_is_null():
    far = whitening.Centre(1 << 40, [0, 0])
    assert far.deviation(np.array([[1 << 10, 0], [1, 2]])).to_pylist() == [None, None]
    near = whitening.Centre(1 << 20, [0, 0])
    assert near.deviation(np.array([[1 << 10, 0], [1, 2]])).to_pylist() == [1 << 60, 5 << 40]
    edge = whitening.Centre(1 << 20, [0])
    assert edge.deviation(np.array([[1 << 11], [1 << 12]])).to_pylist() == [1 << 62, None]


# ---- importance resampling -----------------------------------------------------

def plain_importance(docs, target, words, buckets=10_000, percent=10, min_words=20):
    def feats(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return w, [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, words + 1) for i in range(len(w) - k + 1)]

    rows = [(i, *feats(t)) for i, t in docs]
    aims = [b for t in target for b in feats(t)[1]]
    s_all, t_all = sum(len(f) for _, _, f in rows), len(aims)
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, _, f in rows:
        np.add.at(s, f, 1)
    np.add.at(t, aims, 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, w, f in rows:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((len(w) >= min_words, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), i, len(f), weight))
    out.sort(key=lambda r: (not r[0], -r[1], r[2] is not None, r[2] or 0, r[4], r[3]))
    drawn = percent * sum(r[0] for r in out) // 100
    return sorted(((i, n, weight, score, p + 1 if p < drawn else None) for p, (_, score, i, n, weight) in enumerate(out)), key=str)


def awkward_texts():
    rng = random.Random(8)
    words = ["alpha", "Beta", "gamma", "don't", "x2", "Ünï", "çödé", "漢字", "1999", "the", "of", "İ"]
    rows = [(i, rng.choice([" ", "  ", "\n", ", "]).join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(80)]
    return rows + [(80, None), (81, ""), (82, " \t\n"), (83, "..."), (3, rows[3][1]), (3, "other words " * 30), (None, "the alpha " * 20), (84, "x" * 70_000 + " the " * 9000)]


@pytest.mark.parametrize("words", [1, 2, 3])
def test_importance_against_plain_python(spark, words, monkeypatch):
    docs, aims = awkward_texts(), ["the Alpha of gamma 1999", None, "", "x2 x2 çödé"]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    target = spark.createDataFrame([(a,) for a in aims], "text string")
    want = plain_importance(docs, aims, words)
    for piece in (importance.PIECE, 1 << 10):  # small pieces: texts are cut, dictionaries are many
        monkeypatch.setattr(importance, "PIECE", piece)
        monkeypatch.setattr(importance.chunks, "__defaults__", (piece,))
        got = importance.importance(df, target, "doc_id", "text", words=words).select("doc_id", "n_features", "weight", "score", "rank")
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_importance_edges(spark):
    df = spark.createDataFrame(awkward_texts(), "doc_id bigint, text string").withColumn("score", F.lit("old")).withColumn("buckets", F.lit(2))
    target = spark.createDataFrame([("the alpha",)], "text string")
    kept = importance.resample(df, target, percent=50)
    assert kept.columns == df.columns and kept.where("score = 'old' and buckets = 2").count() == kept.count()
    ranks = importance.importance_query(df, target).where("rank is not null").collect()
    assert sorted(r["rank"] for r in ranks) == list(range(1, len(ranks) + 1))
    assert importance.importance_query(df.limit(0), target).collect() == []
    assert sorted(map(tuple, importance.importance_query(df, target.limit(0)).collect()), key=str) == plain_importance(awkward_texts(), [], 1)


def test_importance_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = importance.importance_query(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(importance.ORACLE).fetchall())
    assert got.columns == names


def test_crc_of_joined_parts():
    rng = random.Random(9)
    for _ in range(100):
        parts = [rng.randbytes(rng.choice([0, 1, 7, 300, 70_000])) for _ in range(4)]
        left = np.array([zlib.crc32(b"".join(parts[:2]))], np.uint32)
        right = np.array([zlib.crc32(b"".join(parts[2:]))], np.uint32)
        assert crc.joined(left, right, np.array([len(parts[2]) + len(parts[3])]))[0] == zlib.crc32(b"".join(parts))


# ---- token files ---------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 262_143, 262_144, 262_145, 800_001])
def test_codec_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 5000).astype(np.uint32)
    t = rans.table(np.bincount(ids, minlength=5001))
    data = rans.pack(rans.Block(3, 4, 5, np.zeros((0, rans.DOC_FIELDS), np.int64), ids), t)
    block, end = rans.unpack(data, 0, t)
    assert end == len(data) and (block.shard, block.number, block.first) == (3, 4, 5) and np.array_equal(block.ids, ids)
    for lo, hi in ((0, 1), (n // 2, n // 2 + 700), (max(0, n - 3), n), (262_140, 262_150)):
        assert np.array_equal(rans.unpack(data, 0, t, lo, hi)[0].ids, ids[lo:hi])
    if n > 262_000:
        p = np.bincount(ids) / n
        bits = -(p[p > 0] * np.log2(p[p > 0])).sum() * n
        assert len(data) * 8 < bits * 1.01 + 8 * 2048 * 8 * (n / 262_144 + 2)


def test_tables():
    skewed = np.array([10 ** 12, 1, 0, 1])
    t = rans.table(skewed)
    assert t.freq.sum() == 1 << rans.BITS and t.freq[1] == t.freq[3] == 1 and t.freq[2] == 0
    many = rans.table(np.ones(1 << 19, np.int64) + (np.arange(1 << 19) == 7) * 10 ** 9)
    assert many.freq.sum() == 1 << rans.BITS and many.freq.min() == 1
    assert rans.table(np.zeros(5, np.int64)).freq.sum() == 0
    with pytest.raises(ValueError):
        rans.table(np.ones((1 << 20) + 1, np.int64))
    with pytest.raises(ValueError):
        rans.encode(np.array([2]), t)


def test_damage_is_found():
    ids = np.arange(3000, dtype=np.uint32) % 50
    t = rans.table(np.bincount(ids))
    data = rans.pack(rans.Block(0, 0, 0, np.zeros((0, rans.DOC_FIELDS), np.int64), ids), t)
    for broken in (data[:-1], data[:100] + bytes([data[100] ^ 1]) + data[101:], b"x" + data[1:], data[:10]):
        with pytest.raises(rans.Corrupt):
            rans.unpack(broken, 0, t)
    with pytest.raises(rans.Corrupt):
        rans.unpack(data, 0, rans.table(np.bincount(ids) + np.arange(50)))


PIECES = st.sampled_from([" ", "  ", "\n", "\t ", " \n", " ", "　 ", " ", "\x1c ", "\x85 ", "'s", "'ll", "don't", "a", "é", "漢", "12", "...", "<|endoftext|>", "", "!", "᠎ ", "\r\n "])
PLAIN = Tokenizer.from_file(BPE)
ENCODER = token_files.Encoder(open(BPE, encoding="utf-8").read(), 2)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.lists(PIECES, max_size=12).map("".join), st.text(max_size=30)), max_size=4))
def test_pieces_give_the_ids_of_whole_texts(texts):
    assert ENCODER.by_piece
    ids, n = ENCODER.encode(texts)
    want = [PLAIN.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_special_tokens_as_text():
    plain = Tokenizer.from_file(BPE)
    plain.encode_special_tokens = True
    encoder = token_files.Encoder(open(BPE, encoding="utf-8").read(), 2, special=True)
    texts = ["a b", "x <|endoftext|> y", "<|endoftext|>", "a <|endoftext|>b c"]
    for t in texts:
        ids, _ = encoder.encode([t])
        assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids + [2]


def test_other_tokenizers_get_whole_texts():
    words = public_tokenizers.path("word_bpe_49k.json")
    model = open(words, encoding="utf-8").read()
    encoder, plain = token_files.Encoder(model, 2), Tokenizer.from_file(words)
    assert not encoder.by_piece
    texts = ["The House  of words", "", "x"]
    ids, n = encoder.encode(texts)
    assert ids.tolist() == [i for t in texts for i in plain.encode(t, add_special_tokens=False).ids + [2]]


def plain_ids(docs):
    got = [(i, PLAIN.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in docs]
    order = lambda d: (d[0] is not None, d[0] or 0)
    return sorted(got, key=order)


def check_files(rows, docs):
    want = plain_ids(docs)
    rows = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [i for i, _ in want]
    sums = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=str) == sorted(((i, len(t), sums(t)) for i, t in want), key=str)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens


def test_token_files_of_a_whole_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    check_files(token_files.token_files_query(df, BPE).collect(), [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_awkward_token_files(spark, tmp_path, monkeypatch):
    docs = [*awkward_texts(), (-5, "<|endoftext|> andmore"), (None, "second without id"), (3, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("ids", F.lit("x")).withColumn("key", F.lit(1)).repartition(3)
    monkeypatch.setattr(rans, "BLOCK_IDS", 1000)  # documents over many blocks, blocks over many files
    monkeypatch.setattr(token_files, "FILE_BLOCKS", 3)
    folder = f"file://{tmp_path}/tokens"
    token_files.write_tokens(df, folder, BPE)
    check_files(token_files.document_sums(spark, folder).withColumnRenamed("key", "doc_id").collect(), docs)
    read = sorted(((r.key, r.ids) for r in token_files.document_ids(spark, folder).collect()), key=str)
    assert read == sorted(((i, ids) for i, ids in plain_ids(docs)), key=str)
    files = sorted((tmp_path / "tokens" / "blocks").glob("part-*"))
    assert len(files) > 3
    raw = bytearray(files[0].read_bytes())
    raw[len(raw) // 2] ^= 1
    files[0].write_bytes(raw)
    (files[0].parent / f".{files[0].name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="checksum"):
        token_files.document_sums(spark, folder).collect()
    assert token_files.token_files_query(df.limit(0), BPE).collect() == []
