"""MinHash near-dedup by Order MinHash.

A document is the sequence of its five-word shingles (words split at white space, A-Z lowered; fewer than five words are one
shingle). Shingles carry the number of their occurrence, so repeats count. Each of ``TABLES`` hash tables takes the
``KEPT`` labelled shingles with the least hashes and keeps them in text order: two documents share a table entry
with a probability that falls with edits and with changes of order. Documents that share an entry are candidates; they are
verified by a banded alignment of their shingle sequences. Similarity is aligned shingles over all shingles,
M / (a + b - M), 0.8 or more; as M >= 4/9 (a + b), places more than (a + b) / 9 apart can't be aligned, which
bounds the band.

Copies (equal word sequences) are made one first. Candidates of an entry are not paired with one another: each is
compared with a leader, the member that meets most others. Only where that leaves different components are members compared among
themselves, and only those that can reach the similarity with the shingles they share with any document still to compare. Components are the classes; the smallest id is kept.

Null, empty and blank texts have no shingles and are classes of their own, as are rows without an id. Repeated rows share a class, and
both are rows of the result; ``keep_first`` keeps one of them, with all columns under their own names. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import append, cut, mix64, not_space, pieces, prefix_hash, put_back, set_aside, span_hash, word_hashes, word_spans
from .components import components
from .repeats import pack, unpack

SHINGLE = 5
KEPT = 3
TABLES = 16
SIMILARITY = 0.8
#: documents of a component that a visitor is compared with at once
BLOCK = 256
#: bits of the hash by which texts are told apart from those nothing asks for
PASS_BITS = 25
GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all rows, their bounds per row, word hashes and word bounds per row."""
    start, end, words = word_spans(data, off, not_space())
    h = word_hashes(data, start, end, lower=True)
    n = np.diff(words)
    per = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    bounds = np.concatenate(([0], np.cumsum(per)))
    first = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - words[:-1], per)
    last = first + np.repeat(np.minimum(n, size), per)
    return span_hash(prefix_hash(h), first, last), bounds, h, words


def occurrence(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How often the same value stood before in the same row."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (v[1:] != v[:-1]))))
    out = np.empty(len(row), np.int64)
    out[order] = np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row))))
    return out


def sketches(sh: np.ndarray, bounds: np.ndarray, tables: int = TABLES, kept: int = KEPT) -> np.ndarray:
    """Rows x tables: hash of the ``kept`` least labelled shingles in text order. Every row has a shingle."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    labelled = mix64(sh + GOLD * occurrence(row, sh).astype(np.uint64))
    out = np.empty((n, tables), np.uint64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for t in range(tables):
        v = mix64(labelled ^ mix64(np.array([t + 1], np.uint64) * GOLD))
        spots = np.full((n, kept), len(sh), np.int64)
        for j in range(kept):
            low = np.minimum.reduceat(v, bounds[:-1])
            here = np.flatnonzero((v == low[row]) & (v != top))
            spots[row[here], j] = here
            v[here] = top
        spots.sort(axis=1)
        got = np.where(spots < len(sh), np.append(sh, np.uint64(0))[spots], np.uint64(1))
        acc = np.full(n, t + 1, np.uint64)
        for j in range(kept):
            acc = mix64(acc * GOLD + got[:, j])
        out[:, t] = acc
    return out


def signatures(docs: DataFrame, key: str, text: str, tables: int, kept: int) -> DataFrame:
    """(id, n, h1, h2, sketch): n shingles, a 128-bit hash of the word sequence, and the table entries (none for no words)."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in pieces(b.column(1)):
                sh, bounds, h, words = shingles(data, off)
                n = np.diff(bounds)
                full = np.flatnonzero(n > 0)
                entries = np.zeros((0, tables), np.uint64)
                if len(full):
                    entries = sketches(sh, np.append(bounds[full], bounds[-1]), tables, kept)
                h1 = span_hash(prefix_hash(h), words[:-1], words[1:])
                h2 = span_hash(prefix_hash(mix64(h + GOLD)), words[:-1], words[1:])
                to = np.concatenate(([0], np.cumsum(np.where(n > 0, tables, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(to), pa.array(entries.ravel().view(np.int64)))], names=["id", "n", "h1", "h2", "sketch"])

    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).mapInArrow(make, "id bigint, n bigint, h1 bigint, h2 bigint, sketch array<bigint>")


def needed(both: int | np.ndarray, least: float) -> np.ndarray:
    """Shingles to align of ``both`` in two sequences for ``least`` similarity: whole ones, so that an exact share is enough."""
    return np.ceil(least / (1 + least) * both - 1e-9).astype(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> int:
    """Length of the longest common subsequence inside the band that ``least`` similarity allows, or -1 if it can't be reached."""
    need = int(needed(len(a) + len(b), least))
    if min(len(a), len(b)) < need:
        return -1
    band = len(a) + len(b) - 2 * need
    order = np.argsort(b, kind="stable")
    s = b[order]
    lo, hi = np.searchsorted(s, a, "left"), np.searchsorted(s, a, "right")
    if (hi > lo).sum() < need:
        return -1
    n = hi - lo
    i = np.repeat(np.arange(len(a)), n)
    # matches of one place from right to left, so that an increasing run takes one of them
    j = order[np.repeat(hi, n) - 1 - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))]
    tails: list[int] = []
    for x in j[np.abs(i - j) <= band].tolist():
        at = bisect_left(tails, x)
        if at == len(tails):
            tails.append(x)
        else:
            tails[at] = x
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Aligned shingles over all shingles; 0 where ``least`` is out of reach."""
    m = aligned(a, b, least)
    return m / (len(a) + len(b) - m) if m > 0 else 0.0


def verify(pairs: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that are similar. ``sequences``: h1, sh."""
    both = (pairs.join(sequences.select(F.col("h1").alias("b"), F.col("sh").alias("sb")), "b")
            .join(sequences.select(F.col("h1").alias("a"), F.col("sh").alias("sa")), "a").select("a", "b", "sa", "sb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            good = [similarity(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), least) >= least
                    for p, q in zip(x.column(2).to_pylist(), x.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(check, "a bigint, b bigint")


def likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose first column, a long, is among those of ``wanted``, and a few others: a bit of a table of 4 MB for each hash of a wanted one.

    The table has that size whatever there is to ask for; where it is full, more rows pass.
    """
    blocks = 1 << PASS_BITS - 15
    slot = lambda ids: mix64(ids.view(np.uint64)) >> np.uint64(64 - PASS_BITS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(slot(b.column(0).drop_null().to_numpy()))
            block, first = np.unique(at >> np.uint64(15), return_index=True)
            for k, part in zip(block.tolist(), np.split(at & np.uint64(32767), first[1:])):
                bits = np.zeros(32768, np.uint8)
                bits[part.astype(np.int64)] = 1
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    def merge(t: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("bits").to_pylist()])
        return pa.table({"block": t.column("block").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    kind = "block bigint, bits binary"
    table = np.zeros((blocks, 4096), np.uint8)
    for x in wanted.mapInArrow(mark, kind).groupBy("block").applyInArrow(merge, kind).collect():  # 1024 rows of 4 KB at most
        table[x["block"]] = np.frombuffer(x["bits"], np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(table.ravel())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = slot(b.column(0).fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            yield b.filter(pa.array((sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))

    return rows.mapInArrow(keep, rows.schema)


def sequences_of(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(h1, sh): shingle sequence of one document for each wanted (h1, rep)."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in pieces(b.column(1)):
                sh, bounds, h, words = shingles(data, off)
                h1 = span_hash(prefix_hash(h), words[:-1], words[1:]).view(np.int64)
                # an id may stand before several texts: the one asked for is kept
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array([sh[p:q].tobytes() for p, q in zip(bounds[:-1], bounds[1:])], pa.binary())], names=["h1", "sh"]).filter(
                    pa.array(h1 == b.column(2).slice(lo, hi - lo).to_numpy()))

    # texts that nothing asks for stay where they are; the join then leaves out the few others that pass
    rows = likely(docs.select(F.col(key).cast("bigint").alias("rep"), F.col(text).alias("t")), wanted.select("rep"))
    picked = rows.join(wanted.select("rep", F.col("h1").alias("want")).distinct().hint("merge"), "rep")
    return picked.select("rep", "t", "want").mapInArrow(make, "h1 bigint, sh binary").dropDuplicates(["h1"])


def visit(now: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between the components of entries. ``now``: h1, n, held, t, s, c.

    A document visits the larger components it shares an entry with, as a whole: their members lie in blocks, and a visitor is
    compared with a block at once, so pairs are never rows.
    """
    people = now.select("h1", "c").distinct()
    size = people.groupBy("c").agg(F.count(F.lit(1)).alias("k"))
    # a pair aligns r (n1 + n2) shingles at least, and no more than either holds in common with others
    r = F.lit(least / (1 + least))
    spare = F.col("held") - r * F.col("n") + F.lit(1e-9)
    own = now.select("h1", "t", "s", "c", "n", spare.alias("spare")).join(size, "c").alias("x")
    at = now.groupBy("t", "s", "c").agg(F.min("n").alias("n"), F.max(spare).alias("spare")).join(size, "c").alias("y")
    larger = (F.col("y.k") > F.col("x.k")) | ((F.col("y.k") == F.col("x.k")) & (F.col("y.c") < F.col("x.c")))
    reach = (F.col("x.spare") >= r * F.col("y.n")) & (F.col("y.spare") >= r * F.col("x.n"))
    goes = cut(own.join(at, ["t", "s"]).where(larger & reach).select(F.col("x.h1").alias("h1"), F.col("y.c").alias("c")).distinct())
    blocks = F.ceil(F.col("k") / F.lit(BLOCK)).cast("int")
    guests = goes.join(size, "c").select("c", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("g"), "h1", F.lit(True).alias("guest"))
    hosts = people.join(size, "c").join(goes.select("c").distinct(), "c", "left_semi").select("c", F.pmod(F.xxhash64("h1"), blocks).cast("int").alias("g"), "h1", F.lit(False).alias("guest"))

    def meet(t: pa.Table) -> pa.Table:
        guest = t.column("guest").to_numpy(zero_copy_only=False)
        ids = t.column("h1").to_numpy()
        sh = [np.frombuffer(x, np.uint64) for x in t.column("sh").to_pylist()]
        host = np.flatnonzero(~guest)
        a, b = [], []
        if len(host):
            flat, n = np.concatenate([sh[i] for i in host]), np.array([len(sh[i]) for i in host])
            of = np.repeat(np.arange(len(host)), n)
            for v in np.flatnonzero(guest):
                mine = np.sort(sh[v])
                hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                enough = np.bincount(of[hit], minlength=len(host)) >= needed(n + len(mine), least)
                for i in host[enough]:
                    if similarity(sh[v], sh[i], least) >= least:
                        a.append(ids[v])
                        b.append(ids[i])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    both = cut(guests.unionByName(hosts))
    return both.join(likely(sequences, both.select("h1")), "h1").groupBy("c", "g").applyInArrow(meet, "a bigint, b bigint")


def shared_shingles(sequences: DataFrame) -> DataFrame:
    """(h1, held): how many shingles of each sequence occur in another one as well."""
    shards = max(1, sequences.sparkSession.sparkContext.defaultParallelism) * 4
    names = ["s", "id", "sh", "n"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                bodies = [np.frombuffer(x, np.uint64) for x in part.column(1).to_pylist()]
                row = np.repeat(np.arange(len(bodies)), [len(x) for x in bodies])
                sh = np.concatenate(bodies)
                order = np.lexsort((row, sh))
                sh, row = sh[order], row[order]
                first = np.flatnonzero(np.concatenate(([True], (sh[1:] != sh[:-1]) | (row[1:] != row[:-1]))))
                times = np.diff(np.append(first, len(sh)))
                sh, row = sh[first], row[first]
                # what two sequences of this batch share needs no answer, but others must hear of it
                same = np.concatenate(([False], sh[1:] == sh[:-1]))
                known = same | np.concatenate((same[1:], [False]))
                send_it = ~same
                ids = part.column(0).to_numpy()
                yield pack((sh[send_it] % np.uint64(shards)).astype(np.int64), [ids[row[send_it]], sh[send_it], np.where(known, 0, times)[send_it].astype(np.uint32)], names)
                yield pack(np.full(int(known.sum()), -1), [ids[row[known]], np.zeros((int(known.sum()), 0), np.uint8), times[known].astype(np.uint32)], names)

    def count(t: pa.Table) -> pa.Table:
        ids, n = unpack(t, "id", np.int64), unpack(t, "n", np.uint32).astype(np.int64)
        if t.column("s")[0].as_py() >= 0:
            _, at, many = np.unique(unpack(t, "sh", np.uint64), return_inverse=True, return_counts=True)
            n = np.where((many[at] > 1) | (n == 0), n, 0)
        u, at = np.unique(ids, return_inverse=True)
        return pa.table({"h1": u, "held": np.bincount(at, weights=n, minlength=len(u)).astype(np.int64)})

    sent = sequences.select("h1", "sh").mapInArrow(send, "s bigint, id binary, sh binary, n binary")
    # answers that need no other batch are spread by themselves
    sent = sent.withColumn("own", F.when(F.col("s") < 0, F.xxhash64("id")).otherwise(F.lit(0)))
    return sent.groupBy("s", "own").applyInArrow(lambda t: count(t.drop(["own"])), "h1 bigint, held bigint").groupBy("h1").agg(F.sum("held").alias("held"))


def near_dups(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY, tables: int = TABLES, kept: int = KEPT) -> DataFrame:
    """One row per document: id, h1, n_shingles, class_id (smallest id of the class), kept."""
    sig = cut(signatures(docs, key, text, tables, kept))
    able = F.col("id").isNotNull() & (F.col("n") > 0)
    nodes = cut(sig.where(able).groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).drop("h2"))
    entries = nodes.select("h1", "n", F.posexplode("sketch").alias("t", "s"))
    shared = entries.groupBy("t", "s").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    members = cut(entries.join(shared, ["t", "s"]))
    # the leader of an entry is the member that meets most others: in a group of edited copies, the one least edited
    met = members.groupBy("h1").agg(F.sum("k").alias("met"), F.first("n").alias("n"))
    leads = members.select("h1", "t", "s").join(met, "h1").groupBy("t", "s").agg(F.max(F.struct("met", "h1", "n")).alias("m")).select(
        "t", "s", F.col("m.h1").alias("lead"), F.col("m.n").alias("ln"))
    members = cut(members.drop("k").join(leads, ["t", "s"]))
    wanted = cut(nodes.join(members.select("h1").distinct(), "h1", "left_semi").select("h1", "rep"))
    seqs = cut(sequences_of(docs, key, text, wanted))
    long_enough = lambda p, q: F.least(p, q) >= F.greatest(p, q) * F.lit(least)
    # 1. everyone against the entry's leader
    pairs = members.where((F.col("h1") != F.col("lead")) & long_enough(F.col("n"), F.col("ln"))).select(F.col("lead").alias("a"), F.col("h1").alias("b")).distinct()
    links = cut(verify(pairs, seqs, least))
    # 2. entries whose members are still in different components: members against one another
    label = components(links).withColumnRenamed("node", "h1").withColumnRenamed("component", "c")
    now = cut(members.join(label, "h1", "left").withColumn("c", F.coalesce("c", "h1")))
    open_ = now.groupBy("t", "s").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("t", "s")
    now = cut(now.join(open_, ["t", "s"]))
    held = shared_shingles(likely(seqs, now.select("h1")).join(now.select("h1").distinct(), "h1", "left_semi"))
    # no more of a document can be aligned than it shares with any other that is still to compare
    now = cut(now.join(held, "h1").where(F.col("held") >= F.col("n") * F.lit(least)))
    links = cut(links.unionByName(visit(now, seqs, least)))
    label = components(links).withColumnRenamed("node", "h1").withColumnRenamed("component", "c")
    named = nodes.join(label, "h1", "left").withColumn("c", F.coalesce("c", "h1"))
    first = named.groupBy("c").agg(F.min("rep").alias("class_id"))
    facts = named.join(first, "c").select("h1", "class_id")
    done = sig.where(able).join(facts, "h1").select("id", "h1", "n", "class_id")
    rest = sig.where(~able).select("id", "h1", "n", F.col("id").alias("class_id"))
    return done.unionByName(rest).select("id", "h1", F.col("n").alias("n_shingles"), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def near_dups_query(docs: DataFrame) -> DataFrame:
    """One row per document with its class."""
    return near_dups(docs).select(F.col("id").alias("doc_id"), "n_shingles", "class_id", "kept")


def word_key(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``h1``, the hash of the word sequence."""
    def make(col: pa.Array) -> list[pa.Array]:
        out = [np.zeros(0, np.int64)]
        for _, _, data, off in pieces(col):
            start, end, words = word_spans(data, off, not_space())
            out.append(span_hash(prefix_hash(word_hashes(data, start, end, lower=True)), words[:-1], words[1:]).view(np.int64))
        return [pa.array(np.concatenate(out))]

    return append(docs, text, [T.StructField(name, T.LongType())], make)


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, with its own columns; of repeated rows one stays."""
    near = cut(near_dups(docs, key, text))
    gone = near.where(~F.col("kept")).select("id", "h1").distinct()
    first = near.where(F.col("kept") & F.col("id").isNotNull() & (F.col("n_shingles") > 0)).select("id", "h1", "class_id")
    many = first.groupBy("class_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("class_id")
    twice = cut(first.join(many, "class_id").distinct())
    own, names = set_aside(docs)
    rows = word_key(own.withColumn("id", F.col(names[key]).cast("bigint")), names[text], "h1").join(
        gone.hint("merge"), ["id", "h1"], "left_anti")  # the same plan at every size
    if twice.limit(1).count():  # rows that repeat an id of a class: rare, and only they are compared
        rows = rows.join(twice.select("id", "h1"), ["id", "h1"], "left_anti").select(*names.values()).unionByName(
            rows.join(twice, ["id", "h1"]).dropDuplicates(["class_id"]).select(*names.values()))
    return put_back(rows, names)
