"""Repeated stretches of text across a corpus, shared by the two removers of repeated text.

Items are bytes or words; a window is ``size`` consecutive items of one document. Windows that are equal have equal
least grams (hashes of ``gram`` consecutive items), so stretches of windows with one least gram are dealt to shards by it and equal
windows always meet, whatever the number of shards.

1. ``marks``: only hashes travel. Shards learn which least grams occur more than once and tell each group of documents (by hash of the
   id) which of their stretches have one. Everything else can't be repeated.
2. ``stretches``: the marked stretches themselves go to their shards; equal ones of a document group go once.
3. ``judge``: a shard makes equal stretches one, and gives those that share a least gram with an unlike one to ``method``, which finds the
   first place of every window in an index of them. It tells the documents which windows are repeats.
4. ``finish``: documents meet their repeated windows and become results.

Packed arrays keep these exchanges near the size of what they carry. Shards and document groups grow in number with the
text, so each holds a few MB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import byte_values, cut, mix64, not_space, pieces, powers, prefix_hash, word_hashes, word_spans, BASE_INV

#: text per document group and per shard, and the fewest of both
GROUP_BYTES = 16 << 20
SHARD_BYTES = 4 << 20
FEWEST = 24
#: windows of one stretch; a longer one is cut
LONGEST = 256
NULL_ID = -(1 << 63)


@dataclass(frozen=True)
class Plan:
    """What repeats: items ("bytes" or "words"), window and gram sizes, whether a place in the same document counts as earlier."""

    items: str
    size: int
    gram: int
    within: bool
    piece: int = 1 << 20


def itemize(plan: Plan, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Value per item, item bounds per row, and the byte start and end of each item."""
    if plan.items == "bytes":
        at = np.arange(len(data))
        return byte_values()[data], off, at, at + 1
    start, end, bounds = word_spans(data, off, not_space())
    return word_hashes(data, start, end), bounds, start, end


def runs(plan: Plan, value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with one least gram: (hash, first item, windows, row), in order of place."""
    n, k, m = len(value), plan.size, plan.gram
    z = np.zeros(0, np.int64)
    if n < k:
        return z.view(np.uint64), z, z, z
    h = prefix_hash(value)
    v = mix64((h[m:] - h[:-m]) * powers(BASE_INV, n + 1)[:n - m + 1])
    w, step = k - m + 1, 1
    place = np.arange(len(v))  # of the least gram, the first if there are more
    gram = v

    def lower(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(gram[a] <= gram[b], a, b)

    while step * 2 <= w:
        if plan.within:
            place = lower(place[:-step], place[step:])
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    if w > step:
        if plan.within:
            place = lower(place[:step - w], place[w - step:])
        v = np.minimum(v[:step - w], v[w - step:])
    # v[i] is the least gram of the window that starts at i; windows that cross into the next row don't count
    edge = np.zeros(len(v) + 1, np.int64)
    long = np.diff(bounds) >= k
    np.add.at(edge, bounds[:-1][long], 1)
    np.add.at(edge, bounds[1:][long] - k + 1, -1)
    ok = np.cumsum(edge[:-1]) > 0
    before = np.concatenate(([False], ok[:-1]))
    moved = v[1:] != v[:-1]
    if plan.within:  # windows of one stretch must not repeat one another, so a stretch has one place of its gram
        moved |= place[1:] != place[:-1]
    new = ok & (~before | np.concatenate(([True], moved)))
    new[bounds[:-1][long]] = True
    first = np.flatnonzero(new)
    if not len(first):
        return z.view(np.uint64), z, z, z
    stop = np.flatnonzero(np.concatenate((~ok[1:] | new[1:], [True])) & ok) + 1
    n_win = stop - first
    parts = -(-n_win // LONGEST)
    if parts.max() > 1:
        of = np.repeat(np.arange(len(first)), parts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        n_win = np.minimum(n_win[of] - nth * LONGEST, LONGEST)
        first = first[of] + nth * LONGEST
    return v[first], first, n_win, np.searchsorted(bounds, first, "right") - 1


def tags(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A short hash of each row's items, which tells apart rows of one id."""
    h = prefix_hash(value)
    return (mix64((h[bounds[1:]] - h[bounds[:-1]]) * powers(BASE_INV, len(h))[bounds[:-1]]) >> np.uint64(48)).astype(np.uint16)


def ids_of(col: pa.Array) -> np.ndarray:
    return pc.fill_null(col.cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False)


def pack(key: np.ndarray, cols: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """One row per key: its rows of each column, as bytes."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(key))
    out = [pa.array(key[first].astype(np.int64))]
    for c in cols:
        c = np.ascontiguousarray(c[order])
        out.append(pa.array([c[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist())], pa.binary()))
    return pa.RecordBatch.from_arrays(out, names=names)


def unpack(t: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), kind)


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    return (mix64(ids.view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def dealt(docs: DataFrame, plan: Plan, groups: int) -> DataFrame:
    """(g, id, text): documents with their group; texts travel squeezed, null as empty."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, packed = ids_of(b.column(0)), []
            for _, _, data, off in pieces(b.column(1)):
                raw = data.tobytes()
                packed += [squeeze(raw[x:y]) for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(group_of(ids, groups)), b.column(0), pa.array(packed, pa.binary())], names=["g", "id", "text"])

    return docs.select("id", "text").mapInArrow(add, "g bigint, id bigint, text binary")


def squeeze(raw: bytes) -> bytes:
    """Length and zstd frame: as small as deflate's first level, in less than half its time."""
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unsqueeze(x: bytes) -> bytes:
    n = int.from_bytes(x[:8], "little")
    return pa.decompress(memoryview(x)[8:], n, "zstd", asbytes=True) if n else b""


def inflated(col: pa.Array) -> pa.Array:
    return pa.array([unsqueeze(x) for x in col.to_pylist()], pa.large_binary())


def short(key: np.ndarray, shards: int) -> np.ndarray:
    """Five bytes of a hash besides what names the shard."""
    rest = np.ascontiguousarray((key // np.uint64(shards)).astype("<u8"))
    return np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 8)[:, :5])


def marks(docs: DataFrame, plan: Plan, shards: int, groups: int) -> DataFrame:
    """(g, mid, nth): per document group, the stretches whose least gram occurs more than once, as packed arrays.

    Rows of one id are not told apart here: a mark holds for all of them, and one too many does no harm.
    """
    names = ["s", "id", "nth", "h"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = ids_of(b.column(0))
            for lo, hi, data, off in pieces(b.column(1), plan.piece):
                value, bounds, _, _ = itemize(plan, data, off)
                key, _, _, row = runs(plan, value, bounds)
                if not len(key):
                    continue
                start = np.searchsorted(row, np.arange(hi - lo))
                nth = (np.arange(len(row)) - start[row]).astype(np.uint32)
                shard = (key % np.uint64(shards)).astype(np.int64)
                h = short(key, shards)
                order = np.argsort(key, kind="stable")
                same = key[order][1:] == key[order][:-1]
                again = np.zeros(len(key), bool)  # already repeated here
                again[order[1:][same]] = again[order[:-1][same]] = True
                one = np.ones(len(key), bool)  # the first of each hash goes to the shard
                one[order[1:][same]] = False
                yield pack(shard[one], [ids[lo:hi][row[one]], nth[one], h[one]], names)
                if again.any():
                    # no hash: they come back as they are
                    left = pack(shard[again], [ids[lo:hi][row[again]], nth[again], np.zeros((int(again.sum()), 0), np.uint8)], names)
                    yield left

    def find(t: pa.Table) -> pa.Table:
        h = [len(x) // 5 for x in t.column("h").to_pylist()]
        n = [len(x) // 8 for x in t.column("id").to_pylist()]
        whole = np.repeat(np.array([a == 0 for a in h]), n)
        ids, nth = unpack(t, "id", np.int64), unpack(t, "nth", np.uint32)
        raw = np.frombuffer(b"".join(t.column("h").to_pylist()), np.uint8).reshape(-1, 5)
        key = np.zeros((len(raw), 8), np.uint8)
        key[:, :5] = raw
        key = key.view(np.uint64).ravel()
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        rep = np.zeros(len(key), bool)
        rep[order[1:][same]] = rep[order[:-1][same]] = True
        keep = whole.copy()
        keep[~whole] = rep
        ids, nth = ids[keep], nth[keep]
        return pa.Table.from_batches([pack(group_of(ids, groups), [ids, nth], ["g", "mid", "nth"])])

    sent = docs.mapInArrow(send, "s bigint, id binary, nth binary, h binary")
    return sent.groupBy("s").applyInArrow(find, "g bigint, mid binary, nth binary")


def rows_of(ids: np.ndarray, tag: np.ndarray, want_id: np.ndarray, want_tag: np.ndarray) -> np.ndarray:
    """Row of each wanted (id, tag) among the rows of a group, -1 if none; equal rows give the first."""
    names, own = np.unique(ids, return_inverse=True)
    at = np.searchsorted(names, want_id)
    known = at < len(names)
    known[known] = names[at[known]] == want_id[known]
    # the place of an id among the ids and the tag make one number
    both = np.concatenate((own.astype(np.int64) << 16 | tag, at[known].astype(np.int64) << 16 | want_tag[known]))
    _, code = np.unique(both, return_inverse=True)
    first = np.full(code.max() + 1 if len(code) else 1, -1, np.int64)
    first[code[:len(ids)][::-1]] = np.arange(len(ids))[::-1]
    out = np.full(len(want_id), -1, np.int64)
    out[known] = first[code[len(ids):]]
    return out


SEG = ["s", "id", "tag", "start", "n", "key", "len", "body"]


def stretches(docs: DataFrame, marked: DataFrame, plan: Plan, shards: int, groups: int) -> DataFrame:
    """Marked stretches, packed per shard: id, tag, first item, windows, part of the hash, and the text.

    Half a hash is enough inside a shard: stretches that share it by chance are only looked at together.
    """
    def cutout(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], pa.int64() if c == "s" else pa.binary()) for c in SEG})
        if not left.num_rows or not right.num_rows:
            return empty
        mid, nth = unpack(right, "mid", np.int64), unpack(right, "nth", np.uint32).astype(np.int64)
        ids = ids_of(left.column("id").combine_chunks())
        out = []
        marked_rows = np.isin(ids, mid)
        rows = np.flatnonzero(marked_rows)
        text = inflated(left.column("text").combine_chunks().take(pa.array(rows)))
        ids = ids[rows]
        for lo, hi, data, off in pieces(text, plan.piece):
            value, bounds, begin, end = itemize(plan, data, off)
            key, first, n_win, row = runs(plan, value, bounds)
            if not len(key):
                continue
            tag = tags(value, bounds)
            start = np.searchsorted(row, np.arange(hi - lo + 1))
            want, at = wanted(ids[lo:hi], mid)
            inside = nth[want] < start[at + 1] - start[at]
            pick = np.unique((start[at] + nth[want])[inside])
            key, first, n_win, row = key[pick], first[pick], n_win[pick], row[pick]
            b0, b1 = begin[first], end[first + n_win + plan.size - 2]
            body = data.tobytes()
            segs = np.array([body[x:y] for x, y in zip(b0.tolist(), b1.tolist())], object)
            out.append((ids[lo:hi][row], tag[row], (first - bounds[row]).astype(np.uint32), n_win.astype(np.uint16), key, (b1 - b0).astype(np.uint32), segs))
        if not out:
            return empty
        did, tag, start, n_win, key, size, segs = (np.concatenate(x) for x in zip(*out))
        shard = (key % np.uint64(shards)).astype(np.int64)
        # equal stretches of the group need one body: copies follow the first one with length 0
        order = np.lexsort((start, did, shard))
        did, tag, start, n_win, key, size, segs, shard = (x[order] for x in (did, tag, start, n_win, key, size, segs, shard))
        edge = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
        cols = {c: [] for c in SEG}
        for a, b in zip(edge.tolist(), np.append(edge[1:], len(shard)).tolist()):
            seen: dict[bytes, int] = {}
            ref = np.array([seen.setdefault(x, len(seen)) for x in segs[a:b]], np.uint32)
            bodies = list(seen)
            cols["s"].append(int(shard[a]))
            for c, x in (("id", did), ("tag", tag), ("start", start), ("n", n_win)):
                cols[c].append(x[a:b].tobytes())
            _, where = np.unique(ref, return_index=True)
            cols["key"].append((key[a:b][where] >> np.uint64(32)).astype(np.uint32).tobytes() + ref.tobytes())
            cols["len"].append(np.array([len(x) for x in bodies], np.uint32).tobytes())
            cols["body"].append(squeeze(b"".join(bodies)))
        return pa.table({c: pa.array(v, pa.int64() if c == "s" else pa.binary()) for c, v in cols.items()})

    both = dealt(docs, plan, groups).groupBy("g").cogroup(marked.groupBy("g"))
    return both.applyInArrow(cutout, "s bigint, id binary, tag binary, start binary, n binary, key binary, len binary, body binary")


def shared(plan: Plan, bodies: list[bytes], windows: np.ndarray) -> np.ndarray:
    """Which bodies have a window whose hash occurs again among them: no other holds a repeated window, as equal windows have equal hashes."""
    v = []
    for lo, hi, data, off in pieces(pa.array(bodies, pa.large_binary()), plan.piece):
        value, bounds, _, _ = itemize(plan, data, off)
        h, n = prefix_hash(value), windows[lo:hi]
        at = np.arange(n.sum()) + np.repeat(bounds[:-1] - (np.cumsum(n) - n), n)
        v.append(mix64((h[at + plan.size] - h[at]) * powers(BASE_INV, len(h))[at]))
    v, of = np.concatenate(v), np.repeat(np.arange(len(bodies), dtype=np.int32), windows)
    order = np.argsort(v)
    same = v[order][1:] == v[order][:-1]
    out = np.zeros(len(bodies), bool)
    out[of[order[1:][same]]] = out[of[order[:-1][same]]] = True
    return out


#: (bodies, base value of each, windows of each) -> first value of every window, one body after the other
Method = Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]


def judge(segments: DataFrame, plan: Plan, groups: int, method: Method) -> DataFrame:
    """(g, id, tag, start, n): packed stretches of repeated windows, first item and number of windows."""
    def find(t: pa.Table) -> pa.Table:
        did, tag = unpack(t, "id", np.int64), unpack(t, "tag", np.uint16)
        start, n_win = unpack(t, "start", np.uint32).astype(np.int64), unpack(t, "n", np.uint16).astype(np.int64)
        number: dict[bytes, int] = {}
        seg, keys, bodies = [], [], []
        for k, ls, z in zip(*(t.column(c).to_pylist() for c in ("key", "len", "body"))):
            size = np.frombuffer(ls, np.uint32)
            key = np.frombuffer(k[:4 * len(size)], np.uint32)
            ref = np.frombuffer(k[4 * len(size):], np.uint32)
            text = unsqueeze(z)
            ends = np.cumsum(size).tolist()
            of = np.empty(len(size), np.int64)
            for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
                x = text[a:b]
                at = number.get(x)
                if at is None:
                    number[x] = at = len(bodies)
                    bodies.append(x)
                    keys.append(key[i])
                of[i] = at
            seg.append(of[ref])
        seg = np.concatenate(seg)
        names, rank = np.unique(did, return_inverse=True)
        base = (rank.astype(np.int64) << 32) | (start if plan.within else 0)
        least = np.full(len(bodies), np.iinfo(np.int64).max)
        np.minimum.at(least, seg, base)
        windows = np.zeros(len(bodies), np.int64)
        windows[seg] = n_win
        key = np.array(keys, np.uint32)
        _, of, many = np.unique(key, return_inverse=True, return_counts=True)
        unlike = np.flatnonzero(many[of] > 1)
        if len(unlike):
            unlike = unlike[shared(plan, [bodies[i] for i in unlike.tolist()], windows[unlike])]
        # an occurrence after the first of its body is all repeats
        later = base > least[seg]
        out = [(did[later], tag[later], start[later], n_win[later])]
        if len(unlike):
            pick = unlike[np.argsort(key[unlike], kind="stable")]
            first = method([bodies[i] for i in pick.tolist()], least[pick], windows[pick])
            ends = np.cumsum(windows[pick])
            of = np.repeat(np.arange(len(pick)), windows[pick])
            j = np.arange(len(of)) - (ends - windows[pick])[of]
            dup = first < least[pick][of] + (j if plan.within else 0)
            open_ = np.flatnonzero(dup & ~(np.concatenate(([False], dup[:-1])) & (j > 0)))
            close = np.flatnonzero(dup & ~np.concatenate((dup[1:] & (j[1:] > 0), [False]))) + 1
            body, off, n = pick[of[open_]], j[open_], close - open_
            firsts = np.flatnonzero(~later)
            order = np.argsort(seg[firsts], kind="stable")
            firsts = firsts[order]
            lo, hi = np.searchsorted(seg[firsts], body, "left"), np.searchsorted(seg[firsts], body, "right")
            r = np.repeat(np.arange(len(body)), hi - lo)
            o = firsts[np.arange(len(r)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[r]]
            out.append((did[o], tag[o], start[o] + off[r], n[r]))
        ids, tag, at, n = (np.concatenate(x) for x in zip(*out))
        return pa.Table.from_batches([pack(group_of(ids, groups), [ids, tag.astype(np.uint16), at.astype(np.uint32), n.astype(np.uint16)], ["g", "mid", "tag", "start", "n"])])

    return segments.groupBy("s").applyInArrow(find, "g bigint, mid binary, tag binary, start binary, n binary")


#: (bytes, item start and end, which items are removed) -> values of a row's result columns
Result = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple]


def finish(docs: DataFrame, spans: DataFrame, plan: Plan, groups: int, schema: str, types: list[pa.DataType], result: Result) -> DataFrame:
    """One row per document: id, then what ``result`` makes of its items and the removed ones."""
    names = ["id", *[x.strip().split(" ")[0] for x in schema.split(",")]]

    def make(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        ids_col = left.column("id").combine_chunks()
        ids = ids_of(ids_col)
        some = right.num_rows > 0
        if some:
            mid, mtag = unpack(right, "mid", np.int64), unpack(right, "tag", np.uint16)
            start, n = unpack(right, "start", np.uint32).astype(np.int64), unpack(right, "n", np.uint16).astype(np.int64)
            order = np.argsort(mid, kind="stable")
            mid, mtag, start, n = mid[order], mtag[order], start[order], n[order]
        for lo, hi, data, off in pieces(inflated(left.column("text").combine_chunks()), plan.piece):
            value, bounds, begin, end = itemize(plan, data, off)
            cover = np.zeros(len(value) + 1, np.int64)
            if some:
                tag = tags(value, bounds)
                # a piece looks at the repeats of its own ids alone
                own, rank = np.unique(ids[lo:hi], return_inverse=True)
                alike = rank.astype(np.int64) << 16 | tag
                a, b = np.searchsorted(mid, own, "left"), np.searchsorted(mid, own, "right")
                mine = np.arange((b - a).sum()) + np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a)
                at = rows_of(ids[lo:hi], tag, mid[mine], mtag[mine])
                mine, at = mine[at >= 0], at[at >= 0]
                for row in equal_rows(alike, at):
                    a = bounds[row[1]] + start[mine][row[0]]
                    cover += np.bincount(a, minlength=len(cover)) - np.bincount(a + n[mine][row[0]] + plan.size - 1, minlength=len(cover))
            gone = np.cumsum(cover[:-1]) > 0
            for d in range(hi - lo):
                p, q = bounds[d], bounds[d + 1]
                rows.append(result(data, begin[p:q], end[p:q], gone[p:q]))
        return pa.table([ids_col, *[pa.array(list(c), t) for c, t in zip(zip(*rows), types)]] if rows else [ids_col, *[pa.array([], t) for t in types]], names=names)

    both = dealt(docs, plan, groups).groupBy("g").cogroup(spans.groupBy("g"))
    return both.applyInArrow(make, f"id bigint, {schema}")


def wanted(ids: np.ndarray, mid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of a wanted id and a row with that id: (number of the want, row)."""
    order = np.argsort(ids, kind="stable")
    s = ids[order]
    lo, hi = np.searchsorted(s, mid, "left"), np.searchsorted(s, mid, "right")
    w = np.repeat(np.arange(len(mid)), hi - lo)
    return w, order[np.arange(len(w)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[w]]


def equal_rows(alike: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For wanted rows ``at``, every row equal to each of them: (number of the want, row)."""
    order = np.argsort(alike, kind="stable")
    s = alike[order]
    lo, hi = np.searchsorted(s, alike[at], "left"), np.searchsorted(s, alike[at], "right")
    r = np.repeat(np.arange(len(at)), hi - lo)
    yield r, order[np.arange(len(r)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[r]]


def remove(docs: DataFrame, plan: Plan, method: Method, schema: str, types: list[pa.DataType], result: Result, key: str, text: str) -> DataFrame:
    """All steps over ``docs``; one row per document."""
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, shards = (max(FEWEST, -(-total // x)) for x in (GROUP_BYTES, SHARD_BYTES))
    marked = cut(marks(rows, plan, shards, groups))
    spans = cut(judge(stretches(rows, marked, plan, shards, groups), plan, groups, method))
    return finish(rows, spans, plan, groups, schema, types, result)
