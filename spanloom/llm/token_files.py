"""Token ids of all documents in binary files, coded by a static range asymmetric numeral system.

Texts are tokenized in the scan and written once as narrow ids, without shuffling text. Ids are counted into one frequency
table, which all blocks share; then rows are exchanged once by ranges of key, so that shards follow each other in order,
and each shard's ids, documents on end, are cut into independent blocks of ``rans.BLOCK_IDS`` (see ``rans`` for the format). Blocks
are written by Spark's own writer, which every store that Spark reaches takes and whose commits survive lost tasks: a record is a
block, and one line feed follows it. They are read as binary files, each checked and decoded by itself.

The tokenizer comes from a file of the ``tokenizers`` library, read on the driver and sent to the tasks. Where its splitter is the
byte-level pattern alone, a blank after a character that is no white space always starts a new piece, whatever stands around it; texts
are then cut there and every different piece of a task is encoded once, which gives the same ids as whole texts. Pieces of a word
and marks are put together from these, and words go to the tokenizer's model directly. Other tokenizers get whole texts.

Null and empty texts have the end id alone. Long texts are one row of ids and may span many blocks. Repeated rows are all kept; rows of
equal key follow each other by number and hash of their ids, a null key comes first. An empty table gives no file and no rows. Extra columns are
ignored. A block that does not match its checksum raises ``rans.Corrupt``. Keys are integers of 64 bits.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from ..session import scratch_dir
from . import crc, rans
from .base import cut

END_ID = 2
#: blocks in a file, and pieces that a task remembers
FILE_BLOCKS = 16
REMEMBER = 1 << 20
#: text encoded at once
TEXTS = 1 << 19
#: a blank after one of these (or at the start of a text) stays inside its piece; marked by a character for private use
_SPACE = [chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_AFTER_SPACE = [c + " " for c in _SPACE]
_JOINED = re.compile(f"(?<=[{''.join(_SPACE)}]) |^ ")
_MARK, _HEAD = "\ue000", "\ue001"
#: pieces encoded in one call
LEARN = 1024
#: letters up to here are letters in every version of Unicode; marks that end a word (no apostrophe: it joins what follows)
_LATIN = "\u0250"
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_FENCE = "\x00"


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet, by byte: printable bytes of Latin-1 are themselves, the rest follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


def is_word(text: str) -> bool:
    return text.isalpha() and (text.isascii() or max(text) < _LATIN)


def parts(piece: str) -> list[str] | None:
    """The pieces that a piece is certain to be split into: words, marks after them, and single line feeds between lines."""
    blank, out = "", []
    if piece.startswith(_HEAD):
        blank, piece = _HEAD, piece[1:]
    for i, line in enumerate(piece.split("\n")):
        word = line.rstrip(_MARKS)
        if not line or not (is_word(word) or not word):
            return None
        if i:
            out.append(_HEAD + "\n")
            blank = _HEAD
        if word:
            out.append(blank + word)
            blank = _HEAD
        if len(word) < len(line):
            out.append(blank + line[len(word):])
    return out


def cuts_at_blanks(tokenizer: Tokenizer) -> bool:
    """Whether the splitter is the byte-level pattern alone, for which blanks after other characters start pieces."""
    return (tokenizer.normalizer is None and tokenizer.post_processor is None
            and str(tokenizer.pre_tokenizer).startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in str(tokenizer.pre_tokenizer)
            and not any(t.lstrip or t.rstrip or t.single_word or " " in t.content for t in tokenizer.get_added_tokens_decoder().values()))


class Grown:
    """A numpy row that grows at its end."""

    def __init__(self, kind: type):
        self.row = self._room = np.zeros(0, kind)

    def add(self, more: np.ndarray) -> None:
        n = len(self.row)
        if n + len(more) > len(self._room):
            room = np.zeros(2 * (n + len(more)), self.row.dtype)
            room[:n] = self.row
            self._room = room
        self._room[n:n + len(more)] = more
        self.row = self._room[:n + len(more)]


class Encoder:
    """Ids of many texts on end; ``special``: strings of special tokens are ordinary text."""

    def __init__(self, model: str, end_id: int, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.end_id, self.special = Tokenizer.from_str(model), end_id, special
        self.tokenizer.encode_special_tokens = special
        self.by_piece = cuts_at_blanks(self.tokenizer)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the same model on words that are split and spelt already
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = CharDelimiterSplit(_FENCE)
        self.letters = byte_letters()
        vocabulary = self.tokenizer.get_vocab()
        self.spells = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.spells[list(vocabulary.values())] = list(map(len, vocabulary))
        self.forget()

    def forget(self) -> None:
        #: number of each known piece: number 0 is the end of a text; numbers index ``size`` and ``start``, and these ``flat``
        self.known: dict[str, int] = {}
        self.size, self.start, self.flat = Grown(np.int64), Grown(np.int64), Grown(np.uint32)
        self._append(np.array([self.end_id], np.uint32), np.ones(1, np.int64))

    def _append(self, ids: np.ndarray, size: np.ndarray) -> None:
        self.start.add(len(self.flat.row) + np.cumsum(size) - size)
        self.size.add(size)
        self.flat.add(ids)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def spelt(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single words (letters, with or without a blank before them)."""
        blank = self.letters[0x20]
        text = [w.replace(" ", blank) if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in words]
        got = self.words.encode_batch_fast([_FENCE.join(text[k:k + LEARN]) for k in range(0, len(text), LEARN)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in got), np.uint32)
        # every id spells some bytes: a word ends where its bytes do
        ends = np.searchsorted(np.cumsum(self.spells[ids]), np.cumsum(np.fromiter(map(len, text), np.int64, len(text)))) + 1
        return ids, np.diff(ends, prepend=0)

    def learn(self, pieces: list[str]) -> None:
        """Words go to the model at once; other pieces are put together from their parts, or encoded as they are."""
        words, other, made, count, used = [], [], [], [], []
        for p in pieces:
            word = p.rstrip(_MARKS)
            if word.isalpha() and (word.isascii() or max(word) < _LATIN):
                if len(word) == len(p):
                    words.append(p)
                else:
                    made.append(p)
                    count.append(2)
                    used += (word, _HEAD + p[len(word):])
                continue
            if p[:1] == _HEAD and is_word(p[1:]):
                words.append(p)
                continue
            got = parts(p)
            if got is None or got == [p]:
                other.append(p)
            else:
                made.append(p)
                count.append(len(got))
                used += got
        new = set(used).difference(self.known, words, other)
        more = {q for q in new if is_word(q.removeprefix(_HEAD))}
        self._add([*words, *more], self.spelt)
        self._add([*other, *(new - more)], self.whole)
        if made:
            number = np.fromiter(map(self.known.__getitem__, used), np.int64, len(used))
            size = self.size.row[number]
            self._store(made, self._ids(number, size), np.add.reduceat(size, np.cumsum([0, *count])[:-1]))

    def _add(self, pieces: list[str], encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> None:
        if pieces:
            self._store(pieces, *encode([(p[1:] if p.startswith(_HEAD) else " " + p).replace(_MARK, " ") for p in pieces]))

    def _store(self, pieces: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n = len(self.size.row)
        self.known.update(zip(pieces, range(n, n + len(pieces))))
        self._append(ids, size)

    def _ids(self, number: np.ndarray, size: np.ndarray) -> np.ndarray:
        after = np.cumsum(size)
        return self.flat.row[np.repeat(self.start.row[number] - (after - size), size) + np.arange(after[-1] if len(after) else 0)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per text), each text closed by the end id."""
        if not self.by_piece or any(_MARK in t or _HEAD in t for t in texts):
            ids, n = self.whole(texts)
            return np.insert(ids, np.cumsum(n), self.end_id), n + 1
        if len(self.known) > REMEMBER:
            self.forget()
        pieces: list[str] = []
        bound = [0]
        for t in texts:
            if t:
                if t[0] == " " or any(s in t for s in _AFTER_SPACE):
                    t = _JOINED.sub(_MARK, t)
                at = len(pieces)
                pieces += t.split(" ")
                pieces[at] = _HEAD + pieces[at]
            bound.append(len(pieces))
        number = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(number < 0).tolist()
        if new:
            self.learn(list({pieces[i] for i in new}))
            number[new] = [self.known[pieces[i]] for i in new]
        closed = np.array(bound[1:], np.int64)
        number = np.insert(number, closed, 0)
        size = self.size.row[number]
        ends = np.cumsum(size)[closed + np.arange(len(texts))]
        return self._ids(number, size), np.diff(ends, prepend=0)


def encoder_of(model: str, end_id: int, special: bool) -> Encoder:
    """The encoder of this worker process: its tables, and the pieces it knows, serve later tasks too."""
    kept = tokenizers.__dict__.setdefault("_kept_by_token_files", {})
    key = (zlib.crc32(model.encode()), len(model), end_id, special)
    if key not in kept:
        kept.clear()
        kept[key] = Encoder(model, end_id, special)
    return kept[key]


def tokenized(docs: DataFrame, key: str, text: str, model: str, end_id: int = END_ID, special: bool = False) -> DataFrame:
    """(key, n, ids): ids as bytes, little-endian, of 2 or 4 bytes each (see ``width``).

    The last row of a task has n = -1 and, as bytes, how often the task met each id.
    """
    size = width(model, end_id)
    symbols = max(Tokenizer.from_str(model).get_vocab_size(), end_id + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, met = encoder_of(model, end_id, special), np.zeros(symbols, np.int64)
        for b in batches:
            at = 0
            while at < b.num_rows:
                texts, held = [], 0
                while at + len(texts) < b.num_rows and held < TEXTS:
                    texts.append(b.column(1)[at + len(texts)].as_py() or "")
                    held += len(texts[-1])
                ids, n = encoder.encode(texts)
                met += np.bincount(ids, minlength=symbols)
                off = np.concatenate(([0], np.cumsum(n))) * size
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(ids.astype(f"<u{size}"))])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array(n), raw.cast(pa.binary())], names=["key", "n", "ids"])
                at += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1]), pa.array([met.astype("<i8").tobytes()])], names=["key", "n", "ids"])

    return docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).mapInArrow(run, "key bigint, n bigint, ids binary")


def width(model: str, end_id: int = END_ID) -> int:
    return 2 if max(Tokenizer.from_str(model).get_vocab_size() - 1, end_id) < 1 << 16 else 4


def numbers(col: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows on end and the row bounds."""
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    ids = np.frombuffer(col.buffers()[2], np.uint8)[off[0]:off[-1]].view(f"<u{size}") if len(col) else np.zeros(0, np.uint32)
    return ids, (off - off[0]) // size


def id_counts(rows: DataFrame, symbols: int) -> np.ndarray:
    """How often each id occurs, from the last rows of the tasks (see ``tokenized``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(symbols, np.int64)
        for b in batches:
            for row in b.column(0):
                total += np.frombuffer(row.as_buffer(), "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    got = rows.where("n < 0").select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(symbols, np.int64)
    out[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return out


def blocks(rows: DataFrame, table: rans.Table, size: int) -> DataFrame:
    """One row per block (``block``: its bytes); rows are dealt and ordered by key."""
    freq = table.freq

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = rans.Table(freq), TaskContext.get().partitionId()
        serial = first = number = held = 0
        docs: list[tuple[int, ...]] = []
        ids: list[np.ndarray] = []

        def closed() -> pa.RecordBatch:
            nonlocal first, number, held
            got = np.concatenate(ids)
            data = rans.pack(rans.Block(shard, number, first, np.array(docs, np.int64), got), own)
            first, number, held = first + len(got), number + 1, 0
            docs.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([data])], names=["block"])

        for b in batches:
            values, bound = numbers(b.column(1), size)
            for key, lo, hi in zip(b.column(0).to_pylist(), bound[:-1].tolist(), bound[1:].tolist()):
                at = lo
                while at < hi:
                    take = min(hi - at, rans.BLOCK_IDS - held)
                    docs.append((key or 0, key is None, serial, hi - lo, at - lo, take))
                    ids.append(values[at:at + take])
                    held, at = held + take, at + take
                    if held == rans.BLOCK_IDS:
                        yield closed()
                serial += 1
        if held:
            yield closed()

    # the hash splits repeated keys among partitions
    order = [F.col("key").asc_nulls_first(), F.col("n"), F.xxhash64("ids")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order, "ids").select("key", "ids").mapInArrow(run, "block binary")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, special: bool = False) -> None:
    """Write the ids of all documents below ``folder``: ``blocks`` (binary) and ``table`` (id, frequency).

    ``tokenizer``: path of a file of the tokenizers library, readable on the driver. ``special``: treat strings of special tokens as text.
    """
    with open(tokenizer, encoding="utf-8") as f:
        model = f.read()
    size = width(model, end_id)
    rows = cut(tokenized(docs, key, text, model, end_id, special))
    table = rans.table(id_counts(rows, max(Tokenizer.from_str(model).get_vocab_size(), end_id + 1)))
    docs.sparkSession.createDataFrame([(i, int(f)) for i, f in enumerate(table.freq)], "id int, freq bigint").coalesce(1).write.parquet(f"{folder}/table")
    # a text record is written as the bytes it is; the line feed after it is skipped on reading
    (blocks(rows.where("n >= 0"), table, size).select(F.col("block").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", FILE_BLOCKS).text(f"{folder}/blocks"))


def read_table(spark: SparkSession, folder: str) -> rans.Table:
    got = spark.read.parquet(f"{folder}/table").orderBy("id").toArrow()
    return rans.Table(got.column("freq").to_numpy().astype(np.int64))


def decoded(spark: SparkSession, folder: str, schema: str, make: Callable[[rans.Block], pa.RecordBatch]) -> DataFrame:
    """What ``make`` gives for every block of the files below ``folder``, checked and decoded."""
    freq = read_table(spark, folder).freq

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = rans.Table(freq)
        for b in batches:
            for content in b.column(0):
                data, at = content.as_buffer().to_pybytes(), 0
                while at < len(data):
                    block, at = rans.unpack(data, at, own)
                    at += 1
                    yield make(block)

    files = spark.read.format("binaryFile").load(f"{folder}/blocks")
    return files.where("length > 0").select("content").mapInArrow(run, schema)


PART = "shard bigint, serial bigint, key bigint, first bigint, before bigint, n bigint"


def part_columns(block: rans.Block) -> tuple[list[pa.Array], np.ndarray]:
    d, n = block.docs, len(block.docs)
    at = np.concatenate(([0], np.cumsum(d[:, 5])))
    cols = [pa.array(np.full(n, block.shard)), pa.array(d[:, 2]), pa.array(d[:, 0], mask=d[:, 1] > 0), pa.array(block.first + at[:-1]), pa.array(d[:, 4]), pa.array(d[:, 5])]
    return cols, at


def document_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(key, shard, serial, ids) of every document, read back from the files."""

    def make(block: rans.Block) -> pa.RecordBatch:
        cols, at = part_columns(block)
        ids = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(block.ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([*cols, ids], names=["shard", "serial", "key", "first", "before", "n", "ids"])

    parts = decoded(spark, folder, PART + ", ids array<int>", make)
    return parts.groupBy("shard", "serial").agg(F.first("key").alias("key"), F.array_sort(F.collect_list(F.struct("before", "ids"))).alias("p")).select(
        "key", "shard", "serial", F.flatten(F.col("p.ids")).alias("ids"))


def document_sums(spark: SparkSession, folder: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files: parts of a document add up by exclusive or."""

    def make(block: rans.Block) -> pa.RecordBatch:
        cols, at = part_columns(block)
        raw, d = memoryview(block.ids.astype("<u4").tobytes()), block.docs
        sums = np.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], np.uint32)
        behind = 4 * (d[:, 3] - d[:, 4] - d[:, 5])
        return pa.RecordBatch.from_arrays([*cols, pa.array(crc.shift(sums, behind).astype(np.int64))],
                                          names=["shard", "serial", "key", "first", "before", "n", "part"])

    parts = cut(decoded(spark, folder, PART + ", part bigint", make))
    rows = parts.groupBy("shard", "serial").agg(F.first("key").alias("key"), F.min("first").alias("first"), F.sum("n").alias("n_tokens"), F.bit_xor("part").alias("ids_crc32"))
    # one row per shard, that is per task that wrote
    total, offsets = 0, []
    for shard, n in sorted(parts.groupBy("shard").agg(F.sum("n")).collect()):
        offsets.append((shard, total))
        total += n
    starts = spark.createDataFrame(offsets, "shard bigint, ahead bigint")
    return rows.join(starts, "shard").select("key", (F.col("ahead") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def token_files_query(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents to files in the shared folder, and report what the files hold."""
    spark = docs.sparkSession
    folder = f"{scratch_dir(spark)}/spanloom-{spark.conf.get('spark.app.id', 'local')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, tokenizer)
    return document_sums(spark, folder).withColumnRenamed("key", "doc_id")
