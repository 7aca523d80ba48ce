"""Text sources: files of trace lines, plain or gzipped, batch or streaming."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import running

CHUNK_LINES = 1 << 16


def read_lines(spark: SparkSession, path: str | list[str], numbered: bool = True) -> DataFrame:
    """One row per line of every file under ``path``.

    Columns: trace_id (hash of the path), file_path, line_no, byte_start, byte_end, value.
    Files are split as usual; lines keep their file order through the position of
    their block and their position inside it. ``numbered=False`` returns only
    the scan columns, so a caller can drop the text before ``number_lines`` shuffles.
    """
    raw = (spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_size"),
        F.monotonically_increasing_id().alias("pos")))
    lines = raw.select(
        F.sha2("file_path", 224).substr(1, 16).alias("trace_id"), "file_path", "block", "pos", "file_size",
        (F.octet_length("value") + 1).cast("bigint").alias("octets"),
        F.regexp_replace("value", "\r$", "").alias("value"))
    return number_lines(lines) if numbered else lines


def number_lines(lines: DataFrame) -> DataFrame:
    """Add line_no, byte_start and byte_end to rows that carry block, pos, octets and file_size.

    Positions inside a block come from the scan order. A block is further cut
    into chunks of 65 536 lines, so no window holds more than one chunk.
    """
    first = lines.groupBy("trace_id", "block").agg(F.min("pos").alias("_p0"))
    x = (lines.join(first, ["trace_id", "block"])
         .withColumn("_part", F.col("block") * F.lit(1 << 20) + F.shiftright(F.col("pos") - F.col("_p0"), 16))
         .withColumn("_one", F.lit(1).cast("bigint")))
    x = running(x, ["trace_id"], "_part", ["block", "pos"],
                [("line_no", "sum", "_one"), ("byte_start", "sum", "octets")])
    end = F.col("byte_start") + F.col("octets")
    plain = ~F.col("file_path").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate)$")
    return (x.withColumn("byte_end", F.when(plain, F.least(end, "file_size")).otherwise(end))
            .drop("_p0", "_part", "_one", "block", "pos", "octets", "file_size"))


def read_gzip_sniffed(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files that are gzip by their first bytes, whatever their names.

    Files with a ``.gz`` name go through ``read_lines``. A gzip stream cannot be
    split, so each file is one task; it is inflated piece by piece.
    """
    files = (spark.read.format("binaryFile").load(path)
             .where(F.substring("content", 1, 2) == F.unhex(F.lit("1f8b")))
             .select(F.sha2("path", 224).substr(1, 16).alias("trace_id"),
                     F.col("path").alias("file_path"), "content"))
    out = "trace_id string, file_path string, line_no bigint, byte_start bigint, byte_end bigint, value string"
    return files.mapInPandas(_inflate, out)


def _inflate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows(tid, name, first_line, start, lines):
        sizes = pd.Series([len(b) for b in lines], dtype="int64")
        ends = start + sizes.cumsum()
        return pd.DataFrame({
            "trace_id": tid, "file_path": name, "line_no": range(first_line, first_line + len(lines)),
            "byte_start": ends - sizes, "byte_end": ends,
            "value": [b.decode("utf-8", "replace").rstrip("\n").removesuffix("\r") for b in lines]})

    for pdf in batches:
        for tid, name, content in zip(pdf["trace_id"], pdf["file_path"], pdf["content"]):
            inflate, rest, line_no, at = zlib.decompressobj(31), b"", 0, 0
            for lo in range(0, len(content), 1 << 20):
                rest += inflate.decompress(content[lo:lo + (1 << 20)])
                cut = rest.rfind(b"\n") + 1
                whole, rest = rest[:cut].splitlines(keepends=True) if cut else [], rest[cut:]
                # only \n ends a line: join pieces splitlines cut at a lone \r
                lines = _join_cr(whole)
                for k in range(0, len(lines), CHUNK_LINES):
                    part = lines[k:k + CHUNK_LINES]
                    yield rows(tid, name, line_no, at, part)
                    line_no += len(part)
                    at += sum(map(len, part))
            if rest:
                yield rows(tid, name, line_no, at, [rest])


def _join_cr(pieces: list[bytes]) -> list[bytes]:
    out, open_piece = [], b""
    for p in pieces:
        open_piece += p
        if p.endswith(b"\n"):
            out.append(open_piece)
            open_piece = b""
    return out + ([open_piece] if open_piece else [])


#: number of a rotated file: the last number before its extension (``run.0007.txt``, ``run.7``)
ROTATION = r"\.(\d+)(?=(?:\.[A-Za-z]\w*)?$)"


def stream_lines(spark: SparkSession, path: str, max_files: int = 1000, rotation: str = ROTATION) -> DataFrame:
    """Streaming lines of a directory that receives files of trace output.

    Files whose paths differ only in their number are one trace (``trace_id``), in the order of ``rotation``; a file without
    number (-1) is a trace of its own. Files end at line ends. ``live`` counts positions after reading columns.
    """
    file = F.col("_metadata.file_path")
    return (spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", max_files).text(path)
            .select(F.sha2(F.regexp_replace(file, rotation, ""), 224).substr(1, 16).alias("trace_id"),
                    F.coalesce(F.regexp_extract(file, rotation, 1).try_cast("bigint"), F.lit(-1)).alias("rotation"),
                    F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_size"),
                    (F.octet_length("value") + 1).cast("bigint").alias("octets"), F.regexp_replace("value", "\r$", "").alias("value")))
