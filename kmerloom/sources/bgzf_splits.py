"""Block-compressed (BGZF) text as a splittable source and as a sink.

Reading. Spark's own text reader cuts a file into byte ranges, at the four bytes that every block begins with; what it
calls a line is a block without these bytes. So a file is as many tasks as it has ranges, in any store that Spark reads. A range's first block begins
where the range before it ended, so block offsets are sums of lengths: one row for each range is added up in one place. The four
bytes can also turn up inside a block; its header tells how long it is, and it is put together again.

A line of text can reach over blocks and over ranges. Each range gives the lines that it holds whole and what stands before its first and behind its last
line feed; these edges, one row for each range, are joined in order. Files whose names end in .gz cannot be read in ranges, since Spark unpacks them by
their names: each is one task. Names like .bgz or .bgzf do.

Writing. Tasks pack lines into blocks of 65,280 bytes and Spark's text sink writes them, with the empty block that ends a file as its line separator, so files
are committed by Spark's own protocol and a file's last bytes are what the format wants.

Defined results: an empty file has no blocks. Damaged or cut blocks fail, with the file's name. Carriage returns before a line feed are dropped; a
last line without a line feed counts. Null lines are written as empty ones.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import written
from .binary import BLOCK_BYTES, END_BLOCK, bgzf_block

#: What every block begins with, and bytes of blocks that are written as one row.
MAGIC, ROW_BYTES = b"\x1f\x8b\x08\x04", 4 << 20


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, piece): what stands between the magic bytes, range by range, in the order of each range."""
    packed = F.lower(F.col("_metadata.file_name")).endswith(".gz")
    read = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path).where(~packed)
    ranges = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, content in ((f, c) for b in batches for f, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            at = 0
            while at < len(content):
                end = content.find(MAGIC, at + 1)
                end = len(content) if end < 0 else end
                piece = content[at + len(MAGIC) : end] if content.startswith(MAGIC, at) else content[at:end]
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([0], pa.int64()), pa.array([piece])], names=["file", "start", "piece"])
                at = end

    # Spark unpacks what is named .gz before it is cut, so these files are read whole, each by one task
    whole = spark.read.format("binaryFile").load(path).where(packed).select(F.col("_metadata.file_path").alias("file"), "content")
    return ranges.unionByName(whole.mapInArrow(cut, "file string, start long, piece binary"))


def _block(piece: bytes, file: str) -> bytes:
    """The data of a block without its magic bytes; lengths and checksum are verified."""
    if len(piece) < 22 or piece[8:10] != b"BC":
        raise ValueError(f"{file}: not a BGZF block")
    try:
        data = zlib.decompress(piece[14:-8], -15)
    except zlib.error as e:
        raise ValueError(f"{file}: a block is damaged or cut short") from e
    if struct.unpack("<II", piece[-8:]) != (zlib.crc32(data), len(data)):
        raise ValueError(f"{file}: a block is damaged")
    return data


def _whole(rows: Iterator[tuple[str, int, bytes]]) -> Iterator[tuple[str, int, bytes]]:
    """Pieces put together where the magic bytes stand inside a block."""
    held: tuple[str, int, bytes] | None = None
    for file, start, piece in rows:
        if held is not None and held[0] == file:
            file, start, piece = held[0], held[1], held[2] + MAGIC + piece
        elif held is not None:
            raise ValueError(f"{held[0]}: a block is cut short")
        elif not piece:
            continue  # before a range's first block
        size = struct.unpack("<H", piece[12:14])[0] + 1 if len(piece) >= 14 else 1 << 17
        if len(piece) + len(MAGIC) < size:
            held = (file, start, piece)
            continue
        if len(piece) + len(MAGIC) > size:
            raise ValueError(f"{file}: not a BGZF block")
        held = None
        yield file, start, piece
    if held is not None:
        raise ValueError(f"{held[0]}: a block is cut short")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    for b in batches:
        yield from zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)


def _bases(pieces: DataFrame) -> DataFrame:
    """(file, start, base, text_base): the compressed and the text offset of each range's first block. Reads each block's two lengths only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packed, text = None, 0, 0
        for file, start, piece in _whole(_rows(batches)):
            if now not in (None, (file, start)):
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, packed, text)], names=["file", "start", "packed", "text"])
                packed = text = 0
            now = (file, start)
            packed += len(piece) + len(MAGIC)
            text += struct.unpack("<I", piece[-4:])[0] if len(piece) >= 22 else 0
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, packed, text)], names=["file", "start", "packed", "text"])

    from pyspark.sql import Window

    sizes = pieces.mapInArrow(run, "file string, start long, packed long, text long").groupBy("file", "start").agg(F.sum("packed").alias("packed"), F.sum("text").alias("text"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    return written(sizes.select("file", "start", F.coalesce(F.sum("packed").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("text").over(before), F.lit(0)).alias("text_base")), "ranges")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, text_at, data): every block that holds text, with its offset in the file and in the text."""
    pieces = _pieces(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, text = None, 0, 0
        for file, start, piece in _whole(_rows(batches)):
            if now != (file, start):
                now, at, text = (file, start), 0, 0
            data = _block(piece, file)
            if data:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (file, start, at, text, data)], names=["file", "start", "at", "text_at", "data"])
            at, text = at + len(piece) + len(MAGIC), text + len(data)

    blocks = pieces.mapInArrow(run, "file string, start long, at long, text_at long, data binary")
    return blocks.join(F.broadcast(_bases(pieces)), ["file", "start"]).select("file", (F.col("at") + F.col("base")).alias("at"), (F.col("text_at") + F.col("text_base")).alias("text_at"), "data")


def gzi_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, compressed, uncompressed): offsets of the blocks after each file's first, as a block index lists them."""
    return read_blocks(spark, path).where("at > 0").select("file", F.col("at").alias("compressed"), F.col("text_at").alias("uncompressed"))


def gzi_bytes(rows: DataFrame) -> bytes:
    """A block index of one file's ``gzi_rows``: their number and each row's two offsets, little-endian."""
    entries = sorted((r["compressed"], r["uncompressed"]) for r in rows.toLocalIterator())
    return struct.pack("<Q", len(entries)) + b"".join(struct.pack("<QQ", *e) for e in entries)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, line, voffset, end_voffset): lines of text, place their offset in the file's text, and the virtual offsets of a line's begin and end."""
    pieces = _pieces(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = ["file", "start", "edge", "place", "line", "block", "within", "end_block", "end_within"]
        now, at, text, carry, begin, seen, rows = None, 0, 0, [], None, False, []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 4), strict=True)], names=schema)
            rows.clear()
            return out

        def behind() -> None:
            # what stands behind the last line feed; 3 where the range has none at all
            if begin is not None:
                rows.append((*now, 2 if seen else 3, begin[0], b"".join(carry), *begin[1:], at, 0))

        for file, start, piece in _whole(_rows(batches)):
            if now != (file, start):
                if now is not None:
                    behind()
                now, at, text, carry, begin, seen = (file, start), 0, 0, [], None, False
            data, pos = _block(piece, file), 0
            after = at + len(piece) + len(MAGIC)
            while pos < len(data):
                if begin is None:
                    begin = (text + pos, at, pos)
                end = data.find(b"\n", pos)
                if end < 0:
                    carry.append(data[pos:])
                    break
                carry.append(data[pos:end])
                edge = (after, 0) if end + 1 == len(data) else (at, end + 1)
                rows.append((*now, 0 if seen else 1, begin[0], b"".join(carry), *begin[1:], *edge))
                carry, begin, seen, pos = [], None, True, end + 1
            at, text = after, text + len(data)
            if len(rows) >= 4096:
                yield batch()
        if now is not None:
            behind()
        if rows:
            yield batch()

    found = pieces.mapInArrow(run, "file string, start long, edge int, place long, line binary, block long, within long, end_block long, end_within long")
    placed = found.join(F.broadcast(_bases(pieces)), ["file", "start"])
    placed = written(placed.select("file", "start", "edge", (F.col("place") + F.col("text_base")).alias("place"), "line", *(F.shiftleft(F.col(b) + F.col("base"), 16).bitwiseOR(F.col(w)).alias(n) for b, w, n in (("block", "within", "voffset"), ("end_block", "end_within", "end_voffset")))), "lines")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held = None, None

        def line(held) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((file, held[0], held[1], held[2], held[3]), (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["file", "place", "line", "voffset", "end_voffset"])

        for b in batches:
            for f, edge, place, text, begin, end in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if f != file:
                    if held is not None:
                        yield line(held)
                    file, held = f, None
                held = (place, text, begin, end) if held is None else (held[0], held[1] + text, held[2], end)
                if edge == 1:
                    yield line(held)
                    held = None
        if held is not None:
            yield line(held)

    # a range's first line may have begun before it, and its last one may go on
    edges = placed.where("edge > 0").select("file", "edge", "place", "line", "voffset", "end_voffset").repartition("file").sortWithinPartitions("file", "place").mapInArrow(join, "file string, place long, line binary, voffset long, end_voffset long")
    every = placed.where("edge = 0").select("file", "place", "line", "voffset", "end_voffset").unionByName(edges)
    return every.select("file", "place", F.regexp_replace(F.col("line").cast("string"), r"\r$", "").alias("line"), "voffset", "end_voffset")


def write_lines(lines: DataFrame, path: str, line: str = "line", level: int = 6) -> None:
    """Lines in the order of their rows as block-compressed files, one for each partition that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, blocks, size = b"", [], 0
        for b in batches:
            text += b"".join([(x or "").encode() + b"\n" for x in b.column(0).to_pylist()])
            whole = len(text) // BLOCK_BYTES * BLOCK_BYTES
            for k in range(0, whole, BLOCK_BYTES):
                blocks.append(bgzf_block(text[k : k + BLOCK_BYTES], level))
                size += len(blocks[-1])
                if size >= ROW_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(blocks)])], names=["value"])
                    blocks, size = [], 0
            text = text[whole:]
        if text:
            blocks.append(bgzf_block(text, level))
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(blocks)])], names=["value"])

    packed = lines.select(line).mapInArrow(run, "value binary")
    packed.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", END_BLOCK.decode("latin-1")).text(path)
