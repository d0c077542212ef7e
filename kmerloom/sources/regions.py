"""Binary interval indexes (CSI) of block-compressed feature files, and reading a region by one.

The index is computed as tables: bins of features, their stretches of virtual offsets with near ones joined, and linear offsets. Its file is one
binary value by definition, as large as the number of bins in use; it is put together on the driver from rows in order. A region is read by the chunks
that the index names: each is a row, and a task opens the file at the chunk's block and reads to its end.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bins import LEVELS, MIN_SHIFT, bin_first, bin_level, bin_of
from ..operators.intervals import linear_index, tasks_for
from ..plans.tables import checked_broadcast, written
from .binary import bgzf_blocks, bgzf_compress

#: Chunks of a bin with no more than a block between them are one.
NEAR = 1 << 16
# The magic bytes, and the columns of the table-index header: generic preset, sequence, begin and end columns, comment sign, lines skipped.
CSI_MAGIC, COLUMNS = b"CSI\x01", (0, 1, 4, 5, 35, 0)


def gff_features(lines: DataFrame) -> DataFrame:
    """(seq, beg, end, voffset, end_voffset, line) of feature lines of nine columns from (line, voffset, end_voffset); beg from 0, end behind the last letter."""
    f = F.split("line", "\t")
    rows = lines.where(~F.col("line").startswith("#")).where(F.size(f) == 9)
    return rows.select(f[0].alias("seq"), (f[3].cast("long") - 1).alias("beg"), f[4].cast("long").alias("end"), "voffset", "end_voffset", "line")


def index_rows(features: DataFrame) -> DataFrame:
    """(seq, first, n, bin, loff, chunks) of (seq, beg, end, voffset, end_voffset): first is the sequence's first offset, by which sequences are ordered, n its features.

    chunks are [begin, end) virtual offsets in order; loff is the first offset of a feature that touches the bin's first window, or of the next window that has one, or
    the last of all. Tasks follow the number of features, so what one of them sorts does not grow.
    """
    tasks = tasks_for(features)
    binned = features.select("seq", bin_of(F.col("beg"), F.col("end")).alias("bin"), "voffset", "end_voffset").repartition(tasks, "seq", "bin")
    w = Window.partitionBy("seq", "bin").orderBy("voffset", "end_voffset")
    before = F.max("end_voffset").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = binned.withColumn("new_", F.when(before.isNull() | (F.col("voffset") > before + NEAR), 1).otherwise(0)).withColumn("run_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chunks = runs.groupBy("seq", "bin", "run_").agg(F.min("voffset").alias("begin"), F.max("end_voffset").alias("end"))
    bins = chunks.groupBy("seq", "bin").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("chunks"))
    linear = written(linear_index(features, offset="voffset", tasks=tasks), "linear")
    sequences = features.groupBy("seq").agg(F.min("voffset").alias("first"), F.max("end_voffset").alias("behind"), F.count("*").alias("n"))
    last = linear.groupBy("seq").agg(F.max_by("voffset", "window").alias("last_"))
    window = F.lit(0).cast("long")
    for level in range(LEVELS + 1):
        window = F.when(bin_level(F.col("bin")) == level, F.shiftleft((F.col("bin") - bin_first(level)).cast("long"), 3 * (LEVELS - level))).otherwise(window)
    at = ["seq", "window"]
    placed = bins.withColumn("window", window).repartition(tasks, *at).join(linear.withColumnRenamed("voffset", "loff").repartition(tasks, *at), at, "left").join(checked_broadcast(last.join(sequences, "seq")), "seq")
    return placed.select("seq", "first", "behind", "n", "bin", F.coalesce("loff", "last_").alias("loff"), "chunks")


def csi_bytes(rows: DataFrame) -> bytes:
    """The index of ``index_rows`` as a file: sequences in the order of their first features, bins in order, all numbers little-endian, block-compressed."""
    ordered = rows.orderBy("first", "seq", "bin").toLocalIterator()
    names, body = [], b""
    pseudo = bin_first(LEVELS + 1) + 1
    for (_, name), own in groupby(ordered, key=lambda r: (r["first"], r["seq"])):
        names.append(str(name))
        bins = list(own)
        body += struct.pack("<i", len(bins) + 1)
        for r in bins:
            body += struct.pack("<IQi", r["bin"], r["loff"], len(r["chunks"])) + b"".join(struct.pack("<QQ", c["begin"], c["end"]) for c in r["chunks"])
        # the number of features, in a bin beyond all others
        body += struct.pack("<IQi4Q", pseudo, 0, 2, bins[0]["first"], bins[0]["behind"], bins[0]["n"], 0)
    blob = b"".join(n.encode() + b"\0" for n in names)
    head = CSI_MAGIC + struct.pack("<iiI", MIN_SHIFT, LEVELS, 28 + len(blob)) + struct.pack("<7I", *COLUMNS, len(blob)) + blob + struct.pack("<i", len(names))
    return bgzf_compress(head + body + struct.pack("<Q", 0))


def parse_csi(content: bytes) -> dict[str, dict[int, tuple[int, list[tuple[int, int]]]]]:
    """{sequence: {bin: (loff, chunks)}} of an index file."""
    data = b"".join(d for *_, d in bgzf_blocks(content))
    if data[:4] != CSI_MAGIC or struct.unpack_from("<ii", data, 4) != (MIN_SHIFT, LEVELS):
        raise ValueError("not an index of this kind")
    meta = struct.unpack_from("<I", data, 12)[0]
    names = data[16 + 28 : 16 + meta].decode().split("\0")[:-1]
    at, out = 16 + meta + 4, {}
    if struct.unpack_from("<i", data, at - 4)[0] != len(names):
        raise ValueError("the index names other sequences than it holds")
    for name in names:
        n, at, bins = struct.unpack_from("<i", data, at)[0], at + 4, {}
        for _ in range(n):
            bin_, loff, k = struct.unpack_from("<IQi", data, at)
            bins[bin_] = (loff, [struct.unpack_from("<QQ", data, at + 16 + 16 * i) for i in range(k)])
            at += 16 + 16 * k
        out[name] = bins
    return out


def chunks_of(index: dict[int, tuple[int, list[tuple[int, int]]]], beg: int, end: int) -> list[tuple[int, int]]:
    """The chunks that may hold features of a sequence which overlap [beg, end), joined where they touch."""
    last, found, least = max(end - 1, beg), [], 0
    for level in range(LEVELS + 1):
        shift = MIN_SHIFT + 3 * (LEVELS - level)
        for b in range(bin_first(level) + (beg >> shift), bin_first(level) + (last >> shift) + 1):
            if b in index:
                found += index[b][1]
                if level == LEVELS and b == bin_first(level) + (beg >> shift):
                    least = index[b][0]
    out: list[list[int]] = []
    for lo, hi in sorted(c for c in found if c[1] > least):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def _block_lines(source, begin: int, end: int) -> Iterator[str]:
    """Lines of an open file from one virtual offset to another; blocks in between are read one by one."""
    at, within, carry = begin >> 16, begin & 0xFFFF, b""
    while at << 16 < end:
        source.seek(at)
        head = source.read(18)
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError(f"no block at {at}")
        size = struct.unpack("<H", head[16:18])[0] + 1
        rest = source.read(size - 18)
        data = zlib.decompress(rest[:-8], -15)
        if struct.unpack("<II", rest[-8:]) != (zlib.crc32(data), len(data)):
            raise ValueError(f"the block at {at} is damaged")
        stop = (end & 0xFFFF) if at == end >> 16 else len(data)
        *lines, carry = (carry + data[within:stop]).split(b"\n")
        yield from (x.decode() for x in lines)
        at, within = at + size, 0
    if carry:
        yield carry.decode()


def read_region(spark: SparkSession, path: str, index: bytes, seq: str, beg: int, end: int) -> DataFrame:
    """(seq, beg, end, line) of a block-compressed feature file's features that overlap [beg, end) of a sequence.

    Only the chunks that the index names are opened, each by a task, in stores that pyarrow opens (local files, HDFS, object stores). Sequences that the index lacks have no features.
    """
    chunks = chunks_of(parse_csi(index).get(seq, {}), beg, end)
    rows = spark.createDataFrame(chunks, "begin long, behind long").repartition(max(1, min(len(chunks), 64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        for b in batches:
            for lo, hi in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(place) as source:
                    lines = list(_block_lines(source, lo, hi))
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])

    lines = rows.mapInArrow(run, "line string").select(F.regexp_replace("line", r"\r$", "").alias("line"), F.lit(0).alias("voffset"), F.lit(0).alias("end_voffset"))
    return gff_features(lines).where((F.col("seq") == seq) & (F.col("beg") < end) & (F.col("end") > beg)).select("seq", "beg", "end", "line")
