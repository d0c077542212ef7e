"""Sequence files of any kind as one data source, told apart by their first bytes and not by their names.

``spark.read.format("sequence_files")`` reads FASTA and FASTQ, plain or gzipped (one member or many), in one folder, into one table. A plain file is cut into ranges
of bytes, each a task: a range owns the records that begin in it, and reads on to the end of its last one. Where records begin can be told from any place: a FASTA
record at '>' after a line feed; a FASTQ record at a line with '@' whose next but one begins with '+', as no sequence does. Gzipped files are one task each, read
in pieces. Tasks hold a batch of records.

The source opens files through pyarrow: local files, HDFS and object stores. Names are listed, and first bytes read, on the driver.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, at long, header string, seq string, qual string"
#: Bytes of a range, and records and characters of a batch.
SPLIT_BYTES, BATCH_RECORDS, BATCH_CHARS = 64 << 20, 4096, 8 << 20


@dataclass
class Range(InputPartition):
    file: str
    kind: str  # '@', '>' or '' for a file without records
    packed: bool
    begin: int
    end: int


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _first_letter(stream) -> str:
    """The first letter of a stream that is no white space, '' if there is none."""
    while piece := stream.read(1 << 16):
        if piece := piece.lstrip(b"\r\n\t "):
            return piece[:1].decode("latin-1")
    return ""


def _lines(stream, at: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) from a place on."""
    for line in stream:
        yield at, line.rstrip(b"\n").rstrip(b"\r")
        at += len(line)


def _fasta(lines: Iterator[tuple[int, bytes]], begin: int, end: int) -> Iterator[tuple[int, str, str, None]]:
    at, header, body = -1, b"", []
    for place, line in lines:
        if line.startswith(b">"):
            if at >= 0:
                yield at, header.decode(), b"".join(body).decode(), None
            if place >= end:
                return
            at, header, body = place, line[1:], []
        elif at >= 0:
            body.append(line)
        elif begin == 0 and line.strip():
            raise ValueError("FASTA: letters before the first header")
    if at >= 0:
        yield at, header.decode(), b"".join(body).decode(), None


def _fastq(lines: Iterator[tuple[int, bytes]], begin: int, end: int) -> Iterator[tuple[int, str, str, str]]:
    held: list[tuple[int, bytes]] = []
    synced = begin == 0
    for place, line in lines:
        if not held and not line:
            continue  # blank lines stand between records only
        if not held and place >= end and synced:
            return
        held.append((place, line))
        if not synced:
            # lines are tried until one begins a record
            while held and not held[0][1].startswith(b"@"):
                held.pop(0)
            if len(held) < 3:
                continue
            if not held[2][1].startswith(b"+"):
                held.pop(0)
                while held and not held[0][1].startswith(b"@"):
                    held.pop(0)
                continue
            if held[0][0] >= end:
                return
            synced = True
        if len(held) == 4:
            (at, head), (_, seq), (_, plus), (_, qual) = held
            if not head.startswith(b"@"):
                raise ValueError("FASTQ: a header without @")
            if not plus.startswith(b"+"):
                raise ValueError("FASTQ: a third line without +")
            if len(seq) != len(qual):
                raise ValueError("FASTQ: sequence and quality of unequal length")
            yield at, head[1:].decode(), seq.decode(), qual.decode()
            held = []
    if synced and held:
        raise ValueError("FASTQ: a partial record")


class SequenceReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, place = _store(self.path)
        info = store.get_file_info(place)
        if info.type == fs.FileType.NotFound:
            raise ValueError(f"there is no {self.path}")
        files = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(place, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        out: list[Range] = []
        for f in sorted(files, key=lambda f: f.path):
            with store.open_input_stream(f.path, compression=None) as raw:
                packed = raw.read(2) == b"\x1f\x8b"
            with store.open_input_file(f.path) as raw:
                kind = _first_letter(gzip.GzipFile(fileobj=raw) if packed else raw)
            if kind not in ("@", ">", ""):
                raise ValueError(f"{f.path}: neither FASTA nor FASTQ")
            if not kind:
                continue
            step = max(1, f.size if packed else self.split_bytes)
            out += [Range(f.path, kind, packed, k, k + step if k + step < f.size else 1 << 62) for k in range(0, f.size, step)]
        return out or [Range("", "", False, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.kind:
            return
        store, _ = _store(self.path)
        with store.open_input_file(partition.file) as raw:
            if partition.packed:
                lines = _lines(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20), 0)
            else:
                # a line that begins before the range belongs to the range before it
                raw.seek(max(partition.begin - 1, 0))
                stream = io.BufferedReader(raw, 1 << 20)
                skipped = len(stream.readline()) if partition.begin else 0
                lines = _lines(stream, partition.begin - 1 + skipped if partition.begin else 0)
            records, rows, chars = (_fasta if partition.kind == ">" else _fastq)(lines, partition.begin, partition.end), [], 0
            try:
                for at, header, seq, qual in records:
                    rows.append((partition.file, at, header, seq, qual))
                    chars += len(seq)
                    if len(rows) >= BATCH_RECORDS or chars >= BATCH_CHARS:
                        yield _batch(rows)
                        rows, chars = [], 0
            except (ValueError, EOFError, gzip.BadGzipFile) as e:
                raise ValueError(f"{partition.file}: {e}") from e
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["file", "at", "header", "seq", "qual"])


class SequenceFiles(DataSource):
    """FASTA and FASTQ files, plain or gzipped: (file, at, header, seq, qual), at the place in the (unpacked) file where a record begins; qual is null for FASTA.

    Options: path, a file or a folder; splitBytes, the bytes of a range. Empty files have no records. Fails on a first letter other than '@' and '>', on letters before a
    first header, on headers without '@', third lines without '+', sequences and qualities of unequal length, partial records and cut gzip files.
    """

    @classmethod
    def name(cls) -> str:
        return "sequence_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SequenceReader:
        return SequenceReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("sequence_files")`` known to a session."""
    from ..plans.tables import importable

    importable(spark)
    spark.dataSource.register(SequenceFiles)
