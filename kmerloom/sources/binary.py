"""Binary files: float matrices, .npy files, and block-compressed (BGZF) text."""

from __future__ import annotations

import ast
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 65_280
#: The empty block that ends a BGZF file.
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def parse_npy(content: bytes) -> np.ndarray:
    """A version 1 .npy file of little-endian floats in two dimensions."""
    if content[:6] != b"\x93NUMPY" or content[6] != 1:
        raise ValueError("not a version 1 .npy file")
    n = struct.unpack("<H", content[8:10])[0]
    header = ast.literal_eval(content[10 : 10 + n].decode("latin1"))
    if header["descr"] != "<f4" or header["fortran_order"] or len(header["shape"]) != 2:
        raise ValueError("a two-dimensional array of <f4 in C order is needed")
    return parse_f32(content[10 + n :], header["shape"][1], header["shape"][0])


def parse_f32(content: bytes, dim: int, rows: int | None = None) -> np.ndarray:
    """Raw little-endian floats; the length must fit."""
    if dim <= 0 or len(content) % (4 * dim) or (rows is not None and len(content) != 4 * dim * rows):
        raise ValueError("the file's length does not fit its shape")
    return np.frombuffer(content, "<f4").reshape(-1, dim)


def npy_bytes(matrix: np.ndarray) -> bytes:
    header = f"{{'descr': '<f4', 'fortran_order': False, 'shape': {matrix.shape}, }}"
    header += " " * (-(len(header) + 11) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(header)) + header.encode("latin1") + np.ascontiguousarray(matrix, "<f4").tobytes()


def read_matrices(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """(file, ord, v) of .npy files, or of raw float files where ``dim`` is given. A file is a row before it is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                m = parse_npy(content) if dim is None else parse_f32(content, dim)
                for k in range(0, len(m), 4096):
                    part = m[k : k + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(k, k + len(part))), pa.array(list(part), pa.list_(pa.float32()))], names=["file", "ord", "v"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, ord long, v array<float>")


def bgzf_block(data: bytes, level: int = 6) -> bytes:
    """One block of at most BLOCK_BYTES; stored where it would not shrink enough."""
    for how in (level, 0):
        packer = zlib.compressobj(how, zlib.DEFLATED, -15)
        body = packer.compress(data) + packer.flush()
        if len(body) + 26 <= 65_536:
            break
    return struct.pack("<4BI2BH2B2H", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def bgzf_compress(data: bytes, level: int = 6) -> bytes:
    return b"".join(bgzf_block(data[k : k + BLOCK_BYTES], level) for k in range(0, len(data), BLOCK_BYTES)) + END_BLOCK


def bgzf_blocks(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(compressed offset, uncompressed offset, data) of each block; lengths and checksums are verified."""
    at, out = 0, 0
    while at < len(content):
        head = content[at : at + 18]
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"BC":
            raise ValueError(f"no BGZF block at {at}")
        size = struct.unpack("<H", head[16:18])[0] + 1
        body, tail = content[at + 18 : at + size - 8], content[at + size - 8 : at + size]
        try:
            data = zlib.decompress(body, -15)
        except zlib.error as e:
            raise ValueError(f"the block at {at} is damaged or cut short") from e
        if len(tail) < 8 or struct.unpack("<II", tail) != (zlib.crc32(data), len(data)):
            raise ValueError(f"the block at {at} is damaged")
        yield at, out, data
        at, out = at + size, out + len(data)


def gzi_entries(content: bytes) -> list[tuple[int, int]]:
    """(compressed, uncompressed) offsets of blocks after the first; the empty last block is left out."""
    return [(a, u) for a, u, data in bgzf_blocks(content) if a and data]


def read_bgzf_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, line, voffset) of block-compressed text files, voffset the virtual offset at which a line begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, carry, begin = [], b"", None
                for at, _, data in bgzf_blocks(content):
                    pos = 0
                    while pos < len(data):
                        if begin is None:
                            begin = at << 16 | pos
                        end = data.find(b"\n", pos)
                        if end < 0:
                            carry, pos = carry + data[pos:], len(data)
                        else:
                            rows.append((name, len(rows), (carry + data[pos:end]).rstrip(b"\r").decode(), begin))
                            carry, begin, pos = b"", None, end + 1
                if begin is not None:
                    rows.append((name, len(rows), carry.decode(), begin))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "ord", "line", "voffset"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, ord long, line string, voffset long")
