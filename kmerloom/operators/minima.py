"""Minimizers and smallest hashes of texts, taken over whole texts in arrays: md5 of all windows of many texts at once."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.letters import codes_of, complete, groups
from ..plans.tables import importable, spread

#: Windows whose md5 are computed at once.
LANES = 1 << 13
_ROUNDS = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _md5_block(words: list[np.ndarray | int], n: int) -> list[np.ndarray]:
    a, b, c, d = (np.full(n, x, "u4") for x in _START)
    f, t = np.empty(n, "u4"), np.empty(n, "u4")
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, f), np.bitwise_and(f, b, f), np.bitwise_xor(f, d, f)
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, f), np.bitwise_and(f, d, f), np.bitwise_xor(f, c, f)
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, f), np.bitwise_xor(f, d, f)
            g = (3 * i + 5) % 16
        else:
            np.invert(d, t), np.bitwise_or(b, t, f), np.bitwise_xor(f, c, f)
            g = 7 * i % 16
        w = words[g]
        np.add(f, a, f)
        if isinstance(w, int):
            np.add(f, np.uint32((_ROUNDS[i] + w) & 0xFFFFFFFF), f)
        else:
            np.add(f, np.uint32(_ROUNDS[i]), f), np.add(f, w, f)
        np.left_shift(f, np.uint32(_SHIFTS[i]), t), np.right_shift(f, np.uint32(32 - _SHIFTS[i]), f), np.bitwise_or(f, t, f)
        np.add(f, b, f)
        a, d, c, b, f = d, c, b, f, a
    return [x + np.uint32(s) for x, s in zip((a, b, c, d), _START, strict=True)]


def _md5_of_bytes(four: np.ndarray, at: np.ndarray | slice, n: int, out: tuple[np.ndarray, np.ndarray]) -> None:
    """The md5 of ``n`` bytes, 55 at most, from each place of ``at``; ``four`` has the four bytes from each place."""
    total = len(four[at]) if isinstance(at, slice) else len(at)
    for i in range(0, total, LANES):
        own = slice(at.start + i, min(at.start + i + LANES, at.stop)) if isinstance(at, slice) else at[i : i + LANES]
        moved = lambda j: four[slice(own.start + j, own.stop + j) if isinstance(own, slice) else own + j]  # noqa: E731, B023
        words: list[np.ndarray | int] = [np.ascontiguousarray(moved(4 * j)) for j in range(n // 4)]
        rest = n % 4
        words.append((moved(n - rest) & np.uint32((1 << (8 * rest)) - 1)) | np.uint32(0x80 << (8 * rest)) if rest else 0x80)
        words += [0] * (14 - len(words)) + [8 * n, 0]
        a, b, c, d = (x.byteswap().astype("u8") for x in _md5_block(words, min(LANES, total - i)))
        out[0][i : i + LANES], out[1][i : i + LANES] = a << np.uint64(32) | b, c << np.uint64(32) | d


def md5_of_windows(codes: np.ndarray, k: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The md5 (of UTF-8) of each window of ``k`` letters, as its first and last eight bytes, ordered as their hex digits are; of windows that are not ``wanted`` anything.

    Windows of as many bytes go together; those of more than 55 bytes one by one.
    """
    n = max(len(codes) - k + 1, 0)
    high, low = np.zeros(n, "u8"), np.zeros(n, "u8")
    if not n:
        return high, low
    encoded = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    four = np.ndarray((len(encoded) + 60,), "<u4", encoded + bytes(64), strides=(1,))
    if len(encoded) == len(codes) and k <= 55:
        _md5_of_bytes(four, slice(0, n), k, (high, low))
        return high, low
    starts = np.concatenate(([0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))))
    size = np.where(wanted, starts[k:] - starts[:n], 0)
    for of in np.flatnonzero(np.bincount(np.minimum(size, 56))).tolist():
        own = np.flatnonzero(size == of) if of < 56 else np.flatnonzero(size >= of)
        if of == 0:
            continue
        if of < 56:
            out = np.empty(len(own), "u8"), np.empty(len(own), "u8")
            _md5_of_bytes(four, starts[own], of, out)
            high[own], low[own] = out
        else:
            digests = b"".join(hashlib.md5(encoded[i:j]).digest() for i, j in zip(starts[own].tolist(), starts[own + k].tolist(), strict=True))
            high[own], low[own] = np.frombuffer(digests, ">u8").reshape(-1, 2).T
    return high, low


def _least(a: tuple, b: tuple) -> tuple:
    later = (b[0] < a[0]) | ((b[0] == a[0]) & (b[1] < a[1]))
    return tuple(np.where(later, y, x) for x, y in zip(a, b, strict=True))


def _smallest_of_windows(high: np.ndarray, low: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of the first smallest of each ``w`` hashes in a row, and its first eight bytes."""
    now, size = (high, low, np.arange(len(high))), 1
    while size < w:
        step = min(size, w - size)
        now = _least(tuple(x[: len(x) - step] for x in now), tuple(x[step:] for x in now))
        size += step
    return now[2], now[0]


def minimizers_of(texts: list[str | None], k: int, w: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, str, np.ndarray]]:
    """(rows, places in the text, first eight bytes of the hashes, letters, places in the letters) of the minimizers of some texts at a time, in order."""
    before = (-1, -1)
    for rows, firsts, pieces in groups(texts, k + w - 2):
        # between texts stand letters for as many k-mers as a window could take from the next text
        gap = "\0" * max(w - k, 0)
        text = gap.join(pieces)
        if len(text) < k:
            continue
        lengths = np.array([len(p) for p in pieces])
        padded = lengths + len(gap)
        padded[-1] -= len(gap)
        begins = np.cumsum(padded) - padded
        n_kmers = lengths - k + 1
        wide = np.repeat(begins + lengths, padded)
        ok = (np.arange(len(text)) + k <= wide)[: len(text) - k + 1]
        high, low = md5_of_windows(codes_of(text), k, ok)
        high[~ok], low[~ok] = _LAST, _LAST
        tail = np.full(w, _LAST)
        best, hashes = _smallest_of_windows(np.concatenate((high, tail)), np.concatenate((low, tail)), w)
        some = n_kmers > 0
        n_windows = np.where(some, np.maximum(n_kmers - w + 1, 1), 0)
        piece = np.repeat(np.arange(len(pieces)), n_windows)
        at = np.repeat(begins - (np.cumsum(n_windows) - n_windows), n_windows) + np.arange(int(n_windows.sum()))
        row, place = np.array(rows)[piece], best[at] - begins[piece] + np.array(firsts)[piece]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
        if len(row):
            fresh[0] = before != (row[0], place[0])
            before = (row[-1], place[-1])
            yield row[fresh], place[fresh], hashes[at][fresh], text, best[at][fresh]


def _with(fields: T.StructType, added: str) -> T.StructType:
    return T.StructType([*fields.fields, *T._parse_datatype_string(added).fields])


def minimizers(seqs: DataFrame, seq: str, k: int, w: int) -> DataFrame:
    """The other columns with ``pos`` and ``kmer`` of each minimizer."""
    importable(seqs.sparkSession)
    others = [c for c in seqs.columns if c != seq]
    rows = spread(seqs).select(F.col(seq), *others)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = b.select(others) if others else None
            for row, place, _, text, at in minimizers_of(b.column(0).to_pylist(), k, w):
                for i in range(0, len(row), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    own = kept.take(pa.array(row[part])).columns if others else []
                    yield pa.RecordBatch.from_arrays([*own, pa.array(place[part], pa.int64()), pa.array([text[x : x + k] for x in at[part].tolist()], pa.string())], names=[*others, "pos", "kmer"])

    return rows.mapInArrow(find, _with(seqs.select(*others).schema, "pos long, kmer string"))


def known_minimizers(seqs: DataFrame, id_col: str, seq: str, k: int, w: int, known: list[str]) -> DataFrame:
    """(id, n_minimizers, found) of each sequence: its minimizers, and the distinct ones whose hash begins like that of a known k-mer."""
    importable(seqs.sparkSession)
    starts = np.unique(np.array([int.from_bytes(hashlib.md5(x.encode("utf-8", "surrogatepass")).digest()[:8], "big") for x in known], "u8"))
    shared = seqs.sparkSession.sparkContext.broadcast(starts.tobytes())
    rows = spread(seqs.select(F.col(seq), F.col(id_col)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(shared.value, "u8")
        for b in batches:
            n, found = np.zeros(b.num_rows, "i8"), [set() for _ in range(b.num_rows)]
            for row, _, hashes, text, at in minimizers_of(b.column(0).to_pylist(), k, w):
                n += np.bincount(row, minlength=b.num_rows)
                if len(held):
                    hit = np.flatnonzero(held[np.minimum(np.searchsorted(held, hashes), len(held) - 1)] == hashes)
                    for r, x in zip(row[hit].tolist(), at[hit].tolist(), strict=True):
                        found[r].add(text[x : x + k])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(n, pa.int64()), pa.array([list(s) for s in found], pa.list_(pa.string()))], names=[id_col, "n_minimizers", "found"])

    return rows.mapInArrow(find, _with(seqs.select(id_col).schema, "n_minimizers long, found array<string>"))


def smallest_hashes(seqs: DataFrame, id_col: str, seq: str, k: int, size: int) -> DataFrame:
    """(id, hash): of each row the ``size`` smallest md5 of its distinct k-mers, as hex."""
    importable(seqs.sparkSession)
    rows = spread(seqs.select(F.col(seq), F.col(id_col)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best: dict[int, list[tuple[int, int]]] = {}
            for row, _, pieces in groups(b.column(0).to_pylist(), k - 1):
                text, lengths = "".join(pieces), np.array([len(p) for p in pieces])
                if len(text) < k:
                    continue
                ok = complete(lengths, k)[: len(text) - k + 1]
                high, low = md5_of_windows(codes_of(text), k, ok)
                for r, begin, n in zip(row, (np.cumsum(lengths) - lengths).tolist(), (lengths - k + 1).tolist(), strict=True):
                    if n > 0:
                        h, l_ = high[begin : begin + n], low[begin : begin + n]
                        # the smallest by their first bytes, with all that tie with the last
                        values = np.unique(h)
                        near = h <= values[min(size, len(values)) - 1]
                        best[r] = sorted({*best.get(r, ()), *zip(h[near].tolist(), l_[near].tolist(), strict=True)})[:size]
            at = [r for r, own in best.items() for _ in own]
            hashes = [f"{h:016x}{l_:016x}" for own in best.values() for h, l_ in own]
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(at, pa.int64())), pa.array(hashes, pa.string())], names=[id_col, "hash"])

    return rows.mapInArrow(find, _with(seqs.select(id_col).schema, "hash string"))
