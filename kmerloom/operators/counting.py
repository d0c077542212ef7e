"""Exact k-mer counts behind a counting sketch, so that k-mers seen too few times never enter the shuffle.

Every task counts its k-mers in an array of small counters; a k-mer has two of them, both in one block. The arrays are added up
page by page by Spark. A k-mer whose smaller counter is below the minimum cannot reach it, as counters are shared but never too
small, so only the others are shuffled, as runs, and counted exactly. The sketch's size follows the letters up to ``MOST_BITS``; what is sent to
the tasks is one bit a counter, 8 MB at most. With so many more letters than counters that it would let nearly all k-mers through no sketch is made:
the counts are those of ``runs``, exact as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.letters import groups
from ..plans.tables import spread
from . import runs
from .kmers import blocks

#: Counters as a power of two, at least and at most; counters of a block and of a page.
LEAST_BITS, MOST_BITS, BLOCK_BITS, PAGE_BITS = 16, 26, 9, 16
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def kmer_hashes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the k-mers of all texts, and where each begins in the joined text.

    Hashes of stretches are built up from stretches of half their length, so k letters take log k steps.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    ends = np.cumsum([len(t) for t in texts])
    starts = np.arange(len(codes))
    starts = starts[starts + k <= np.repeat(ends, [len(t) for t in texts])] if len(codes) else starts
    if not len(starts):
        return np.zeros(0, "u8"), starts
    out, size, power, half, done = np.zeros(len(codes), "u8"), 1, _P1, codes + np.uint64(1), 0
    while True:
        if k & size:
            moved = np.zeros(len(codes), "u8")
            moved[: len(codes) - done] = half[done:]
            out = out * power + moved
            done += size
        if size * 2 > k:
            break
        ahead = np.zeros(len(codes), "u8")
        ahead[: len(codes) - size] = half[size:]
        half, power, size = half * power + ahead, np.uint64(int(power) ** 2 % (1 << 64)), size * 2
    h = out[starts]
    h ^= h >> np.uint64(32)
    h *= _P2
    return h ^ (h >> np.uint64(29)), starts


def _counters(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two counters of each hash: one block, two places in it."""
    block = (h >> np.uint64(64 - (bits - BLOCK_BITS))) << np.uint64(BLOCK_BITS)
    low = np.uint64((1 << BLOCK_BITS) - 1)
    return (block | (h & low)).astype("i8"), (block | ((h >> np.uint64(BLOCK_BITS)) & low)).astype("i8")


def sketch(cut: DataFrame, k: int, least: int, bits: int) -> DataFrame:
    """(page, open): which counters of each page reach ``least``, as bits, over the k-mers of all pieces of text in the column ``block``."""
    top, page = min(least, 255), 1 << PAGE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, "u1")
        for b in batches:
            own = _counters(kmer_hashes(b.column(0).to_pylist(), k)[0], bits)
            for at in (own[0], own[1][own[1] != own[0]]):
                slots, n = np.unique(at, return_counts=True)
                counts[slots] = np.minimum(counts[slots].astype("i8") + n, top)
        for p in np.flatnonzero(counts.reshape(-1, page).any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([counts[p * page : (p + 1) * page].tobytes()])], names=["page", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= top).tobytes()])], names=["page", "open"])

        now, total = None, None
        for b in batches:
            for p, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if p != now:
                    if now is not None:
                        yield opened()
                    now, total = p, np.zeros(page, "i8")
                total += np.frombuffer(counts.as_buffer(), "u1")
        if now is not None:
            yield opened()

    pages = cut.select("block").mapInArrow(count, "page int, counts binary")
    return pages.repartition("page").sortWithinPartitions("page").mapInArrow(add, "page int, open binary")


def counter_bits(letters: int, least: int) -> int | None:
    """The sketch's size for so many letters; None where k-mers would fill it up to ``least`` on average, so that it let nearly all of them through."""
    bits = min(max(letters.bit_length() + 1, LEAST_BITS), MOST_BITS)
    return None if 2 * letters >= least << bits else bits


def prefiltered_counts(seqs: DataFrame, seq: str, k: int = 31, least: int = 5, bits: int | None = None) -> DataFrame:
    """(kmer, n) of the k-mers that stand ``least`` times or more in all sequences; equal to ``min_count(counts(...))``.

    Null and short sequences have no k-mers.
    """
    letters = int(seqs.agg(F.coalesce(F.sum(F.length(seq)), F.lit(0))).first()[0])
    bits = counter_bits(letters, least) if bits is None else bits
    texts = spread(seqs.select(F.col(seq).alias("seq")))
    if bits is None:
        return runs.counts(texts, "seq", k, least=least, letters=letters)
    cut = blocks(seqs.select(F.col(seq).alias("seq")), "seq", k).select("block")
    size = (1 << PAGE_BITS) >> 3
    reached = np.zeros((1 << bits) >> 3, "u1")
    for p, open_ in sketch(cut, k, least, bits).toLocalIterator():  # 8 MB at most
        reached[p * size : (p + 1) * size] = np.frombuffer(open_, "u1")
    shared = seqs.sparkSession.sparkContext.broadcast(reached.tobytes())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(shared.value, "u1")
        is_open = lambda at: (held[at >> 3] >> (7 - (at & 7)).astype("u1")) & 1
        for b in batches:
            for _, _, texts in groups(b.column(0).to_pylist(), k - 1):
                h, starts = kmer_hashes(texts, k)
                one, two = _counters(h, bits)
                at = starts[(is_open(one) & is_open(two)) == 1]
                if len(at):
                    # stretches of k-mers in a row; with one letter a k-mer, texts begin anew
                    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | np.isin(at[1:], np.cumsum([len(t) for t in texts])))))
                    text, last = "".join(texts), np.append(first[1:], len(at)) - 1
                    yield pa.RecordBatch.from_arrays([pa.array([text[i : j + k] for i, j in zip(at[first].tolist(), at[last].tolist(), strict=True)], pa.string())], names=["seq"])

    # k-mers that are left go on as runs, like all k-mers of ``runs.counts``
    return runs.counts(texts.mapInArrow(keep, "seq string"), "seq", k, least=least, letters=letters)
