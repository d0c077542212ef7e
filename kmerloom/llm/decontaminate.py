"""Operator 10: benchmark passages in documents, found by the pigeonhole principle and Myers' bit-parallel distance.

Texts and items are compared in lower case with white space as single spaces. An item of n characters may
differ from its place in a text by k = floor(rate * n) insertions, deletions and substitutions. It is split into
k + 1 pieces; in any such place at least one piece stands unchanged. All pieces of all items make one
Aho-Corasick automaton, which reads each whole text once. Each hit says where its item would begin.

The same principle holds for any run of s pieces with s - 1 errors: if an item matches, then so do, from the whole
item down to a single piece, one run within the other. A hit is therefore verified from its piece upwards, over the
runs of 2 and 8 pieces that hold it, and dropped where a run fails, which loses nothing. Hits of an item that pass
and agree to within k make one window, and Myers' algorithm finds the item's least distance in the window.

The items are the small side. They are read in blocks of at most ``BLOCK_BYTES``, so that what is sent to the
executors and held there is bounded; more items mean more passes over the texts.

Defined results: null and empty texts hold no item. Null items and those without a character match nothing. Items
with equal text are reported each. Rows of equal doc_id are searched each; row_ tells them apart. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import filtered, nonempty, prepare

RATE = 0.1
#: Bytes of item texts that are searched for in one pass.
BLOCK_BYTES = 4 << 20

#: Numbers of pieces of the runs by which hits are verified.
RUNS = (2, 8)

#: A worker's last block of items and its matcher. It holds the block itself, so no other can be taken for it.
_built: list[tuple[list, float, Matcher]] = []


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, rate: float = RATE) -> int:
    return int(rate * len(item) + 1e-9)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of the errors + 1 near equal pieces of an item, none empty."""
    n = min(errors + 1, len(item))
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def masks_of(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def least_distance(masks: dict[str, int], n: int, text: str) -> tuple[int, int]:
    """(the least edit distance of an item of n characters to any part of the text, the end of the first such part)."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    positive, negative, score, best, end = full, 0, n, n, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | negative
        xh = (((eq & positive) + positive) ^ positive) | eq
        ph = negative | (full & ~(xh | positive))
        mh = positive & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j + 1
        ph, mh = ph << 1 & full, mh << 1 & full  # the text may begin anywhere, so row 0 stays 0
        positive = mh | (full & ~(xv | ph))
        negative = ph & xv
    return best, end


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        self.items = [(key, text, budget(text, rate), masks_of(text)) for key, text in items if text]
        self.automaton = ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int, tuple]]] = {}
        for k, (_, text, errors, _) in enumerate(self.items):
            parts = pieces(text, errors)
            runs = {}
            for size in RUNS:
                for first in range(0, len(parts), size):
                    own = parts[first : first + size]
                    run = "".join(x for _, x in own)
                    runs[size, first // size] = (own[0][0], len(run), len(own) - 1, masks_of(run))
            for i, (offset, piece) in enumerate(parts):
                # of a run that is the whole item the window decides
                held.setdefault(piece, []).append((k, offset + len(piece) - 1, tuple(r for size in RUNS if 0 < (r := runs[size, i // size])[2] < len(parts) - 1)))
        for piece, places in held.items():
            self.automaton.add_word(piece, places)
        if held:
            self.automaton.make_automaton()
        self.empty = not held

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item key, distance, start, end) of the best place of each item that a prepared text holds; of equals the first."""
        if self.empty or not text:
            return []
        begins: dict[int, set[int]] = {}
        for end, places in self.automaton.iter(text):
            for k, back, runs in places:
                start = end - back
                if k in begins and start in begins[k]:
                    continue
                for offset, length, errors, masks in runs:
                    at = start + offset
                    if least_distance(masks, length, text[max(0, at - errors) : at + length + errors])[0] > errors:
                        break
                else:
                    begins.setdefault(k, set()).add(start)
        out = []
        for k, starts in begins.items():
            key, item, errors, masks = self.items[k]
            n, best = len(item), None
            exact = next((s for s in sorted(starts) if s >= 0 and text.startswith(item, s)), None)
            if exact is not None:
                out.append((key, 0, exact, exact + n))
                continue
            ordered = sorted(starts)
            at = 0
            while at < len(ordered):
                last = at
                while last + 1 < len(ordered) and ordered[last + 1] - ordered[last] <= errors:
                    last += 1
                lo, hi = max(0, ordered[at] - errors), ordered[last] + n + errors
                distance, end = least_distance(masks, n, text[lo:hi])
                if distance <= errors and (best is None or distance < best[0]):
                    best = (distance, lo + end)
                at = last + 1
            if best is not None:
                distance, end = best
                lo = max(0, end - n - errors)
                _, length = least_distance(masks_of(item[::-1]), n, text[lo:end][::-1])
                out.append((key, distance, end - length, end))
        return out


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items with their prepared texts, in blocks of bounded size."""
    block, size = [], 0
    for r in benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null").orderBy("item_id", "text").toLocalIterator():
        item = plain(r["text"])
        if block and size + len(item) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["item_id"], item))
        size += len(item)
    if block:
        yield block


def find_leaks(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row_, doc_id, item_id, distance, start_at, end_at) of every item in every row. No shuffle.

    start_at and end_at are in the prepared text, ``plain(text)``.
    """
    spark = documents.sparkSession
    prepare(spark)
    kinds = dict(documents.dtypes)[doc_id], dict(benchmark.dtypes)[item_id]
    rows = documents.select(F.monotonically_increasing_id().alias("row_"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = ["row_", "doc_id", "item_id", "distance", "start_at", "end_at"]
    schema = f"row_ long, doc_id {kinds[0]}, item_id {kinds[1]}, distance int, start_at long, end_at long"
    out = spark.createDataFrame([], schema)
    for n, block in enumerate(item_blocks(benchmark, item_id, "text", block_bytes)):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = None
            for b in nonempty(batches):
                matcher = matcher or _matcher(shared.value, rate)
                found = [(row, doc, *hit) for row, doc, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for hit in matcher.find(plain(t))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, b.schema.field(i).type if i < 2 else None if i == 2 else pa.int32() if i == 3 else pa.int64()) for i, c in enumerate(zip(*found, strict=True))], names=names)

        hits = rows.mapInArrow(run, schema)
        out = out.unionByName(hits) if n else hits
    return out


def _matcher(block: list[tuple[int, str]], rate: float) -> Matcher:
    if not _built or _built[0][0] is not block or _built[0][1] != rate:
        _built[:] = [(block, rate, Matcher(block, rate))]
    return _built[0][2]


def decontaminate(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, text: str = "text", item_id: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of documents that hold no benchmark item, with all their columns. No shuffle; a filter for each block of items."""
    out = documents
    for block in item_blocks(benchmark, item_id, "text", block_bytes):
        shared = documents.sparkSession.sparkContext.broadcast(block)
        out = filtered(out, lambda texts, shared=shared: [not _matcher(shared.value, rate).find(plain(t)) for t in texts], text)
    return out
