"""Operator 11: alignment of two tokenizers by byte-owner arrays.

Both encodings of a text cover the same bytes. ``np.repeat`` writes over every byte which token of A and which of B owns it.
Where the pair of owners changes a new overlap (link) begins; where both change at once the text is cut into groups.

Neither tokenizer has a token that goes on from a character to a following space, so a text is cut before the spaces
that follow a character, and each distinct part is encoded and aligned once by a worker: new parts of a batch together, in
one pair of owner arrays. A text's groups and links are those of its parts, one after another.

A link's count is over the whole corpus: how many links join its two ids. Every text keeps its distinct pairs of ids with
how often it has them; they are summed by Spark before they are shuffled, and the counts come back by a join on the pair: broadcast
if the table of pairs is proven small (``checked_broadcast``), else shuffled, where Spark splits the rows of frequent pairs.

Defined results: null and empty texts have no tokens, nor do those whose tokens' bytes are not the text's (U+2581 in a
text is such a case): zeros and an empty text of groups. Strings of special tokens are plain text. Rows of equal doc_id
are aligned each, and equal texts all count. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import checked_broadcast
from .base import nonempty, prepare, texts_of, written

#: Parts that a worker remembers; beyond it starts anew. Longer parts are not remembered.
MEMO_PARTS, MEMO_CHARS = 400_000, 64
CUT = re.compile(r"(?<=\S)(?= +\S)")
_SPACES = re.compile(r"\s(?: |$)|^\s")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_aligners: dict[tuple[str, str], Aligner] = {}


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


def parts_of(text: str) -> list[str]:
    """The parts of a space and the text, each without the space that it begins with."""
    if _SPACES.search(text) is None:
        return text.split(" ")
    return [p[1:] for p in CUT.split(" " + text)]


class Aligner:
    """Two tokenizers, and what is known of parts: (links as bytes, groups, number of A's and B's tokens), or None for parts that have none."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_level), SentencePieceProcessor(model_file=pieces)
        self.a.encode_special_tokens = True
        letters, vocabulary = byte_letters(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.n_b = self.b.vocab_size()
        self.b_bytes = []
        for i in range(self.n_b):
            piece = self.b.id_to_piece(i)
            byte = _BYTE.fullmatch(piece) if self.b.is_byte(i) else None
            self.b_bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        if any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.n_b)):
            raise ValueError("pieces of this model span words")
        self.a_length, self.b_length = (np.array([len(x) for x in t], "i8") for t in (self.a_bytes, self.b_bytes))
        self.memo: dict[str, tuple[bytes, bytes, int] | None] = {}

    def _aligned(self, parts: list[str]) -> list[tuple[bytes, bytes, int] | None]:
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        ids_b = self.b.encode(parts, num_threads=1)
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        whole = [
            b"".join([a_bytes[i] for i in x]) == raw and b"".join([b_bytes[i] for i in y]) == raw
            for p, x, y in zip(parts, ids_a, ids_b, strict=True) for raw in [b" " + p.encode()]]
        ids_a, ids_b = ([x for x, ok in zip(ids, whole, strict=True) if ok] for ids in (ids_a, ids_b))
        found = iter(self._owned(ids_a, ids_b))
        return [next(found) if ok else None for ok in whole]

    def _owned(self, ids_a: list[list[int]], ids_b: list[list[int]]) -> list[tuple[bytes, bytes, int]]:
        """Links and groups of texts whose tokens cover the same bytes, by owner arrays over all of them."""
        if not ids_a:
            return []
        n_a, n_b = (np.array([len(x) for x in ids], "i8") for ids in (ids_a, ids_b))
        a, b = (np.array([i for x in ids for i in x], "i8") for ids in (ids_a, ids_b))
        of_a = np.repeat(np.arange(len(a), dtype="i4"), self.a_length[a])
        of_b = np.repeat(np.arange(len(b), dtype="i4"), self.b_length[b])
        new_a, new_b = np.ones(len(of_a), bool), np.ones(len(of_b), bool)
        np.not_equal(of_a[1:], of_a[:-1], out=new_a[1:])
        np.not_equal(of_b[1:], of_b[:-1], out=new_b[1:])
        at = np.flatnonzero(new_a | new_b)
        left, right = of_a[at], of_b[at]
        links = (a[left] * self.n_b + b[right]).astype("<i8")
        text = np.repeat(np.arange(len(ids_a)), n_a)
        ends = np.cumsum(np.bincount(text[left], minlength=len(ids_a))) * 8
        # a group begins where both owners change; each token's place in "A's tokens, then B's, group after group"
        cuts = at[new_a[at] & new_b[at]]
        group_a, group_b = (np.searchsorted(cuts, np.flatnonzero(new), side="right") - 1 for new in (new_a, new_b))
        per_a, per_b = (np.bincount(g, minlength=len(cuts)) for g in (group_a, group_b))
        last_a, last_b = np.cumsum(per_a) - 1, np.cumsum(per_b) - 1
        mark_a, mark_b = np.zeros(len(a), "i1"), np.zeros(len(b), "i1")
        mark_a[last_a], mark_b[last_b] = 1, 2
        place_a = np.arange(len(a)) + (np.cumsum(per_b) - per_b)[group_a]
        place_b = np.arange(len(b)) + np.cumsum(per_a)[group_b]
        ids, marks = np.empty(len(a) + len(b), "i8"), np.empty(len(a) + len(b), "i1")
        ids[place_a], ids[place_b], marks[place_a], marks[place_b] = a, b, mark_a, mark_b
        words = [b"%d%c" % (i, m) for i, m in zip(ids.tolist(), np.frombuffer(b",|;", "u1")[marks].tolist(), strict=True)]
        raw, out, lo, first = links.tobytes(), [], 0, 0
        for hi, x, y in zip(ends.tolist(), n_a.tolist(), n_b.tolist(), strict=True):
            out.append((raw[lo:hi], b"".join(words[first : first + x + y])[:-1], x << 32 | y))
            lo, first = hi, first + x + y
        return out

    def align(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes, int, int]]:
        """(links as A's id times B's ids + B's id, groups, number of A's tokens, of B's) of each text."""
        if len(self.memo) > MEMO_PARTS:
            self.memo = {}
        memo = self.memo
        split = [parts_of(t) if t else [] for t in texts]
        new = list({p for parts in split for p in parts if p not in memo})
        for p, found in zip(new, self._aligned(new), strict=True):
            memo[p] = found
        for parts in split:
            found = [memo[p] for p in parts]
            if not found or None in found:
                yield np.zeros(0, "i8"), b"", 0, 0
                continue
            links, groups, sizes = zip(*found, strict=True)
            n = sum(sizes)
            yield np.frombuffer(b"".join(links), "<i8"), b";".join(groups), n >> 32, n & 0xFFFFFFFF
        for p in new:
            if len(p) > MEMO_CHARS:
                del memo[p]


def aligner(byte_level: str, pieces: str) -> Aligner:
    if (byte_level, pieces) not in _aligners:
        _aligners[byte_level, pieces] = Aligner(byte_level, pieces)
    return _aligners[byte_level, pieces]


def aligned(documents: DataFrame, byte_level: str, pieces: str, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(row_, doc_id, n_a, n_b, n_groups, groups, pairs, times) of every row. Row by row: no shuffle.

    groups is ``a1,a2|b1;a3|b2,b3`` (or its sha256 if ``digest``; '' without tokens); pairs are the distinct linked pairs of ids, as A's id times
    B's number of ids + B's id, and times how many of the row's links each has.
    """
    prepare(documents.sparkSession)
    kind = dict(documents.dtypes)[doc_id]
    rows = documents.select(F.monotonically_increasing_id().alias("row_"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in nonempty(batches):
            pairs, times, sizes, groups = [], [], [0], []
            for links, g, n_a, n_b in aligner(byte_level, pieces).align(texts_of(b, "text")):
                own, n = np.unique(links, return_counts=True)
                pairs.append(own)
                times.append(n)
                groups.append((hashlib.sha256(g).hexdigest() if digest and g else g.decode(), n_a, n_b, g.count(b";") + 1 if g else 0))
                sizes.append(sizes[-1] + len(own))
            offsets = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(t))) for x, t in ((pairs, "i8"), (times, "i4"))]
            text_, n_a, n_b, n_groups = zip(*groups, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)), pa.array(text_, pa.string()), *lists], names=["row_", "doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times"])

    return rows.mapInArrow(run, f"row_ long, doc_id {kind}, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<int>")


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """(pair, count, best): how many links of all ``aligned`` rows hold each pair of ids, and whether no other pair of its B id has more."""
    links = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("l_")).select(F.col("l_.pairs").alias("pair"), F.col("l_.times").alias("n_"))
    counts = written(links.groupBy("pair").agg(F.sum("n_").alias("count")), "pairs")
    highest = counts.groupBy((F.col("pair") % n_b).alias("b_")).agg(F.max("count").alias("highest_"))
    return counts.join(highest, F.col("pair") % n_b == F.col("b_")).select("pair", "count", (F.col("count") == F.col("highest_")).alias("best"))


def link_statistics(documents: DataFrame, byte_level: str, pieces: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    from sentencepiece import SentencePieceProcessor

    rows = written(aligned(documents, byte_level, pieces, doc_id, text, digest=True), "aligned")
    counts = checked_broadcast(pair_counts(rows, SentencePieceProcessor(model_file=pieces).vocab_size()))
    links = rows.select("row_", F.explode(F.arrays_zip("pairs", "times")).alias("l_")).select("row_", F.col("l_.pairs").alias("pair"), F.col("l_.times").cast("long").alias("n_"))
    sums = links.join(counts, "pair").groupBy("row_").agg(F.sum("n_").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n_")).otherwise(0)).alias("n_best"), F.sum(F.col("n_") * F.col("count")).alias("count_sum"))
    out = rows.select("row_", "doc_id", "n_a", "n_b", "n_groups", F.col("groups").alias("groups_sha256")).join(sums, "row_", "left").na.fill(0, ["n_links", "n_best", "count_sum"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
