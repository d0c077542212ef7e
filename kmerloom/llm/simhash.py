"""Operator 9: SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has 64 bits; a bit is 1 if it is set in over half of the XXH64 values of the text's word
shingles. Two fingerprints link if they differ in ``distance`` bits or fewer.

Links are found among distinct fingerprints. The 64 bits are grouped into m partitions, correlated bits
together, each with a threshold t_i >= -1; where sum(t_i) = distance - m + 1, two fingerprints that link must
differ in at most t_i bits in some partition i. A dynamic program picks m and the thresholds with the fewest
expected signatures and candidates, from the bits' frequencies and correlations over all fingerprints. A
fingerprint has a signature for each choice of t_i bits of partition i that are left out; fingerprints that
share a signature are candidates and are verified on all 64 bits.

Candidates are never written as pairs. Fingerprints of a signature meet in one place, where a search from each
in turn takes away what it reaches, so a dense group costs one pass over it. Signatures held by more than
``HOT`` fingerprints are split on further exact blocks of the bits outside their partition first (of
distance + 1 blocks one must be equal), by Spark and then again within a task. What is passed on is one edge
for each fingerprint and signature at most; components over edges and copies give each text its component.

``first_of_each_group`` keeps one text of each group of similar texts. Its candidates come from the same search over wider
fingerprints, planned for the largest distance that a given cost allows, and from an exact prefix join for what is then still
apart; the sets of shingles themselves decide.

Defined results: null and empty texts have fingerprint zero, which links like any other. Rows with null doc_id
count as members but never give a component its name. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from ..plans.tables import checked_broadcast
from .base import free_name, nonempty, prepare, remove, written

BITS = 64
#: Fingerprints of one signature beyond which the signature is split.
HOT = 4096
ALL = (1 << 64) - 1
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str, shingle: int, seed: int = 42) -> list[int]:
    """XXH64 of the text's word shingles, repeats included. Words lie between ASCII white space; A-Z in lower case."""
    words = text.encode().lower().split()
    if not words:
        return []
    joined, n = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)]


_SHIFTS, _LANES = np.arange(8, dtype="u8"), np.uint64(0x0101010101010101)


def majorities(hashes: list[np.ndarray], chunk: int = 1 << 16) -> np.ndarray:
    """For each array of 64-bit hashes the number whose bits are those set in over half of them; 0 for an empty one.

    The eight bits of each byte are counted in the bytes of eight numbers, so 255 hashes can be added up before a byte is full.
    """
    out, sizes = np.zeros(len(hashes), "<u8"), np.array([len(h) for h in hashes])
    some = np.flatnonzero(sizes)
    for lo, hi in _stretches(sizes[some], chunk):
        at = some[lo:hi]
        n = sizes[at]
        h, first = np.concatenate([hashes[i] for i in at.tolist()]), np.cumsum(n) - n
        full = -(-n // 255)  # sums for each array
        cuts = np.repeat(first, full) + 255 * (np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full))
        sums = np.zeros((len(cuts), 8), "<u8")
        for k in range(0, len(cuts), chunk // 255 + 1):
            own = cuts[k : k + chunk // 255 + 1]
            end = cuts[k + len(own)] if k + len(own) < len(cuts) else len(h)
            sums[k : k + len(own)] = np.add.reduceat((h[own[0] : end, None] >> _SHIFTS) & _LANES, own - own[0], axis=0)
        counts = np.add.reduceat(sums.view("u1").reshape(-1, 8, 8), np.cumsum(full) - full, axis=0, dtype="i8")
        bits = (counts * 2 > n[:, None, None]).transpose(0, 2, 1).reshape(len(n), BITS)
        out[at] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _stretches(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of arrays with about ``most`` elements together, one array at least."""
    part = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True)) if len(sizes) else []


def fingerprints(documents: DataFrame, keys: list[str], text: str = "text", shingle: int = 3) -> DataFrame:
    """The key columns and fp, the fingerprint's bits as a signed number. Row by row: no shuffle."""
    prepare(documents.sparkSession)
    rows = documents.select(*keys, F.col(text).alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in nonempty(batches):
            fps = majorities([np.array(word_hashes(t or "", shingle), "<u8") for t in b.column(len(keys)).to_pylist()]).view("i8")
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(fps)], names=[*keys, "fp"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(keys)], T.StructField("fp", T.LongType())]))


def bit_statistics(distinct: DataFrame, words: tuple[str, ...] = ("fp",)) -> tuple[int, np.ndarray]:
    """The number of distinct fingerprints and how many have bits i and j, summed by partition. A fingerprint's bits are those of its words."""
    size = BITS * len(words)
    i, j = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((size, size))
        for b in nonempty(batches):
            x = np.unpackbits(np.stack([c.to_numpy() for c in b.columns], 1).astype("<i8").view("u1"), axis=1, bitorder="little").astype("f4")
            n, both = n + len(x), both + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i * size + j, -1)), pa.array(np.append(both[i, j], n))], names=["k", "v"])

    n, both = 0, np.zeros(size * size)
    sums = distinct.select(*words).mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    for k, v in zip(sums["k"].to_pylist(), sums["v"].to_pylist(), strict=True):
        if k < 0:
            n = int(v)
        else:
            both[k] = v
    both = both.reshape(size, size)
    return n, both + np.triu(both, 1).T


def grouped_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m partitions of near equal size, each grown by the bit most correlated with what it has."""
    bits = len(both)
    if n < 2:
        return [list(range(i * bits // m, (i + 1) * bits // m)) for i in range(m)]
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / n - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, parts = np.ones(bits, bool), []
    for i in range(m):
        best = np.where(left, np.where(left, corr, -1).max(1), -2)
        group = [int(best.argmax())]
        left[group[0]] = False
        tie = corr[group[0]].copy()
        while len(group) < (i + 1) * bits // m - i * bits // m:
            group.append(int(np.where(left, tie, -1).argmax()))
            left[group[-1]] = False
            tie += corr[group[-1]]
        parts.append(sorted(group))
    return parts


def expected_share(p: np.ndarray, bits: list[int], t: int) -> float:
    """The share of pairs expected to differ in at most t of the bits."""
    if t < 0:
        return 0.0
    differ = np.zeros(t + 1)
    differ[0] = 1
    for b in bits:
        q = 2 * p[b] * (1 - p[b])
        differ = differ * (1 - q) + np.concatenate(([0], differ[:-1])) * q
    return float(differ.sum())


def cheapest(n: int, both: np.ndarray, distance: int, parts: list[list[int]]) -> tuple[float, list[tuple[list[int], int]]]:
    """(cost, [(bits, threshold)]) of the thresholds for given partitions with the least expected signatures plus candidates."""
    p, m = np.diag(both) / max(n, 1), len(parts)
    total = distance - m + 1
    # table: sum of thresholds so far -> (cost, thresholds)
    table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for i, bits in enumerate(parts):
        costs = {}
        for t in range(-1, min(distance, 3) + 1):
            if comb(len(bits), max(t, 0)) <= 600:
                signatures = n * comb(len(bits), t) if t >= 0 else 0
                # a signature's row is written and sorted; a candidate only costs a comparison
                costs[t] = 20 * signatures + 0.5 * n * n * expected_share(p, bits, t)
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for so_far, (cost, chosen) in table.items():
            for t, more in costs.items():
                if so_far + t - (m - i - 1) <= total and cost + more < step.get(so_far + t, (float("inf"),))[0]:
                    step[so_far + t] = (cost + more, (*chosen, t))
        table = step
    if total not in table:
        return float("inf"), []
    return table[total][0], [(bits, t) for bits, t in zip(parts, table[total][1], strict=True) if t >= 0]


def plan(n: int, both: np.ndarray, distance: int = 3) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of the partitions to probe, by the least expected signatures plus candidates."""
    return min((cheapest(n, both, distance, grouped_bits(n, both, m)) for m in range(1, distance + 3)), key=lambda x: x[0])[1]


def widest_plan(n: int, both: np.ndarray, budget: float) -> tuple[int, list[tuple[list[int], int]]]:
    """(distance, plan) of the largest distance that can be planned at a cost of ``budget`` for each fingerprint, in the units of ``cheapest``."""
    grouped: dict[int, list[list[int]]] = {}
    best: tuple[int, list[tuple[list[int], int]]] = (0, [(list(range(len(both))), 0)])
    for distance in range(1, len(both) // 4):
        found = []
        for m in range(max(1, distance // 2), distance + 3):
            if m not in grouped:
                grouped[m] = grouped_bits(n, both, m)
            found.append(cheapest(n, both, distance, grouped[m]))
        cost, parts = min(found, key=lambda x: x[0])
        if cost > budget * max(n, 1):
            break
        best = (distance, parts)
    return best


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def signature_masks(parts: list[tuple[list[int], int]]) -> list[tuple[int, int]]:
    """(mask of the bits kept, mask of the partition) of every signature."""
    return [(mask_of([b for b in bits if b not in gone]), mask_of(bits)) for bits, t in parts for gone in combinations(bits, t)]


def blocks_of(bits: list[int], count: int) -> list[int]:
    """Masks of ``count`` blocks that share out the bits."""
    return [mask_of(bits[i * len(bits) // count : (i + 1) * len(bits) // count]) for i in range(count)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def words_of_mask(mask: int, words: int) -> list[int]:
    return [mask >> BITS * w & ALL for w in range(words)]


def block_keys(fps: np.ndarray, masks: list[int]) -> np.ndarray:
    """A number for the masked bits of each fingerprint: equal bits have equal numbers; more need not."""
    keys = np.zeros(len(fps), "u8")
    for w, mask in enumerate(masks):
        keys = keys * _SPREAD + (fps[:, w] & np.uint64(mask))
    return keys


def edges_within(fps: np.ndarray, distance: int, outside: int, reach: int, limit: int = HOT) -> np.ndarray:
    """Pairs (rows of two places) of distinct fingerprints, rows of words, that differ in ``reach`` bits at most: enough of them that their
    chains are the same as those of all pairs that differ in ``distance`` bits at most.

    ``outside`` masks the bits in which they may differ. Up to ``limit`` they are searched directly: what one
    reaches is taken away, and so on from there. More are split on blocks of the bits left, of which one must be
    equal, as long as that splits them.
    """
    n, words = fps.shape
    bits = [b for b in range(BITS * words) if outside >> b & 1]
    found = [np.zeros((0, 2), "i8")]
    if n > limit and len(bits) >= 2 * (distance + 1):
        label = np.arange(n)
        for block in blocks_of(bits, distance + 1):
            keys = block_keys(fps, words_of_mask(block, words))
            order = np.argsort(keys, kind="stable")
            edges = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1], [True])))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if hi - lo > 1:
                    members = order[lo:hi]
                    pairs = members[edges_within(fps[members], distance, outside & ~block, reach, limit)]
                    found.append(pairs[_join(label, pairs)])
        return np.concatenate(found)
    left = np.arange(n)
    while len(left):
        frontier, left, together = [left[0]], left[1:], [left[:1]]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]).sum(1, dtype="i8") <= reach
            if near.any():
                reached = left[near]
                found.append(np.stack([reached, np.full(len(reached), at)], 1))
                frontier.extend(reached.tolist())
                together.append(reached)
                left = left[~near]
        if reach > distance and len(members := np.concatenate(together)) > 2:
            found.append(nearest_of_each(fps, np.sort(members)))
    return np.concatenate(found)


def nearest_of_each(fps: np.ndarray, members: np.ndarray, block: int = 128) -> np.ndarray:
    """Pairs of each of the members with the nearest other one, the first of equals."""
    near = np.zeros(len(members), "i8")
    for k in range(0, len(members), block):
        own = members[k : k + block]
        differ = np.bitwise_count(fps[own][:, None] ^ fps[members][None]).sum(2, dtype="i4")
        differ[np.arange(len(own)), np.arange(k, k + len(own))] = np.iinfo("i4").max
        near[k : k + len(own)] = differ.argmin(1)
    return np.stack([members, members[near]], 1)


def links_within(fps: np.ndarray, distance: int, outside: int, limit: int = HOT) -> np.ndarray:
    """For each of the distinct fingerprints (one word each) the smallest that a chain of links within them reaches."""
    label = np.arange(len(fps))
    _join(label, edges_within(fps.reshape(-1, 1), distance, outside, distance, limit))
    return np.array([_find(label, i) for i in range(len(label))], dtype=label.dtype)


def _find(label: np.ndarray, i: int) -> int:
    while label[i] != i:
        label[i] = label[label[i]]
        i = label[i]
    return i


def _join(label: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Join pairs in a union-find table; which of them joined what was apart."""
    new = np.zeros(len(pairs), bool)
    for i, (x, y) in enumerate(pairs.tolist()):
        x, y = _find(label, x), _find(label, y)
        if x != y:
            label[max(x, y)] = min(x, y)
            new[i] = True
    return new


def link_edges(distinct: DataFrame, parts: list[tuple[list[int], int]], distance: int = 3, reach: int | None = None, words: tuple[str, ...] = ("fp",)) -> DataFrame:
    """(a, b): links between distinct fingerprints, by their names (column fp), that differ in ``reach`` bits at most (``distance`` if
    not given); enough that their chains are the same as those of all links of ``distance`` bits at most.

    The bits of a fingerprint are those of the columns ``words``, by default of its name itself.
    """
    spark = distinct.sparkSession
    prepare(spark)
    masks, reach, n_words = signature_masks(parts), distance if reach is None else reach, len(words)
    every = (1 << BITS * n_words) - 1
    outside_of = [every & ~partition for _, partition in masks]

    def masked(mask: int):
        own = [F.col(w).bitwiseAND(F.lit(_signed(m))) for w, m in zip(words, words_of_mask(mask, n_words), strict=True) if m]
        return own[0] if n_words == 1 else F.xxhash64(*own)  # equal bits have equal keys; more need not

    columns = list(dict.fromkeys(("fp", *words)))
    keyed = distinct.select(*columns, F.explode(F.array(*(F.struct(F.lit(i).alias("sig"), masked(keep).alias("key")) for i, (keep, _) in enumerate(masks)))).alias("s")).select(*columns, "s.sig", "s.key")
    counts = keyed.groupBy("sig", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks_for = [[words_of_mask(x, n_words) for x in blocks_of([b for b in range(BITS * n_words) if not partition >> b & 1], distance + 1)] for _, partition in masks]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in nonempty(batches):
            sig, fps = b.column(0).to_numpy(), np.stack([b.column(b.schema.get_field_index(w)).to_numpy() for w in words], 1).view("u8")
            for s in np.unique(sig).tolist():
                own = sig == s
                part, x = b.filter(pa.array(own)), fps[own]
                for sub, block in enumerate(blocks_for[s]):
                    yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(np.full(len(x), sub, "i4")), pa.array(block_keys(x, block).view("i8")), *part.columns[4:]], schema=part.schema)

    # signatures of one fingerprint are no candidates; those of very many are split
    members = lambda which: keyed.join(counts.where(which), ["sig", "key"]).select("sig", "key", F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("subkey"), *columns)
    hot = members(F.col("n") > HOT)
    members = members(F.col("n") <= HOT).unionByName(hot.mapInArrow(split, hot.schema))
    keys = ["sig", "key", "sub", "subkey"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # names and words of the signature that goes on
        last: tuple | None = None

        def edges(sig: int, groups: list[tuple[np.ndarray, np.ndarray]]):
            names, fps = (np.concatenate(x) for x in zip(*groups, strict=True))
            order = np.argsort(names)  # a search begins at the same one in whatever signature they meet
            names, fps = names[order], fps[order]
            pairs = edges_within(fps, distance, outside_of[sig], reach)
            return names[pairs[:, 0]], names[pairs[:, 1]]

        for b in nonempty(batches):
            columns_ = [b.column(i).to_numpy() for i in range(4)]
            names = b.column(4).to_numpy()
            fps = np.stack([b.column(b.schema.get_field_index(w)).to_numpy() for w in words], 1).view("u8")
            change = np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns_]), [True]))
            cuts, found = np.flatnonzero(change), []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                key = tuple(int(c[lo]) for c in columns_)
                if key != last:
                    if last and sum(len(x) for x, _ in held) > 1:
                        found.append(edges(last[0], held))
                    held, last = [], key
                held.append((names[lo:hi], fps[lo:hi]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["a", "b"])
        if last and sum(len(x) for x, _ in held) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in edges(last[0], held)], names=["a", "b"])

    return members.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def named_components(docs: DataFrame, edges_of) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of a table (doc_id, fp); root tells components apart that have no id.

    ``edges_of`` gives the edges of a table of distinct fingerprints.
    """
    distinct = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    linked = components(edges_of(distinct.select("fp")))
    named = distinct.join(linked, distinct["fp"] == linked["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    out = written(named.join(roots, "root").select("fp", "root", "component_id"), "components")
    remove(distinct)
    return out


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    docs = written(fingerprints(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ["doc_id"], "text", shingle), "fingerprints")
    # docs may hold one fingerprint very often: a plain join, whose skewed partitions Spark splits
    return docs.join(named_components(docs, lambda distinct: link_edges(distinct, plan(*bit_statistics(distinct), distance), distance)), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Similarity: wide fingerprints

#: Sets of shingles are similar if their Jaccard similarity is at least this fraction.
SIMILAR = (4, 5)
#: 64-bit words of a wide fingerprint, the bits in which texts that share a signature may differ to be candidates, and what a plan
#: may cost for each fingerprint. Sets of similarity (Jaccard) j differ in each bit with probability acos(2j / (1 + j)) / pi, 0.1515
#: at 0.8: in 38.8 of 256 bits, with a deviation of 5.7. No plan for so many bits is cheaper than comparing all; the distance that is planned for
#: is the largest that the cost allows, and what it misses is left to ``prefix_pairs``.
WIDE_WORDS, WIDE_REACH, WIDE_BUDGET = 4, 47, 600
#: Counters that shingles share, by which the rarer ones come first in a set's order.
RARITY = 1 << 16
#: Sets that meet over one shingle in one task; beyond it a shingle's sets are dealt into blocks of about as many, and pairs of blocks meet.
BLOCK_SETS = 4096
#: Rows of one shingle that a task of the coarse step holds; of a shingle with more they go through as they come.
HELD_ROWS = 1 << 20
#: Words whose hashes a worker remembers, and their bytes at most.
MEMO_WORDS, MEMO_BYTES = 1 << 20, 48


class WordCodes(dict):
    """XXH64 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        code = xxhash.xxh64_intdigest(word)
        if len(word) <= MEMO_BYTES:
            self[word] = code
        return code


_codes = WordCodes()


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Hashes in order, each once."""
    h = np.sort(hashes)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    h = h * np.uint64(int(_SPREAD) * (2 * seed + 1) & ALL)
    h ^= h >> np.uint64(32)
    h *= _SPREAD
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """64-bit hashes of the text's word shingles, each once, in order. Words and short texts as in ``word_hashes``."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "u8")
    codes, n = np.fromiter(map(_codes.__getitem__, words), "u8", len(words)), min(shingle, len(words))
    h = np.full(len(codes) - n + 1, n, "u8")
    for k in range(n):
        h = mixed(h ^ codes[k : len(codes) - n + 1 + k], k)
    return distinct(h)


def set_name(hashes: np.ndarray) -> int:
    """A signed number that names a set of shingles."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view("i8"))


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """WIDE_WORDS independent SimHash words of each set of shingles, as rows of unsigned numbers."""
    return np.stack([majorities([mixed(h, seed) for h in sets]) for seed in range(1, WIDE_WORDS + 1)], 1)


def runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut anew, so that equal values of a column are never in two of them."""
    held: list[pa.RecordBatch] = []
    for b in nonempty(batches):
        values = b.column(column).to_numpy()
        start = int(np.searchsorted(values, values[-1]))
        if held and (start or held[-1].column(column)[0].as_py() != values[0]):
            same = int(np.searchsorted(values, held[-1].column(column)[0].as_py(), "right"))
            yield pa.concat_batches([*held, b.slice(0, same)])
            held = []
            if same < start:
                yield b.slice(same, start - same)
        elif start:
            yield b.slice(0, start)
        held.append(b.slice(start))
    if held:
        yield pa.concat_batches(held)


def wide_edges(distinct: DataFrame, reach: int = WIDE_REACH, budget: float = WIDE_BUDGET) -> DataFrame:
    """(a, b): candidates among sets, by their names (column fp), whose wide fingerprints (columns w0, w1, ...) share a signature and differ in
    ``reach`` bits at most. Partitions and thresholds are planned for the largest distance that ``budget`` allows."""
    words = tuple(f"w{i}" for i in range(WIDE_WORDS))
    distance, parts = widest_plan(*bit_statistics(distinct, words), budget)
    return link_edges(distinct, parts, distance, max(reach, distance), words)


def needed(n, similar: tuple[int, int] = SIMILAR):
    """The shingles that a set of n shares with any similar set, at least."""
    return -(-similar[0] * n // similar[1])


def rarity(texts: DataFrame, shingle: int) -> np.ndarray:
    """RARITY counts of the shingles of (text), each counted where its hash falls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(RARITY, "i8")
        for b in nonempty(batches):
            hashes = [shingle_set(t, shingle) for t in b.column(0).to_pylist()]
            counts += np.bincount((np.concatenate(hashes) % np.uint64(RARITY)).astype("i8"), minlength=RARITY)
        k = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype("i4")), pa.array(counts[k])], names=["k", "n"])

    out = np.zeros(RARITY, "i8")
    sums = texts.mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out[sums["k"].to_numpy()] = sums["n"].to_numpy()
    return out


def sets_of(texts: DataFrame, shingle: int, chosen=None) -> DataFrame:
    """(fp, size, words) of each set of (text) once: its name, its number of shingles and, of these, what ``chosen(hashes)`` gives, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in nonempty(batches):
            sets = [shingle_set(t, shingle) for t in b.column(0).to_pylist()]
            words = [(chosen(h) if chosen else h).view("i8") for h in sets]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_name, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(words, pa.list_(pa.int64()))], names=["fp", "size", "words"])

    found = texts.select("text").mapInArrow(run, "fp long, size int, words array<long>").where("size > 0")
    return found.groupBy("fp").agg(F.first("size").alias("size"), F.first("words").alias("words"))


def with_roots(sets: DataFrame, roots: DataFrame) -> DataFrame:
    return sets.join(roots, sets["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), *[c for c in sets.columns if c != "fp"])


def _in_blocks(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows with ``key``, what meets in one place, and ``block``: the shingle itself, or a pair of blocks of a shingle that ``counts`` (word, n) has in many sets."""
    hot = counts.where(F.col("n") > BLOCK_SETS).select("word", F.ceil(F.col("n") / BLOCK_SETS).cast("long").alias("blocks_"))
    dealt = rows.join(checked_broadcast(hot), "word", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("blocks_")), F.lit(0).cast("long")).cast("int"))
    others = F.when(F.col("blocks_").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks_") - 1))
    met = dealt.withColumn("other_", F.explode(others))
    return met.withColumn("key", F.when(F.col("blocks_").isNull(), F.col("word")).otherwise(F.xxhash64("word", F.least("block", "other_"), F.greatest("block", "other_"))))


def _cold(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(True, rows) of sorted batches cut anew, so that equal values of a column are never in two of them; but (False, rows), as they come, of a value
    that more than ``HELD_ROWS`` rows have."""
    held: list[pa.RecordBatch] = []
    hot, n = None, 0
    for b in nonempty(batches):
        values = b.column(column).to_numpy()
        at = 0
        if hot is not None:
            at = int(np.searchsorted(values, hot, "right"))
            if at:
                yield False, b.slice(0, at)
            if at == len(values):
                continue
            hot = None
        start = max(at, int(np.searchsorted(values, values[-1])))
        if held and (start > at or held[-1].column(column)[0].as_py() != values[at]):
            same = max(at, int(np.searchsorted(values, held[-1].column(column)[0].as_py(), "right")))
            yield True, pa.concat_batches([*held, b.slice(at, same - at)])
            held, n = [], 0
            if same < start:
                yield True, b.slice(same, start - same)
        elif start > at:
            yield True, b.slice(at, start - at)
        held.append(b.slice(start))
        n += len(values) - start
        if n > HELD_ROWS:
            hot = values[-1]
            for x in held:
                yield False, x
            held, n = [], 0
    if held:
        yield True, pa.concat_batches(held)


def _meetings(rows: DataFrame, schema: str, found, hot=None) -> DataFrame:
    """``found(fp, ok matrix of some rows against all)`` wherever rows (fp, root, size, at, key, block) of one key may be similar: of different roots,
    by the lengths of their sets and by what is left of these behind the word. Of two blocks only rows of different ones meet. With ``hot`` a key of more
    than BLOCK_SETS rows is not compared: all its rows are given as ``hot(fp)``, unless they are held and all of one root."""
    top, of = SIMILAR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, b in _cold(batches, 4) if hot else ((True, b) for b in runs(batches, 4)):
            if not whole:
                yield hot(b.column(0).to_numpy())
                continue
            fp, root, size, at, key, block = (c.to_numpy() for c in b.columns)
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            mixed = np.minimum.reduceat(root, cuts[:-1]) < np.maximum.reduceat(root, cuts[:-1])
            for lo, hi in zip(cuts[:-1][mixed].tolist(), cuts[1:][mixed].tolist(), strict=True):
                f, r, n, k, own = fp[lo:hi], root[lo:hi], size[lo:hi].astype("i8"), at[lo:hi], block[lo:hi]
                if hot and hi - lo > BLOCK_SETS:
                    yield hot(f)
                    continue
                two = own.min() < own.max()
                for i in range(0, hi - lo, 512):
                    j = slice(i, i + 512)
                    both = n[j, None] + n[None]
                    ok = (r[j, None] != r[None]) & (np.minimum(n[j, None] - k[j, None], n - k) * (top + of) >= top * both)
                    ok &= np.minimum(n[j, None], n) * of >= np.maximum(n[j, None], n) * top
                    if two:
                        ok &= own[j, None] != own[None]
                    if ok.any():
                        yield found(f[j], f, ok)

    return rows.select("fp", "root", "size", "at", "key", "block").repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def active_sets(texts: DataFrame, roots: DataFrame, shingle: int) -> DataFrame:
    """(fp): names of all sets of (text) that may be similar to one that ``roots`` (node, root) does not join them to.

    All sets are ordered alike, by their shingles' counters. Similar sets share one of each one's first n - needed(n) + 1. Where very many sets
    share such a shingle they are all taken, without being compared here.
    """
    shared = texts.sparkSession.sparkContext.broadcast(rarity(texts, shingle))

    def first_words(h: np.ndarray) -> np.ndarray:
        order = np.argsort(shared.value[(h % np.uint64(RARITY)).astype("i8")], kind="stable")  # equal counts stay in the order of hashes
        return h[order[: len(h) - needed(len(h)) + 1]]

    rows = with_roots(sets_of(texts, shingle, first_words), roots).select("fp", "root", "size", F.posexplode("words").alias("at", "key")).withColumn("block", F.lit(0))
    return _meetings(rows, "fp long", lambda own, _, ok: pa.RecordBatch.from_arrays([pa.array(own[ok.any(1)])], names=["fp"]), lambda own: pa.RecordBatch.from_arrays([pa.array(own)], names=["fp"])).distinct()


def prefix_pairs(texts: DataFrame, roots: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): names of sets of (text) that may be similar and that ``roots`` (node, root) does not yet join; and (fp, first), the class of each set.

    Shingles of one set alone meet nothing. Sets that are equal but for these, and have as many of them, are a class: each is as similar to any other
    set as the class's first is, so classes meet by their firsts, and within a class all are similar or none. An exact prefix join as in
    ``active_sets``, with shingles ordered by the exact number of these sets that hold them, finds the others: of sets that share a passage, or are
    like each other but not enough, few meet.
    """
    named = with_roots(sets_of(texts, shingle), roots)
    rows = written(named.select("fp", "root", "size", F.explode("words").alias("word")), "shingles")
    counts = written(rows.groupBy("word").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    repeated = rows.join(counts, "word").groupBy("fp", "root", "size").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("repeated"))
    keyed = written(repeated.withColumn("class", F.xxhash64(F.transform("repeated", lambda x: x["word"]))), "repeated")
    remove(rows)
    remove(counts)
    # a class of several roots has one of its own
    mixed = F.xxhash64(F.min("fp"), F.lit("several"))
    heads = keyed.groupBy("class", "size").agg(F.min("fp").alias("first"), F.when(F.min("root") == F.max("root"), F.min("root")).otherwise(mixed).alias("class_root"))
    heads = written(heads, "classes")
    members = written(keyed.select("fp", "class", "size").join(heads, ["class", "size"]).select("fp", "first", "size"), "members")
    classes = keyed.drop("root").join(checked_broadcast(heads.select(F.col("first").alias("fp"), F.col("class_root").alias("root"))), "fp")
    top, of = SIMILAR
    alone = F.col("size") - F.size("repeated")
    left = F.col("size") - F.expr(f"(size * {top} + {of - 1}) div {of}") + 1 - alone  # of the prefix, behind the shingles of this set alone
    firsts = classes.select("fp", "root", "size", alone.alias("alone"), F.size("repeated").alias("shared"), F.slice("repeated", F.lit(1), F.greatest(left, F.lit(0)).cast("int")).alias("firsts"))
    within = members.where("fp <> first").join(firsts.where(F.col("shared") * of >= (F.col("shared") + 2 * F.col("alone")) * top).select(F.col("fp").alias("first")), "first", "left_semi")
    meeting = written(firsts.select("fp", "root", "size", "alone", F.posexplode("firsts").alias("at", "x")).select("fp", "root", "size", (F.col("alone") + F.col("at")).cast("int").alias("at"), "x.word"), "meetings")

    def pairs(own: np.ndarray, every: np.ndarray, ok: np.ndarray) -> pa.RecordBatch:
        x, y = np.nonzero(ok & (own[:, None] < every[None]))
        return pa.RecordBatch.from_arrays([pa.array(own[x]), pa.array(every[y])], names=["a", "b"])

    met = _meetings(_in_blocks(meeting, meeting.groupBy("word").agg(F.count("*").alias("n"))), "a long, b long", pairs)
    out = written(met.distinct().unionByName(within.select(F.col("first").alias("a"), F.col("fp").alias("b"))), "pairs")
    for used in (keyed, heads, meeting):
        remove(used)
    return out, members.select("fp", "first")


def class_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): links of sets to what their class's first is linked to, one for each set: with the links themselves they join what all links of all sets would."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    partner = both.groupBy(F.col("a").alias("first")).agg(F.min("b").alias("b"))
    return members.where("fp <> first").join(partner, "first").where("fp <> b").select(F.col("fp").alias("a"), "b")


def similar_pairs(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Those of the pairs (a, b) of names whose sets are similar, counted exactly. ``texts`` has (fp, text) of every name in them."""
    top, of = SIMILAR
    joined = pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("fp").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in nonempty(batches):
            keep, sets = [], {}
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                for t in (x, y):
                    if t not in sets:
                        sets[t] = shingle_set(t, shingle)
                shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                keep.append(shared * of >= (len(sets[x]) + len(sets[y]) - shared) * top)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])

    out = written(joined.mapInArrow(run, "a long, b long"), "similar")
    remove(pairs)
    remove(texts)
    return out


def first_of_each_group(documents: DataFrame, text: str = "text", shingle: int = 5) -> DataFrame:
    """One row of each group of similar texts, with all its columns: the one with the smallest doc_id.

    Texts link if their sets of shingles are similar (``SIMILAR``), and groups are chains of links. The planned pigeonhole search over wide
    fingerprints finds most links, so that dense groups cost no pairs; an exact prefix join finds all others between what these
    leave apart; every link is counted on the sets themselves.

    Of several such rows (repeated ids) the one with the smallest hash of text stays, and one of equal rows.
    Texts are shuffled by (doc_id, hash of text) to the decisions made on ids and fingerprints, and those of candidate
    pairs to each other.
    """
    prepare(documents.sparkSession)
    words = [f"w{i}" for i in range(WIDE_WORDS)]
    hash_, id_, h_, rows_, at_ = (free_name(documents, n) for n in ("hash_", "id_", "h_", "rows_", "at_"))
    keyed = documents.withColumn(hash_, F.xxhash64(text))
    narrow = keyed.select("doc_id", F.col(hash_).alias("hash_"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in nonempty(batches):
            sets = [shingle_set(t, shingle) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(set_name, sets), pa.int64()), *map(pa.array, wide_fingerprints(sets).T.copy().view("i8"))], names=["doc_id", "hash_", "fp", *words])

    docs = written(narrow.mapInArrow(run, T.StructType([*narrow.schema.fields[:2], *(T.StructField(c, T.LongType()) for c in ("fp", *words))])), "fingerprints")
    # a name stands for one set, so any of its rows has its words
    firsts = docs.groupBy("fp").agg(*(F.first(w).alias(w) for w in words), F.min(F.struct("doc_id", "hash_")).alias("at"))
    nodes = written(firsts.select("fp", *words, F.col("at.doc_id").alias("id_"), F.col("at.hash_").alias("h_")), "nodes")

    def texts_of(names: DataFrame) -> DataFrame:
        """(fp, text) of the sets with these names; twice where rows of one id and text are repeated."""
        wanted = checked_broadcast(nodes.select("fp", "id_", "h_").join(names, "fp", "left_semi"))
        return written(narrow.join(wanted, narrow["doc_id"].eqNullSafe(F.col("id_")) & (narrow["hash_"] == F.col("h_"))).select("fp", "text"), "texts")

    near = written(wide_edges(nodes).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near")
    dense = similar_pairs(near, texts_of(near.select(F.col("a").alias("fp")).union(near.select("b")).distinct()), shingle)
    roots = written(components(dense), "roots")
    active = texts_of(active_sets(narrow.select("text"), roots, shingle))
    candidates, members = prefix_pairs(active, roots, shingle)
    others = similar_pairs(candidates, active, shingle)
    links = dense.unionByName(others).unionByName(class_links(others, members))
    components_ = named_components(docs.select("doc_id", "fp"), lambda _: links)
    named = docs.join(components_, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # one row for a component or, where ids repeat, several: counted down to one
    firsts = named.groupBy("root", "component_id", "fp", "hash_").agg(F.count("*").alias("rows_"))
    best = firsts.withColumn("best_", F.row_number().over(Window.partitionBy("root").orderBy("hash_", "fp"))).where("best_ = 1")
    kept = written(best.select(F.col("component_id").alias(id_), F.col("hash_").alias(h_), F.col("rows_").alias(rows_)), "kept")
    out = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept[id_]) & (keyed[hash_] == kept[h_]), "inner")
    once = out.where(F.col(rows_) == 1)
    # equal rows: rare enough to be sorted with their texts
    several = out.where(F.col(rows_) > 1).withColumn(at_, F.row_number().over(Window.partitionBy(id_, h_).orderBy(text))).where(F.col(at_) == 1)
    return once.select(*documents.columns).unionByName(several.select(*documents.columns))
