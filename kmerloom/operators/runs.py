"""Exact k-mer counts with far fewer bytes in the shuffle: runs of k-mers travel instead of k-mers.

A k-mer's place is the smallest hash of the windows of two fifths of its letters. Neighbouring k-mers mostly have the same one, so each run of them goes to its
place as one text, some 4 letters a k-mer. Equal runs of a chunk go once, with their number. All k-mers of one kind meet in one task, where they are
sorted by hash and compared by their letters, a chunk at a time, so what is held is the distinct k-mers of a place and a chunk. Places follow
the letters, so tasks stay as large as they are when tables grow.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.letters import codes_of, complete, groups, letters_of, mixed, narrow, sliding, window_hashes, windows_at, words
from ..plans.tables import importable, spread

#: Letters for each place; k-mers that are sorted at once; letters of runs that are gathered before they are sent; k-mers of a run at most.
PLACE, CHUNK, HELD, LONGEST = 1 << 22, 1 << 24, 1 << 23, 512
#: Of flanks: k-mers whose hashes are held at once, and whose letters are; letters of runs that are hashed at once; packed bytes of a place that stay in memory.
AT_ONCE, COMPARED, STEP, SPOOLED = 1 << 22, 1 << 20, 1 << 20, 1 << 26
_ODD = 0x110000  # a letter whose upper case is more than one
_CASES: dict[int, tuple[int, int]] = {}
_ZSTD = pa.Codec("zstd", compression_level=3)
_POWERS: list[np.ndarray] = [np.zeros(0, "u8"), np.zeros(0, "u8")]


def _case_tables(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper case and its complement by letter, for those that are there; letters whose upper case has several are _ODD."""
    top = int(codes.max()) + 1 if len(codes) else 1
    upper, other = np.arange(top, dtype="u4"), np.arange(top, dtype="u4")
    for c in np.flatnonzero(np.bincount(codes, minlength=top)).tolist():
        if c not in _CASES:
            u = chr(c).upper()
            _CASES[c] = (ord(u), ord(u.translate(str.maketrans("ACGTU", "TGCAA")))) if len(u) == 1 else (_ODD, _ODD)
        upper[c], other[c] = _CASES[c]
    return upper, other


def _cased(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper case and its complement of each letter; letters whose upper case has several are _ODD."""
    upper, other = _case_tables(codes)
    return upper[codes], other[codes]


def _hashes(codes: np.ndarray, m: int, both_strands: bool) -> np.ndarray:
    if not both_strands:
        return window_hashes(codes, m)
    upper, other = _cased(codes)
    upper = np.where(upper == ord("U"), np.uint32(ord("T")), upper)
    return np.minimum(window_hashes(upper, m), window_hashes(other[::-1], m)[::-1])


def _runs(codes: np.ndarray, lengths: np.ndarray, k: int, both_strands: bool, flank: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, length) of the runs of pieces of some lengths, joined; a place is a number of 64 bits. With ``flank`` the letter between both flanks has no part in it."""
    m = (2 * (flank or k) + 4) // 5
    if len(codes) < k:
        return np.zeros(0, "u8"), np.zeros(0, "i8"), np.zeros(0, "i8")
    least = sliding(np.minimum, _hashes(codes, m, both_strands), (flank or k) - m + 1)
    if flank:
        least = np.minimum(least[: len(codes) - k + 1], least[flank + 1 :])
    ok = complete(lengths, k)[: len(least)]
    fresh = ok.copy()
    fresh[1:] &= (least[1:] != least[:-1]) | ~ok[:-1]
    begins = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    begins = begins[begins < len(ok)]
    fresh[begins] = ok[begins]
    first = np.flatnonzero(fresh)
    stops = np.flatnonzero(ok & ~np.append(ok[1:], False)) + 1
    kmers = np.minimum(np.append(first[1:], len(ok)), stops[np.searchsorted(stops, first, "right")] if len(first) else 0) - first
    place = mixed(least[first] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    if len(kmers) and kmers.max() > LONGEST:
        each = -(-kmers // LONGEST)
        behind = np.repeat(first + kmers, each)
        place, first = np.repeat(place, each), np.repeat(first, each) + LONGEST * (np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each))
        kmers = np.minimum(behind - first, LONGEST)
    return place, first, kmers + k - 1


def _cut(pieces: list[str], k: int, n: int, both_strands: bool, flank: int | None = None) -> Iterator[tuple[int, str]]:
    """(place, run) of the k-mers of all pieces, for ``n`` places."""
    text = "".join(pieces)
    place, first, length = _runs(codes_of(text), np.array([len(p) for p in pieces]), k, both_strands, flank)
    for p, at, size in zip((place % np.uint64(n)).tolist(), first.tolist(), length.tolist(), strict=True):
        yield p, text[at : at + size]


def _row(place: int, by: object, numbers: np.ndarray, text: bytes) -> dict:
    """Of numbers all first bytes go first, then all second ones, as they hardly take any room then."""
    runs = numbers.shape[1]
    data = numbers.view("u1").reshape(2, runs, 4).transpose(0, 2, 1).tobytes() + text
    return {"place": place, "by": by, "runs": runs, "size": len(data), "data": _ZSTD.compress(data, asbytes=True)}


def _packed(runs: Counter, by: object) -> Iterator[dict]:
    """A row for each place: lengths, numbers and letters of its runs, compressed."""
    of: dict[int, list[tuple[str, int]]] = {}
    for (p, run), n in runs.items():
        of.setdefault(p, []).append((run, n))
    for p, own in of.items():
        yield _row(p, by, np.array([[len(r) for r, _ in own], [n for _, n in own]], "<u4"), "".join(r for r, _ in own).encode("utf-8", "surrogatepass"))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number, and of the one that it takes to 1, modulo 2^64."""
    if n > len(_POWERS[0]):
        of = 0xD6E8FEB86659FD93
        _POWERS[:] = [np.concatenate((np.ones(1, "u8"), np.cumprod(np.full(2 * n, x, "u8")))) for x in (of, pow(of, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def _summed(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by which letters from a to b have the hash (sums[b] - sums[a]) * back[a], wherever they stand."""
    power, back = _powers(len(codes) + 1)
    table = mixed(np.arange(int(codes.max()) + 1 if len(codes) else 1, dtype="u8") + np.uint64(1))
    return np.concatenate((np.zeros(1, "u8"), np.cumsum(table[codes] * power[:-1]))), back


def _spans(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of all letters of runs, one run behind the other."""
    return np.repeat(first - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


class _Held:
    """Runs of many texts in arrays, until they are packed."""

    def __init__(self, k: int, n: int, both_strands: bool, flank: int | None):
        self.k, self.n, self.both, self.flank = k, n, both_strands, flank
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, pieces: list[str]) -> None:
        codes = codes_of("".join(pieces))
        place, first, length = _runs(codes, np.array([len(p) for p in pieces]), self.k, self.both, self.flank)
        sums, back = _summed(codes)
        same = mixed((sums[first + length] - sums[first]) * back[first])
        self.parts.append((narrow(codes), place, first + self.size, length, same))
        self.size += len(codes)

    def packed(self) -> Iterator[dict]:
        """Rows as ``_packed`` has them; runs of one place with the same smallest hash stand together."""
        if not self.parts:
            return
        letters = _joined([(p[0], p[3], p[2]) for p in self.parts])[0]
        place, first, length, same = (np.concatenate([p[i] for p in self.parts]) for i in range(1, 5))
        self.parts, self.size = [], 0
        if not len(place):
            return
        of = place % np.uint64(self.n)
        order = np.argsort(of << np.uint64(40) | (place & np.uint64(0xFFFFF)) << np.uint64(20) | same >> np.uint64(44))
        of, first, length, same = of[order], first[order], length[order], same[order]
        again = np.flatnonzero((of[1:] == of[:-1]) & (same[1:] == same[:-1]) & (length[1:] == length[:-1])) + 1
        fresh = np.ones(len(of), bool)
        for own in np.split(again, np.searchsorted(np.cumsum(length[again]), np.arange(STEP, int(length[again].sum()), STEP))) if len(again) else ():
            if len(own):  # equal hashes, and equal letters
                other = letters[_spans(first[own], length[own])] != letters[_spans(first[own - 1], length[own])]
                fresh[own] = np.logical_or.reduceat(other, np.cumsum(length[own]) - length[own])
        heads = np.flatnonzero(fresh)
        numbers = np.diff(np.append(heads, len(of)))
        of, first, length = of[heads], first[heads], length[heads]
        begins = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        for a, b in zip(begins.tolist(), np.append(begins[1:], len(of)).tolist(), strict=True):
            own = letters[_spans(first[a:b], length[a:b])]
            text = own.tobytes() if own.itemsize == 1 and own.max() < 128 else own.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            yield _row(int(of[a]), None, np.array([length[a:b], numbers[a:b]], "<u4"), text)


def _letters(seqs: DataFrame, seq: str) -> int:
    return int(seqs.agg(F.coalesce(F.sum(F.length(seq)), F.lit(0))).first()[0])


def tasks_for(seqs: DataFrame, letters: int) -> int:
    """Places for so many letters."""
    return max(1, -(-letters // PLACE), seqs.sparkSession.sparkContext.defaultParallelism if letters > PLACE else 1)


def _sent(seqs: DataFrame, seq: str, k: int, both_strands: bool, by: str | None, letters: int | None = None, flank: int | None = None) -> DataFrame:
    """Rows of ``packed_runs``, each in the partition of its place. ``letters`` is given for rows that are dealt out already."""
    own = seqs.select(seq, *([by] if by and by != seq else []))
    own, letters = (spread(own), _letters(own, seq)) if letters is None else (own, letters)
    # a place of flanks is mostly taken at once; k-mers of both strands take twice the memory
    n = tasks_for(seqs, letters * 4 // 3 if flank else 2 * letters if both_strands else letters)
    return packed_runs(own, seq, k, n, both_strands, by, flank).repartitionById(n, "place")


def packed_runs(seqs: DataFrame, seq: str, k: int, n: int, both_strands: bool = False, by: str | None = None, flank: int | None = None) -> DataFrame:
    """(place, by, runs, size, data): the runs of all sequences for ``n`` places, not shuffled."""
    importable(seqs.sparkSession)
    if k < 1:
        raise ValueError("k-mers have a letter at least")
    rows = seqs.select(F.col(seq).alias("seq"), (F.col(by) if by else F.lit(None).cast("int")).alias("by"))
    schema = f"place int, by {rows.schema['by'].dataType.simpleString()}, runs int, size long, data binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, Counter] = {}
        whole = _Held(k, n, both_strands, flank)
        size, types = 0, None

        def full() -> Iterator[pa.RecordBatch]:
            out, of = [], 0
            for rows in (whole.packed(), *(_packed(runs, key) for key, runs in held.items())):
                for row in rows:
                    out.append(row)
                    of += len(row["data"])
                    if of > 1 << 22:
                        yield pa.RecordBatch.from_pylist(out, schema=types)
                        out, of = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=types)

        for b in batches:
            types = pa.schema([("place", pa.int32()), ("by", b.schema.field("by").type), ("runs", pa.int32()), ("size", pa.int64()), ("data", pa.binary())])
            keys = b.column("by").to_pylist() if by else None
            for at, _, pieces in groups(b.column("seq").to_pylist(), k - 1):
                whose: dict[object, list[str]] = {}
                for row, piece in zip(at, pieces, strict=True) if keys else ():
                    whose.setdefault(keys[row], []).append(piece)
                for key, own in whose.items():
                    held.setdefault(key, Counter()).update(_cut(own, k, n, both_strands, flank))
                    size += sum(map(len, own))
                if not keys:
                    whole.add(pieces)
                if max(size, whole.size) >= HELD:
                    yield from full()
                    held, size = {}, 0
        yield from full()

    return rows.mapInArrow(cut, schema)


def _unpacked(runs: int, size: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of a row's runs, their lengths and numbers."""
    raw = _ZSTD.decompress(data, decompressed_size=size, asbytes=True)
    lengths, numbers = np.ascontiguousarray(np.frombuffer(raw, "u1", 8 * runs).reshape(2, 4, runs).transpose(0, 2, 1)).view("<u4")[..., 0]
    return letters_of(raw[8 * runs :]), lengths.astype("i8"), numbers.astype("i8")


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Letters, lengths and numbers of several as one, the letters as ``narrow`` has them."""
    if not parts:
        return np.zeros(0, "u1"), np.zeros(0, "i8"), np.zeros(0, "i8")
    letters = np.concatenate([p[0].astype("u4") if len({q[0].dtype for q in parts}) > 1 else p[0] for p in parts])
    return narrow(letters), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])


def _starts(lengths: np.ndarray, numbers: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the k-mers of runs begin in their joined letters, and their numbers."""
    n_each = lengths - k + 1
    firsts = np.cumsum(lengths) - lengths
    return np.repeat(firsts - (np.cumsum(n_each) - n_each), n_each) + np.arange(int(n_each.sum())), np.repeat(numbers, n_each)


class Counted:
    """Distinct k-mers and their numbers, taken in run by run; what is held is a chunk of runs and the distinct k-mers so far."""

    def __init__(self, k: int, both_strands: bool):
        self.k, self.both = k, both_strands
        self.odd: Counter = Counter()
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # codes, lengths, numbers
        self.size, self.done = 0, None

    def add(self, runs: int, size: int, data: bytes) -> None:
        self.hold(*_unpacked(runs, size, data))

    def hold(self, letters: np.ndarray, lengths: np.ndarray, numbers: np.ndarray) -> None:
        self.parts.append((letters, lengths, numbers))
        self.size += len(letters)
        if self.size >= max(CHUNK, 0 if self.done is None else 2 * self.k * len(self.done[1])):
            letters, starts, n = self.settle()
            own = np.lib.stride_tricks.sliding_window_view(letters, self.k)[starts].ravel() if len(starts) else letters[:0]
            self.parts, self.size = [(own, np.full(len(starts), self.k), n)], 0

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(letters, starts, numbers) of the distinct k-mers so far."""
        k = self.k
        letters, lengths, numbers = _joined(self.parts)
        starts, weight = _starts(lengths, numbers, k)
        keys = None
        if self.both and len(starts):
            letters, starts, weight, keys = self._canonical(letters, starts, weight)
        if not len(starts):
            self.done = (letters, starts, weight)
            return self.done
        order, same = self._sorted(words(letters, starts, k) if keys is None else keys)
        heads = np.flatnonzero(np.concatenate(([True], ~same)))
        self.done = (letters, starts[order[heads]], np.add.reduceat(weight[order], heads))
        return self.done

    def varied(self, flank: int, least: int) -> list[str]:
        """Both flanks, as one text, that stand ``least`` times or more around different letters."""
        letters, starts, n = self.settle()
        if not len(starts):
            return []
        order, same = self._sorted(words(letters, starts, flank) + words(letters, starts + flank + 1, flank))
        heads = np.flatnonzero(np.concatenate(([True], ~same)))
        several = (np.diff(np.append(heads, len(order))) > 1) & (np.add.reduceat(n[order], heads) >= least)
        return [x[:flank] + x[flank + 1 :] for x in windows_at(letters, starts[order[heads[several]]], self.k).to_pylist()]

    def _sorted(self, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """An order in which equal keys stand together, and whether each but the first is equal to the one before."""
        h = np.zeros(len(keys[0]), "u8")
        for w in keys:
            h += w
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        order = np.argsort(h)
        same = self._same(keys, order)
        if (h[order[1:]] == h[order[:-1]])[~same].any():  # different keys of one hash
            order = np.lexsort(keys[::-1])
            same = self._same(keys, order)
        return order, same

    @staticmethod
    def _same(keys: list[np.ndarray], order: np.ndarray) -> np.ndarray:
        same = np.ones(len(order) - 1, bool)
        for w in keys:
            sorted_ = w[order]
            same &= sorted_[1:] == sorted_[:-1]
        return same

    def _canonical(self, letters: np.ndarray, starts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Both strands behind each other, of which each k-mer begins in the one that is smaller, and the words of the k-mers. Those with letters that grow in upper case are counted as text."""
        k, n = self.k, len(letters)
        _, other = _case_tables(letters)
        if (other == _ODD).any():
            grows = np.concatenate(([0], np.cumsum((other == _ODD)[letters])))
            odd = grows[starts + k] > grows[starts]
            for s, w in zip(windows_at(letters, starts[odd], k).to_pylist(), weight[odd].tolist(), strict=True):
                self.odd[min(s, s.upper().translate(str.maketrans("ACGTU", "TGCAA"))[::-1])] += w
            starts, weight = starts[~odd], weight[~odd]
            other = np.where(other == _ODD, np.uint32(0), other)
        if len(other) and int(other.max()) < 1 << 8 * letters.itemsize:
            both = np.concatenate((letters, other.astype(letters.dtype)[letters][::-1]), dtype=letters.dtype)
        else:
            both = narrow(np.concatenate((letters.astype("u4"), other[letters][::-1])))
        mirrored = 2 * n - k - starts
        one, two = words(both, starts, k), words(both, mirrored, k)
        less, equal = np.zeros(len(starts), bool), np.ones(len(starts), bool)
        for x, y in zip(one, two, strict=True):
            less |= equal & (y < x)
            equal &= x == y
        for x, y in zip(one, two, strict=True):
            np.copyto(x, y, where=less)
        return both, np.where(less, mirrored, starts), weight, one


def _counted(batches: Iterator[pa.RecordBatch], k: int, both_strands: bool) -> Iterator[tuple[object, Counted]]:
    """Each group's k-mers; groups stand together."""
    now, counted = None, Counted(k, both_strands)
    for b in batches:
        for by, runs, size, data in zip(b.column("by").to_pylist(), b.column("runs").to_pylist(), b.column("size").to_pylist(), b.column("data"), strict=True):
            if by != now:
                yield now, counted
                now, counted = by, Counted(k, both_strands)
            counted.add(runs, size, data.as_buffer())
    yield now, counted


def counts(seqs: DataFrame, seq: str, k: int = 31, both_strands: bool = False, least: int = 1, by: str | None = None, letters: int | None = None) -> DataFrame:
    """(kmer, n), with ``by`` (by, kmer, n): how often each k-mer stands in all sequences, or in those of a group; only those of ``least`` or more.

    ``letters`` bounds the letters of rows that are dealt out already; without it they are counted, and rows dealt out.
    """
    rows = _sent(seqs, seq, k, both_strands, by, letters)
    out = gathered(rows.sortWithinPartitions("by") if by else rows, k, both_strands, least)
    return out.select(F.col("by").alias(by), "kmer", "n") if by else out.select("kmer", "n")


def gathered(rows: DataFrame, k: int, both_strands: bool = False, least: int = 1) -> DataFrame:
    """(by, kmer, n) of packed runs; all runs of a place are in one partition, and those of a group stand together."""
    schema = f"by {rows.schema['by'].dataType.simpleString()}, kmer string, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def typed() -> Iterator[pa.RecordBatch]:
            for b in batches:
                types.append(b.schema.field("by").type)
                yield b

        types: list[pa.DataType] = []
        for key, own in _counted(typed(), k, both_strands):
            letters, starts, n = own.settle()
            starts, n = starts[n >= least], n[n >= least]
            for i in range(0, len(starts), 1 << 16):
                part = starts[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(part), types[-1]), windows_at(letters, part, k), pa.array(n[i : i + (1 << 16)], pa.int64())], names=["by", "kmer", "n"])
            odd = [(s, n) for s, n in own.odd.items() if n >= least]
            if odd:
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(odd), types[-1]), pa.array([s for s, _ in odd], pa.string()), pa.array([n for _, n in odd], pa.int64())], names=["by", "kmer", "n"])

    return rows.mapInArrow(count, schema)


def multiplicities(seqs: DataFrame, seq: str, k: int = 31, both_strands: bool = False) -> DataFrame:
    """(n, n_kmers): how many distinct k-mers stand ``n`` times. No k-mer leaves its task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _counted(batches, k, both_strands):
            n, n_kmers = np.unique(np.concatenate((own.settle()[2], np.array(list(own.odd.values()), "i8"))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(n_kmers, pa.int64())], names=["n", "n_kmers"])

    return _sent(seqs, seq, k, both_strands, None).mapInArrow(count, "n long, n_kmers long").groupBy("n").agg(F.sum("n_kmers").alias("n_kmers"))


def likely_counts(seqs: DataFrame, seq: str, k: int = 31, both_strands: bool = False, bins: int = 500) -> DataFrame:
    """(kmer, n, n_kmers, bound): how many distinct k-mers stand ``n`` times, without ``kmer``; and, without ``n_kmers``, each k-mer of a task that stands ``bound`` times or more there.

    ``bound`` is half the first valley of the task's own spectrum, 2 at least. All of a k-mer stand in one task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kmer: pa.Array, n: np.ndarray, n_kmers: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([kmer, pa.array(n, pa.int64()), n_kmers, pa.array(np.full(len(n), bound), pa.int64())], names=["kmer", "n", "n_kmers", "bound"])

        for _, own in _counted(batches, k, both_strands):
            letters, starts, n = own.settle()
            odd = np.array(list(own.odd.values()), "i8")
            times, n_kmers = np.unique(np.concatenate((n, odd)), return_counts=True)
            s = np.bincount(np.minimum(times, bins), n_kmers, bins + 1)
            low = np.flatnonzero((s[2:-1] <= s[1:-2]) & (s[2:-1] <= s[3:]))
            bound = max(2, (int(low[0]) + 2) // 2 if len(low) else 2)
            yield rows(pa.nulls(len(times), pa.string()), times, pa.array(n_kmers, pa.int64()))
            starts, n = starts[n >= bound], n[n >= bound]
            for i in range(0, len(starts), 1 << 16):
                part = starts[i : i + (1 << 16)]
                yield rows(windows_at(letters, part, k), n[i : i + (1 << 16)], pa.nulls(len(part), pa.int64()))
            yield rows(pa.array([s for s, x in own.odd.items() if x >= bound], pa.string()), odd[odd >= bound], pa.nulls(int((odd >= bound).sum()), pa.int64()))

    return _sent(seqs, seq, k, both_strands, None).mapInArrow(count, "kmer string, n long, n_kmers long, bound long")


class _Spooled:
    """Rows of a place, kept packed, in a file if they are many, so that they can be gone through again."""

    def __init__(self, k: int, flank: int):
        self.k, self.flank, self.rows, self.kmers = k, flank, [], 0
        self.file = tempfile.SpooledTemporaryFile(SPOOLED)

    def add(self, runs: int, size: int, data: pa.Buffer) -> None:
        self.file.write(memoryview(data))
        self.rows.append((runs, size, len(data)))
        self.kmers += size - 8 * runs - (self.k - 1) * runs  # of bytes, so no fewer than there are

    def through(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(hashes of both flanks, letters, starts, numbers) of k-mers, some STEP letters of runs at once."""
        self.file.seek(0)
        held, size = [], 0
        for i, (runs, full, packed) in enumerate(self.rows):
            letters, lengths, numbers = _unpacked(runs, full, self.file.read(packed))
            ends = np.cumsum(lengths)
            cuts = [0, *np.unique(np.searchsorted(ends, np.arange(STEP, len(letters), STEP))).tolist(), runs]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    held.append((letters[ends[a] - lengths[a] : ends[b - 1]], lengths[a:b], numbers[a:b]))
                    size += len(held[-1][0])
                if size >= STEP or held and b == runs and i + 1 == len(self.rows):
                    yield self._hashed(*_joined(held))
                    held, size = [], 0

    def _hashed(self, letters: np.ndarray, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts, n = _starts(lengths, numbers, self.k)
        sums, back = _summed(letters)
        left, right = (mixed((sums[at + self.flank] - sums[at]) * back[at]) for at in (starts, starts + self.flank + 1))
        return mixed(left * np.uint64(0x9E3779B97F4A7C15) + right), letters, starts, n


def _likely_varied(h: np.ndarray, middle: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, sorted, of flanks that stand ``least`` times or more around different letters, how many k-mers have each, and which ones. A hash may stand for several flanks. ``h`` is sorted in place."""
    order = np.argsort(h)
    h.sort()
    heads = np.flatnonzero(np.concatenate((np.ones(min(len(h), 1), bool), h[1:] != h[:-1])))
    # most flanks stand once: only the others are looked at
    many = np.diff(np.append(heads, len(h)))
    heads, many = heads[many > 1], many[many > 1]
    order = order[_spans(heads, many)]
    if not len(heads):
        return h[:0], many, order
    at, middle = np.cumsum(many) - many, middle[order]
    varied = (np.minimum.reduceat(middle, at) != np.maximum.reduceat(middle, at)) & (np.add.reduceat(n[order].astype("i8"), at) >= least)
    return h[heads[varied]], many[varied], order[np.repeat(varied, many)]


def varied_in(rows: _Spooled, least: int) -> Iterator[list[str]]:
    """Both flanks, as one text, that stand ``least`` times or more around different letters in a place. Flanks are held as hashes, some AT_ONCE at a time, however large a place is; only k-mers of likely ones are compared by their letters."""
    parts = max(1, -(-rows.kmers // AT_ONCE))
    for part in range(parts if rows.rows else 0):
        size, kept = 0, []
        hashes, middle, n = (np.zeros(rows.kmers // parts + 1, kind) for kind in ("u8", "u4", "u4"))
        for h, letters, starts, numbers in rows.through():
            if parts > 1:
                own = (h >> np.uint64(8)) % np.uint64(parts) == part
                h, starts, numbers = h[own], starts[own], numbers[own]
            else:
                kept.append((letters, starts.astype("u4")))
            end = size + len(h)
            if end > len(hashes):
                for a in (hashes, middle, n):
                    a.resize(end + end // 8, refcheck=False)
            hashes[size:end], middle[size:end], n[size:end], size = h, letters[starts + rows.flank], numbers, end
        hashes, many, which = _likely_varied(hashes[:size], middle[:size], n[:size], least)
        turn = (np.cumsum(many) - many) // COMPARED
        for t in np.unique(turn).tolist():
            own = Counted(rows.k, False)
            if kept:
                mine, begin = np.sort(which[np.repeat(turn == t, many)]), 0
                for letters, starts in kept:
                    at = mine[slice(*np.searchsorted(mine, (begin, begin + len(starts))))]
                    _hold_kmers(own, letters, starts[at - begin], n[at])
                    begin += len(starts)
            else:
                some = hashes[turn == t]
                for h, letters, starts, numbers in rows.through():
                    at = np.flatnonzero(some[np.minimum(np.searchsorted(some, h), len(some) - 1)] == h)
                    _hold_kmers(own, letters, starts[at], numbers[at])
            yield own.varied(rows.flank, least)


def _hold_kmers(own: Counted, letters: np.ndarray, starts: np.ndarray, n: np.ndarray) -> None:
    if len(starts):
        own.hold(np.lib.stride_tricks.sliding_window_view(letters, own.k)[starts].ravel(), np.full(len(starts), own.k), n.astype("i8"))


def varied_flanks(seqs: DataFrame, seq: str, flank: int, least: int) -> DataFrame:
    """(flanks): both flanks, as one text, of split k-mers that stand ``least`` times or more, around different letters."""
    k = 2 * flank + 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Spooled(k, flank)
        with rows.file:
            for b in batches:
                for runs, size, data in zip(b.column("runs").to_pylist(), b.column("size").to_pylist(), b.column("data"), strict=True):
                    rows.add(runs, size, data.as_buffer())
            for found in varied_in(rows, least):
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["flanks"])

    return _sent(seqs, seq, k, False, None, flank=flank).mapInArrow(find, "flanks string")
