"""Assembly with a corrected graph: k-mers of enough quality and count, a bidirected de Bruijn graph, tips and bubbles removed, contigs.

The bidirected graph is held as both strands of every canonical k-mer, so its edges are plain ones, and what is true of a
strand is true of its mirror. A segment is a path without branches: (first, last, seq, n, depth), its first and last k-mer, its text, its
k-mers and the sum of their counts. Letters are taken in upper case, U as T; letters other than A, C, G, T are their own complement,
so a segment can be its own mirror.

k-mers are joined up to stretches in the places of what they begin and end with; only stretches travel from then on. Up to a fixed number of links one task
follows in arrays; beyond, joins double how far a stretch sees back in each step, so the steps grow with the logarithm of the longest path.

Correction works on segments, not on k-mers, and in rounds: tips go first, then bubbles, and what they leave is joined up again. Each step is a written table;
no task holds more than a place or a stretch of a path, until the text of a contig is put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.letters import codes_of, mixed, window_hashes
from ..functions.sequence import canonical, reverse_complement
from ..plans.tables import importable, remove, written
from .kmers import counts, fitted_min_count, min_count, quality_kmers, spectrum, valley_counts

#: Rounds of correction before giving up, and segments of a path whose texts are put together in one row at first.
MAX_ROUNDS, STRETCH = 200, 4096
#: Links that one task follows in arrays (515 MB, measured); k-mers for each place.
FEW_LINKS, SHARE = 1_500_000, 1 << 18
_PAIRS = str.maketrans("ACGTU", "TGCAA")


def counted_kmers(reads: DataFrame, seq: str, k: int = 21, qual: str | None = None, least_quality: int = 20, mode: int = 2) -> DataFrame:
    """(kmer, n): canonical k-mers of all reads in upper case, U as T; with ``qual`` only those of enough quality (see ``quality_kmers``)."""
    plain = F.translate(F.upper(seq), "U", "T")
    if qual is None:
        return counts(reads.select(plain.alias("seq")), "seq", k, both_strands=True)
    found = quality_kmers(reads.select(plain.alias("seq"), F.col(qual).alias("qual")), "seq", "qual", k, least_quality, mode)
    return found.select(canonical(F.col("kmer")).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def solid_kmers(counted: DataFrame, least: int | None = None) -> DataFrame:
    """The k-mers seen ``least`` times or more; None takes the first valley of the spectrum."""
    return min_count(counted, fitted_min_count(spectrum(counted)).first()[0] if least is None else least)


def segments_of(counted: DataFrame) -> DataFrame:
    """A segment for each strand of each canonical k-mer (kmer, n); its own mirror is one."""
    strands = F.explode(F.array_distinct(F.array("kmer", reverse_complement(F.col("kmer")))))
    both = counted.select(strands.alias("first"), F.col("n").alias("depth"))
    return both.select("first", F.col("first").alias("last"), F.col("first").alias("seq"), F.lit(1).cast("long").alias("n"), F.col("depth").cast("long").alias("depth"))


def segment_links(segments: DataFrame) -> DataFrame:
    """(source, target): segments, by their first k-mers, of which one's last and the other's first k-mer overlap by all letters but one."""
    sources = segments.select(F.col("first").alias("source"), F.expr("substring(last, 2)").alias("overlap"))
    targets = segments.select(F.col("first").alias("target"), F.expr("substring(first, 1, length(first) - 1)").alias("overlap"))
    return sources.join(targets, "overlap").select("source", "target")


def _key():
    """What a segment and its mirror have in common."""
    return F.least(F.col("first"), reverse_complement(F.col("last")))


def _only_links(segments: DataFrame) -> DataFrame:
    """(source, target, key) of links without a branch, and the target's key: overlaps that one segment ends with and one begins with. A written table."""
    none = F.lit(None).cast("string")
    ends = segments.select(F.expr("substring(last, 2)").alias("overlap"), F.col("first").alias("source"), none.alias("target"), none.alias("key"))
    begins = segments.select(F.expr("substring(first, 1, length(first) - 1)").alias("overlap"), none.alias("source"), F.col("first").alias("target"), _key().alias("key"))
    met = ends.unionByName(begins).groupBy("overlap").agg(F.count("source").alias("n_source"), F.count("target").alias("n_target"), *(F.min(c).alias(c) for c in ("source", "target", "key")))
    return written(met.where("n_source = 1 and n_target = 1 and source <> target").select("source", "target", "key"), "only-links")


def _seen_back(nodes: DataFrame, back: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first, head, steps) of the nodes (first, key) that are in paths along ``back`` (first, at), and (first, key, least, least_key) of those in cycles, with the smallest names of each.

    A node that sees its path's head is left alone from then on.
    """
    state = nodes.join(back, "first", "left").select("first", "key", F.coalesce("at", "first").alias("at"), F.when(F.col("at").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("first").alias("least"), F.col("key").alias("least_key"), F.col("at").isNull().alias("known"))
    state = written(state, "paths")
    known, open_ = state.where("known"), state.where("not known")
    n, reach = open_.count(), 1
    while n:
        far = known.unionByName(open_).select(F.col("first").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("steps2"), F.col("least").alias("least2"), F.col("least_key").alias("key2"), F.col("known").alias("known2"))
        then = open_.drop("known").join(far, "at").select("first", "key", F.col("at2").alias("at"), (F.col("steps") + F.col("steps2")).alias("steps"), F.least("least", "least2").alias("least"), F.least("least_key", "key2").alias("least_key"), F.col("known2").alias("known"))
        then = written(then, "paths")
        known, open_ = known.unionByName(then.where("known")), then.where("not known")
        before, n, reach = n, open_.count(), reach * 2
        # a path that is not seen to its end gets shorter in each round, so the rest are cycles; each has been gone round when as many steps are seen
        if n == before and reach >= n:
            break
    return known.select("first", F.col("at").alias("head"), "steps"), open_.select("first", "key", "least", "least_key")


def _placed_far(only: DataFrame) -> DataFrame:
    """``_placed`` by joins, however many links there are."""
    back = only.select(F.col("target").alias("first"), F.col("source").alias("at"))
    heads = only.select(F.col("source").alias("first")).join(back, "first", "left_anti").select("first", F.lit(None).cast("string").alias("key"))
    paths, rings = _seen_back(only.select(F.col("target").alias("first"), "key").unionByName(heads), back)
    paths = paths.withColumn("ring", F.lit(False))
    if not rings.isEmpty():
        # a ring is cut before its smallest k-mer; its mirror, which has that k-mer's mirror, behind it
        smallest = rings.where("key = least_key")
        before = smallest.where("first = key").select(F.col("first").alias("at_"), "least")
        behind = smallest.where("first <> key").join(before.select("least"), "least", "left_anti").select(F.col("first").alias("from_"))
        cut = back.join(before.select(F.col("at_").alias("first")), "first", "left_anti").join(behind.select(F.col("from_").alias("at")), "at", "left_anti")
        open_, _ = _seen_back(rings.select("first", "key"), cut.join(rings.select("first"), "first", "left_semi"))
        paths = paths.unionByName(open_.withColumn("ring", F.lit(True)))
    return paths.select("first", "head", F.col("steps").alias("place"), "ring")


def _followed(back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(head, place, ring): of each node its path's first one, its place there, and whether it has none as it is in a cycle. ``back`` is the node before, or itself."""
    at, steps = back, (back != np.arange(len(back))).astype("i8")
    for _ in range(len(back).bit_length()):
        if (back[at] == at).all():
            break
        at, steps = at[at], steps + steps[at]
    return at, steps, back[at] != at


def _cut_rings(back: np.ndarray, ring: np.ndarray, rank: np.ndarray, own: np.ndarray) -> np.ndarray:
    """``back`` with each ring cut before its node of the smallest ``rank``; behind it, where no node of that rank is its ``own`` key."""
    at, least, name = back, np.where(ring, rank, 0), np.arange(len(back))
    for _ in range(int(ring.sum()).bit_length()):
        least, name, at = np.minimum(least, least[at]), np.minimum(name, name[at]), at[at]
    smallest = ring & (rank == least)
    before = np.flatnonzero(smallest & own)
    behind = np.flatnonzero(smallest & ~own)
    behind = behind[~np.isin(name[behind], name[before])]
    cut = np.concatenate((before, np.flatnonzero(ring & np.isin(back, behind))))
    out = back.copy()
    out[cut] = cut
    return out


def _placed_near(only: DataFrame) -> DataFrame:
    """``_placed`` of at most ``FEW_LINKS`` links, in arrays of one task."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = pa.Table.from_batches(list(batches), schema=pa.schema([(c, pa.string()) for c in ("source", "target", "key")]))
        n = len(links)
        if not n:
            return
        names = pa.concat_arrays([c.combine_chunks() for c in (links.column("source"), links.column("target"))]).dictionary_encode()
        ids, names = names.indices.to_numpy(), names.dictionary
        back = np.arange(len(names))
        back[ids[n:]] = ids[:n]
        head, at, ring = _followed(back)
        if ring.any():
            key = links.column("key").combine_chunks()
            rank, own = np.zeros(len(names), "i8"), np.zeros(len(names), bool)
            rank[ids[n:]] = pc.rank(key, tiebreaker="dense").to_numpy()
            own[ids[n:]] = pc.equal(key, links.column("target").combine_chunks()).to_numpy(zero_copy_only=False)
            head, at, _ = _followed(_cut_rings(back, ring, rank, own))
        for i in range(0, len(names), 1 << 16):
            j = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([names[j], names.take(pa.array(head[j])), pa.array(at[j], pa.int64()), pa.array(ring[j])], names=["first", "head", "place", "ring"])

    return only.coalesce(1).mapInArrow(place, "first string, head string, place long, ring boolean")


def _placed(only: DataFrame) -> DataFrame:
    """(first, head, place, ring): each linked segment's path, named by its first segment, its place there, and whether it was a ring, along ``only`` (source, target, key of the target; written)."""
    importable(only.sparkSession)
    return _placed_near(only) if only.count() <= FEW_LINKS else _placed_far(only)


def _joined(segments: DataFrame, only: DataFrame) -> DataFrame:
    """Segments joined up along ``only``, with ``ring``: whether they were a cycle."""
    own = segments.join(_placed(only), "first", "left").withColumns({"head": F.coalesce("head", "first"), "place": F.coalesce("place", F.lit(0).cast("long")), "ring": F.coalesce("ring", F.lit(False))})
    piece = F.when(F.col("place") == 0, F.col("seq")).otherwise(F.expr("substring(seq, length(first))"))
    joined = lambda at, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, text))), lambda x: x[text]), "")
    sums = [F.sum("n").alias("n"), F.sum("depth").alias("depth"), F.max("ring").alias("ring")]
    stretch = own.select("head", "place", piece.alias("piece"), "last", "n", "depth", "ring", F.floor(F.col("place") / STRETCH).alias("stretch"))
    stretch = stretch.groupBy("head", "stretch").agg(joined("place", "piece").alias("text"), F.max_by("last", "place").alias("last"), *sums)
    whole = stretch.groupBy("head").agg(F.max_by("last", "stretch").alias("last"), joined("stretch", "text").alias("seq"), *sums)
    return whole.select(F.col("head").alias("first"), "last", "seq", "n", "depth", "ring")


def compacted(segments: DataFrame) -> DataFrame:
    """Segments with every path without a branch joined up to one. A written table."""
    return written(_joined(segments, _only_links(segments)).drop("ring"), "segments")


def _overlap_places(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places, of ``n``, of what k-mers begin and end with: of all letters but one, told by the smallest hash of their windows, so neighbours mostly share one."""
    lengths = pc.utf8_length(texts).to_numpy()
    begins, ends = np.zeros(len(texts), "u8"), np.zeros(len(texts), "u8")
    for k in np.unique(lengths[lengths > 1]).tolist():
        at, m = np.flatnonzero(lengths == k), (2 * (k - 1) + 4) // 5
        hashes = window_hashes(codes_of("".join(texts.take(pa.array(at)).to_pylist())), m)
        hashes = np.append(hashes, np.zeros(m - 1, "u8")).reshape(-1, k)
        begins[at], ends[at] = hashes[:, : k - m].min(1), hashes[:, 1 : k - m + 1].min(1)
    return tuple((mixed(h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.uint64(n) for h in (begins, ends))


def _stretches(first: pa.Array, depth: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """(first, last, seq, n, depth, next) of the k-mers of a place: all that begin, and all that end, with an overlap of this place are here. Those that ``ends`` marks are its own.

    A stretch goes on, within the place or to ``next``, where an overlap is the end of one k-mer and the beginning of one.
    """
    out, into = np.flatnonzero(ends), np.flatnonzero(begins)
    overlaps = pa.concat_arrays([pc.utf8_slice_codeunits(first.take(pa.array(out)), 1), pc.utf8_slice_codeunits(first.take(pa.array(into)), 0, -1)]).dictionary_encode()
    ids, n = overlaps.indices.to_numpy(), len(overlaps.dictionary)
    from_, to = ids[: len(out)], ids[len(out) :]
    one = (np.bincount(from_, minlength=n) == 1) & (np.bincount(to, minlength=n) == 1)
    source, target = np.zeros(n, "i8"), np.zeros(n, "i8")
    source[from_], target[to] = out, into
    source, target = source[one], target[one]
    other = pc.not_equal(first.take(pa.array(source)), first.take(pa.array(target))).to_numpy(zero_copy_only=False)
    source, target = source[other], target[other]
    onward = np.full(len(first), -1)
    onward[source] = target
    back = np.arange(len(first))
    here = ends[target]
    back[target[here]] = source[here]
    head, place, ring = _followed(back)
    # what runs in a cycle is joined up later
    head, place = np.where(ring, np.arange(len(first)), head), np.where(ring, 0, place)
    own = np.flatnonzero(ends)
    own = own[np.lexsort((place[own], head[own]))]
    starts = np.flatnonzero(place[own] == 0)
    stops = np.append(starts[1:], len(own))
    letters = "".join(pc.utf8_slice_codeunits(first.take(pa.array(own)), -1).to_pylist())
    texts = first.take(pa.array(own[starts])).to_pylist()
    final = own[stops - 1]
    after = onward[final]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(texts, pa.string()), first.take(pa.array(final)), pa.array([t + letters[a + 1 : b] for t, a, b in zip(texts, starts.tolist(), stops.tolist(), strict=True)], pa.string()), pa.array(stops - starts, pa.int64()),
            pa.array(np.add.reduceat(depth[own], starts), pa.int64()), first.take(pa.array(np.where(after < 0, 0, after), mask=after < 0)),
        ],
        names=["first", "last", "seq", "n", "depth", "next"],
    )


def _turned(first: str, last: str, seq: str) -> tuple[str, str, str]:
    """A ring's first and last k-mer and its text, begun at its smallest k-mer; behind it, where that is the other strand's."""
    k = len(first)
    own = [seq[i : i + k] for i in range(len(seq) - k + 1)]
    _, mirrored, at = min((min(x, m := x.upper().translate(_PAIRS)[::-1]), m < x, i) for i, x in enumerate(own))
    at = (at + mirrored) % len(own)
    own = own[at:] + own[:at]
    return own[0], own[-1], own[0] + "".join(x[-1] for x in own[1:])


def joined_kmers(counted: DataFrame) -> DataFrame:
    """``compacted`` of the ``segments_of`` k-mers (kmer, n; a written table). k-mers go to the places of what they begin and end with; only the stretches that a place makes of them are joined up."""
    spark = counted.sparkSession
    importable(spark)
    kmers = counted.count()
    n = max(1, -(-kmers // SHARE), spark.sparkContext.defaultParallelism if kmers > SHARE // 16 else 1)
    strands = counted.select(F.explode(F.array_distinct(F.array("kmer", reverse_complement(F.col("kmer"))))).alias("first"), F.col("n").cast("long").alias("depth"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begins, ends = _overlap_places(b.column("first"), n)
            same, every = begins == ends, np.arange(len(begins))
            for at, place, begin, end in ((every, ends, same, np.ones(len(same), bool)), (np.flatnonzero(~same), begins, ~same, same)):
                rows = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(place[at].astype("i4")), *rows.columns, pa.array(begin[at]), pa.array(end[at])], names=["place", "first", "depth", "begins", "ends"])

    def stretched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), schema=pa.schema([("place", pa.int32()), ("first", pa.string()), ("depth", pa.int64()), ("begins", pa.bool_()), ("ends", pa.bool_())])).combine_chunks()
        if len(held):
            first, depth, begins, ends = (held.column(c).chunk(0) for c in ("first", "depth", "begins", "ends"))
            whole = _stretches(first, depth.to_numpy(), begins.to_numpy(zero_copy_only=False), ends.to_numpy(zero_copy_only=False))
            for i in range(0, whole.num_rows, 1 << 14):
                yield whole.slice(i, 1 << 14)

    placed = strands.mapInArrow(dealt, "place int, first string, depth long, begins boolean, ends boolean").repartitionById(n, "place")
    pieces = written(placed.mapInArrow(stretched, "first string, last string, seq string, n long, depth long, next string"), "stretches")
    only = written(pieces.where("next is not null").select(F.col("first").alias("source"), F.col("next").alias("target")).join(pieces.select(F.col("first").alias("target"), _key().alias("key")), "target").select("source", "target", "key"), "only-links")
    whole = _joined(pieces.drop("next"), only)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(*_turned(r["first"], r["last"], r["seq"]), r["n"], r["depth"]) if r["ring"] and r["n"] > 1 else (r["first"], r["last"], r["seq"], r["n"], r["depth"]) for r in b.to_pylist()] if pc.any(b.column("ring")).as_py() else None
            if rows is None:
                yield b.select(["first", "last", "seq", "n", "depth"])
            else:
                yield pa.RecordBatch.from_pylist([dict(zip(("first", "last", "seq", "n", "depth"), r, strict=True)) for r in rows], schema=b.select(["first", "last", "seq", "n", "depth"]).schema)

    return written(whole.mapInArrow(turned, "first string, last string, seq string, n long, depth long"), "segments")


def _ranked(segments: DataFrame) -> DataFrame:
    """(first, key, n, rank_): the smaller of two ranks is the better covered segment; of equals the one with the smaller key."""
    return segments.select("first", _key().alias("key"), "n", F.struct((-F.col("depth") / F.col("n")).alias("c"), _key().alias("k")).alias("rank_"))


def tips(segments: DataFrame, links: DataFrame, longest: int) -> DataFrame:
    """(key) of segments of at most ``longest`` k-mers that nothing leads to and that lead to a segment which a better covered one leads to, too."""
    ranked = _ranked(segments)
    dead = ranked.where(F.col("n") <= longest).join(links.select(F.col("target").alias("first")), "first", "left_anti")
    rival = links.join(ranked.select(F.col("first").alias("source"), "rank_"), "source").groupBy("target").agg(F.min("rank_").alias("best_"))
    return dead.join(links, F.col("first") == F.col("source")).join(rival, "target").where("best_ < rank_ and best_.k <> key").select("key").distinct()


def bubbles(segments: DataFrame, links: DataFrame, longest: int) -> DataFrame:
    """(key) of segments of at most ``longest`` k-mers with one way in and one way out, where a better covered such segment has the same two."""
    into = links.groupBy(F.col("target").alias("first")).agg(F.count("*").alias("in_"), F.min("source").alias("from_"))
    out = links.groupBy(F.col("source").alias("first")).agg(F.count("*").alias("out_"), F.min("target").alias("to_"))
    arms = _ranked(segments).join(into, "first").join(out, "first").where((F.col("in_") == 1) & (F.col("out_") == 1) & (F.col("n") <= longest) & (F.col("from_") != F.col("first")) & (F.col("to_") != F.col("first")))
    best = arms.groupBy("from_", "to_").agg(F.min("rank_").alias("best_"), F.count("*").alias("arms_")).where("arms_ > 1")
    return arms.join(best, ["from_", "to_"]).where("best_.k <> key").select("key").distinct()


def corrected(now: DataFrame, k: int, longest: int | None = None) -> DataFrame:
    """Joined segments without tips and bubbles of at most ``longest`` (k, if none is given) k-mers. Fails if ``MAX_ROUNDS`` are not enough."""
    longest = k if longest is None else longest
    for _ in range(MAX_ROUNDS):
        links = written(segment_links(now), "segment-links")
        for find in (tips, bubbles):
            gone = written(find(now, links, longest), "gone")
            if not gone.isEmpty():
                break
        else:
            return now
        then, now = now, compacted(now.withColumn("key", _key()).join(gone, "key", "left_anti").drop("key"))
        for used in (then, links, gone):
            remove(used)
    raise RuntimeError(f"the graph was not settled in {MAX_ROUNDS} rounds")


def contigs(segments: DataFrame) -> DataFrame:
    """(contig, n_kmers, coverage): one strand of each segment, the smaller text; coverage is the mean count of its k-mers."""
    one = F.least("seq", reverse_complement(F.col("seq")))
    return segments.groupBy(one.alias("contig")).agg(F.max("n").alias("n_kmers"), F.round(F.max(F.col("depth") / F.col("n")), 9).alias("coverage"))


def assemble(reads: DataFrame, seq: str, k: int = 21, least: int | None = None, qual: str | None = None, least_quality: int = 20, mode: int = 2, longest: int | None = None) -> DataFrame:
    """(contig, n_kmers, coverage) of reads: k-mers of enough quality, seen ``least`` times (or the spectrum's first valley), joined up after tips and bubbles of at most ``longest`` k-mers are gone.

    Null and short reads have no k-mers; without k-mers there are no contigs. Other columns are not read.
    """
    if qual is None:
        plain = reads.select(F.translate(F.upper(seq), "U", "T").alias("seq"))
        solid = valley_counts(plain, "seq", k, both_strands=True) if least is None else written(counts(plain, "seq", k, both_strands=True, least=least), "kmers")
    else:
        solid = solid_kmers(written(counted_kmers(reads, seq, k, qual, least_quality, mode), "kmers"), least)
    return contigs(corrected(joined_kmers(solid), k, longest))

