"""k-mers of sequences: extraction, spectra, minimizers, sketches, depletion, split k-mers.

Sequences are cut into blocks that overlap by k - 1 letters before k-mers are taken, since reaching into a long string
costs time in proportion to the place. k-mers are over code points. Sequences shorter than k have none; null ones too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import canonical, quality_cased
from ..plans.tables import checked_broadcast, remove, spread, written
from . import matching, minima, runs

#: Letters of a block; k-mers of an index that is sent to the tasks (8 bytes each, and their texts once).
BLOCK, KNOWN = 256, 200_000
#: Flanks with several middles that are sent to the tasks as hashes.
VARIED = 500_000


def blocks(seqs: DataFrame, seq: str, k: int, overlap: int = 0, before: int = 0) -> DataFrame:
    """``seqs`` without ``seq`` but with ``block`` (a piece that yields BLOCK positions), ``start`` (of its first
    letter, from 0) and ``n_kmers`` of the sequence. ``overlap`` and ``before`` add letters behind and before the piece."""
    n = F.length(seq)
    cut = lambda i: F.struct(F.greatest(i * BLOCK - before, F.lit(0)).alias("start"), F.substring(F.col(seq), F.greatest(i * BLOCK - before, F.lit(0)) + 1, F.lit(BLOCK + k - 1 + overlap) + F.least(i * BLOCK, F.lit(before))).alias("block"), (i * BLOCK).alias("first"))
    others = [c for c in seqs.columns if c != seq]
    cuts = spread(seqs).where(n >= k).withColumn("n_kmers", (n - k + 1).cast("long")).withColumn("cut_", F.explode(F.transform(F.sequence(F.lit(0), ((n - k) / BLOCK).cast("int")), cut)))
    return cuts.select(*others, "n_kmers", "cut_.block", "cut_.start", "cut_.first")


def _windows(block: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(block) - k + 1), lambda p: F.substring(block, p, F.lit(k)))


def kmers(seqs: DataFrame, seq: str, k: int = 31, positions: bool = False, both_strands: bool = False) -> DataFrame:
    """The other columns with ``kmer`` and, if asked for, ``pos`` (from 0) of every k-mer of every sequence."""
    cut, others = blocks(seqs, seq, k), [c for c in seqs.columns if c != seq]
    if positions:
        out = cut.select(*others, "start", F.posexplode(_windows(F.col("block"), k)).alias("at", "kmer")).select(*others, (F.col("start") + F.col("at")).cast("long").alias("pos"), "kmer")
    else:
        out = cut.select(*others, F.explode(_windows(F.col("block"), k)).alias("kmer"))
    return out.withColumn("kmer", canonical(F.col("kmer"))) if both_strands else out


def counts(seqs: DataFrame, seq: str, k: int = 31, both_strands: bool = False, least: int = 1) -> DataFrame:
    """(kmer, n): how often each k-mer stands in all sequences, of those that stand ``least`` times or more. Runs of k-mers are shuffled, not k-mers (``runs``)."""
    return runs.counts(seqs, seq, k, both_strands, least)


def min_count(counted: DataFrame, least: int = 5) -> DataFrame:
    return counted.where(F.col("n") >= least)


def spectrum(counted: DataFrame, bins: int = 500) -> DataFrame:
    """(multiplicity, n_kmers): how many k-mers stand how often; the last bin holds all above."""
    return counted.groupBy(F.least(F.col("n"), F.lit(bins)).cast("long").alias("multiplicity")).agg(F.count("*").alias("n_kmers"))


def spectrum_of(seqs: DataFrame, seq: str, k: int = 31, both_strands: bool = False, bins: int = 500) -> DataFrame:
    """``spectrum`` of the counts of all sequences' k-mers, none of which leaves its task."""
    n = runs.multiplicities(seqs, seq, k, both_strands)
    return n.groupBy(F.least(F.col("n"), F.lit(bins)).cast("long").alias("multiplicity")).agg(F.sum("n_kmers").alias("n_kmers"))


def fitted_min_count(spectrum_: DataFrame, bins: int = 500) -> DataFrame:
    """(min_count): the first multiplicity whose count is no larger than its neighbours'; 1 without one. Bins without k-mers count 0.

    The spectrum has at most ``bins`` rows, so its one window is bounded.
    """
    every = spectrum_.sparkSession.range(1, bins + 1).withColumnRenamed("id", "multiplicity")
    s = every.join(F.broadcast(spectrum_), "multiplicity", "left").select("multiplicity", F.coalesce("n_kmers", F.lit(0)).alias("n"))
    w = Window.orderBy("multiplicity")
    low = s.select("multiplicity", "n", F.lag("n").over(w).alias("before"), F.lead("n").over(w).alias("after")).where("n <= before and n <= after")
    return low.agg(F.coalesce(F.min("multiplicity"), F.lit(1)).alias("min_count"))


def valley_counts(seqs: DataFrame, seq: str, k: int = 31, both_strands: bool = False, bins: int = 500) -> DataFrame:
    """(kmer, n) of the k-mers that stand as often as ``fitted_min_count`` of the spectrum, or more. A written table.

    Sequences are counted once: tasks keep what may be enough, by their own share of the spectrum. Where that was too little, they are counted again.
    """
    own = written(runs.likely_counts(seqs, seq, k, both_strands, bins), "kmers")
    found = own.where("n_kmers is not null").groupBy(F.least(F.col("n"), F.lit(bins)).cast("long").alias("multiplicity")).agg(F.sum("n_kmers").alias("n_kmers"))
    least = fitted_min_count(found, bins).first()[0]
    bound = own.agg(F.max("bound")).first()[0] or 1
    if least < bound:
        remove(own)
        return written(runs.counts(seqs, seq, k, both_strands, least), "kmers")
    return own.where(F.col("kmer").isNotNull() & (F.col("n") >= least)).select("kmer", "n")


def minimizers(seqs: DataFrame, seq: str, k: int = 31, w: int = 15) -> DataFrame:
    """The other columns with ``pos`` and ``kmer``: of each w k-mers in a row the one with the smallest md5, the first of equals.

    Each minimizer is given once. A sequence with fewer than w k-mers is one window. Without a shuffle: a task takes whole texts (``minima``).
    """
    return minima.minimizers(seqs, seq, k, w)


def required_hits(n: Column, absolute: int, relative: float) -> Column:
    """max(absolute, relative part of n rounded half up, at least 1 of any)."""
    return F.greatest(F.lit(absolute), F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.round(F.lit(relative) * n)))).cast("long")


def contained(reads: DataFrame, index: DataFrame, id_col: str, seq: str, k: int = 31, w: int = 15, absolute: int = 1, relative: float = 0.05, deplete: bool = True) -> DataFrame:
    """(id, n_minimizers, hits, kept) of every read: minimizers with repeats, distinct ones that ``index`` (kmer) has, and the verdict.

    Reads shorter than k are kept when depleting and dropped when searching. A read's task counts its minimizers and gives those that the index may have; only these
    few and one count of each read are shuffled. An index beyond ``KNOWN`` k-mers is joined with all minimizers.
    """
    known = written(index.select("kmer").where("kmer is not null").distinct(), "side")
    if known.count() <= KNOWN:
        own = minima.known_minimizers(reads, id_col, seq, k, w, [r["kmer"] for r in known.toLocalIterator()])
        own = written(own, "minimizers")
        hits = own.select(id_col, F.explode("found").alias("kmer")).distinct().join(F.broadcast(known), "kmer", "left_semi").groupBy(id_col).agg(F.count("*").alias("hits"))
        n = own.groupBy(id_col).agg(F.sum("n_minimizers").alias("n_minimizers")).join(hits, id_col, "left")
    else:
        found = minimizers(reads.select(id_col, seq), seq, k, w).join(known.withColumn("known_", F.lit(True)), "kmer", "left")
        n = found.groupBy(id_col).agg(F.count("*").alias("n_minimizers"), F.count_distinct(F.when(F.col("known_"), F.col("kmer"))).alias("hits"))
    counted = reads.select(id_col, F.coalesce(F.length(seq), F.lit(0)).alias("len_")).join(n, id_col, "left").na.fill(0, ["n_minimizers", "hits"])
    enough = F.col("hits") >= required_hits(F.col("n_minimizers"), absolute, relative)
    kept = F.when(F.col("len_") < k, F.lit(deplete)).otherwise(~enough if deplete else enough)
    return counted.select(id_col, "n_minimizers", "hits", kept.alias("kept"))


def filter_stats(verdicts: DataFrame, reads: DataFrame, id_col: str, seq: str) -> DataFrame:
    """(reads_in, reads_out, bases_in, bases_out)."""
    joined = reads.select(id_col, F.coalesce(F.length(seq), F.lit(0)).cast("long").alias("bases")).join(verdicts.select(id_col, "kept"), id_col)
    return joined.agg(F.count("*").alias("reads_in"), F.count_if("kept").alias("reads_out"), F.coalesce(F.sum("bases"), F.lit(0)).alias("bases_in"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("bases"))), F.lit(0)).alias("bases_out"))


def sketches(seqs: DataFrame, id_col: str, seq: str, k: int = 17, size: int = 50) -> DataFrame:
    """(id, hash): the ``size`` smallest md5 of each sequence's distinct k-mers.

    Each row keeps its smallest before anything is shuffled.
    """
    rows = minima.smallest_hashes(seqs, id_col, seq, k, size).distinct()
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("hash"))
    return rows.withColumn("r_", rank).where(F.col("r_") <= size).drop("r_")


def inverted_index_top(queries: DataFrame, index: DataFrame, query_id: str, ref_id: str, k: int = 17, size: int = 50, top: int = 3) -> DataFrame:
    """(query, ref, shared, jaccard, ani, rank) of the ``top`` references by shared hashes; ties share a rank, so more may be given.

    Jaccard is shared / (both sketch sizes - shared); ANI is 1 + ln(2j / (1 + j)) / k.
    """
    sizes_q, sizes_r = queries.groupBy(query_id).agg(F.count("*").alias("nq")), index.groupBy(ref_id).agg(F.count("*").alias("nr"))
    shared = checked_broadcast(queries).join(index, "hash").groupBy(query_id, ref_id).agg(F.count("*").alias("shared"))
    both = shared.join(sizes_q, query_id).join(sizes_r, ref_id)
    j = F.col("shared") / (F.col("nq") + F.col("nr") - F.col("shared"))
    scored = both.select(query_id, ref_id, "shared", F.round(j, 9).alias("jaccard"), F.round(1 + F.log(2 * j / (1 + j)) / k, 9).alias("ani"))
    return scored.withColumn("rank", F.rank().over(Window.partitionBy(query_id).orderBy(F.desc("jaccard"))).cast("long")).where(F.col("rank") <= top)


def split_kmers(seqs: DataFrame, seq: str, flank: int = 15) -> DataFrame:
    """The other columns with ``pos`` (of the middle), ``flanks`` (left and right letters) and ``middle``."""
    return _split(kmers(seqs, seq, 2 * flank + 1, positions=True), [c for c in seqs.columns if c != seq], flank)


def _split_kmers_in(seqs: DataFrame, seq: str, flank: int, index: DataFrame, most: int | None = None) -> DataFrame:
    """``split_kmers`` without those whose flanks ``index`` (flanks, a written table) lacks, as in ``kmers_in``."""
    if index.count() > (KNOWN if most is None else most):
        return split_kmers(seqs, seq, flank)
    known = [r["flanks"] for r in index.select("flanks").toLocalIterator()]
    return _split(matching.matching(seqs, seq, 2 * flank + 1, known, flank), [c for c in seqs.columns if c != seq], flank)


def _split(found: DataFrame, others: list[str], flank: int) -> DataFrame:
    return found.select(*others, (F.col("pos") + flank).alias("pos"), F.concat(F.substring("kmer", 1, flank), F.substring("kmer", flank + 2, flank)).alias("flanks"), F.substring("kmer", flank + 1, 1).alias("middle"))


def kmers_in(seqs: DataFrame, seq: str, k: int, index: DataFrame, positions: bool = False) -> DataFrame:
    """``kmers`` without those that ``index`` (kmer) lacks, but for a few that share a hash: a join must follow. An index beyond ``KNOWN`` k-mers leaves all."""
    known = written(index.select("kmer").where("kmer is not null").distinct(), "side")
    if known.count() > KNOWN:
        return kmers(seqs, seq, k, positions)
    found = matching.matching(seqs, seq, k, [r["kmer"] for r in known.toLocalIterator()])
    return found if positions else found.drop("pos")


def map_to_reference(samples: DataFrame, reference: DataFrame, sample: str, chrom: str, seq: str, flank: int = 15) -> DataFrame:
    """(sample, chrom, pos, ref, mapped): the sample's middle base at every reference position whose flanks the sample has.

    Reference flanks that stand more than once are repeats and left out; where a sample's flanks have several
    middles the smallest letter among the most frequent stands.
    """
    ref = split_kmers(reference.select(chrom, seq), seq, flank)
    unique = ref.groupBy("flanks").agg(F.count("*").alias("n_"), F.min(chrom).alias(chrom), F.min("pos").alias("pos"), F.min("middle").alias("ref")).where("n_ = 1").drop("n_")
    unique = written(unique, "side")
    own = _split_kmers_in(samples.select(sample, seq), seq, flank, unique).select(sample, "flanks", "middle")
    hits = own.join(checked_broadcast(unique), "flanks").groupBy(sample, chrom, "pos", "ref", "middle").agg(F.count("*").alias("n_"))
    best = F.row_number().over(Window.partitionBy(sample, chrom, "pos").orderBy(F.desc("n_"), "middle"))
    return hits.withColumn("b_", best).where("b_ = 1").select(sample, chrom, "pos", "ref", F.col("middle").alias("mapped"))


def mapping_summary(mapped: DataFrame, reference: DataFrame, sample: str, chrom: str, seq: str) -> DataFrame:
    """(sample, nb_variants, coverage): mapped bases unlike the reference's, and the share of the reference that is mapped."""
    total = reference.agg(F.sum(F.length(seq)).alias("total_"))
    return mapped.groupBy(sample).agg(F.count_if(F.col("mapped") != F.col("ref")).alias("nb_variants"), F.count("*").alias("n_")).join(F.broadcast(total)).select(sample, "nb_variants", F.round(F.col("n_") / F.col("total_"), 9).alias("coverage"))


def vcf_rows(mapped: DataFrame, sample: str, chrom: str) -> DataFrame:
    """(chrom, pos from 1, ref, alt, sample) of every variant."""
    return mapped.where("mapped <> ref").select(F.col(chrom).alias("chrom"), (F.col("pos") + 1).alias("pos"), "ref", F.col("mapped").alias("alt"), sample)


def split_kmer_alignment(samples: DataFrame, sample: str, seq: str, flank: int = 15, least_samples: int = 3) -> DataFrame:
    """(flanks, sample, base) of every column that ``least_samples`` samples share and in which they differ; several bases of a sample are 'N'."""
    # flanks with several middles, found from runs of k-mers; only these become rows with their samples
    varied = written(runs.varied_flanks(samples, seq, flank, least_samples), "flanks")
    found = _split_kmers_in(samples.select(sample, seq), seq, flank, varied, VARIED).join(varied, "flanks", "left_semi")
    own = found.groupBy("flanks", sample).agg(F.min("middle").alias("lo"), F.max("middle").alias("hi")).select("flanks", sample, F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit("N")).alias("base"))
    kept = own.groupBy("flanks").agg(F.count("*").alias("n_"), F.min("base").alias("lo"), F.max("base").alias("hi")).where((F.col("n_") >= least_samples) & (F.col("lo") != F.col("hi"))).select("flanks")
    return own.join(kept, "flanks", "left_semi")


def debruijn_edges(counted: DataFrame) -> DataFrame:
    """(source, target): k-mers of ``counted`` that overlap by all letters but one. An equi-join on the overlap."""
    k = F.length("kmer")
    left = counted.select(F.col("kmer").alias("source"), F.substring(F.col("kmer"), F.lit(2), k - 1).alias("overlap"))
    right = counted.select(F.col("kmer").alias("target"), F.substring(F.col("kmer"), F.lit(1), k - 1).alias("overlap"))
    return left.join(right, "overlap").select("source", "target")


def debruijn_degrees(counted: DataFrame, edges: DataFrame) -> DataFrame:
    """(kmer, n_in, n_out)."""
    n_in = edges.groupBy(F.col("target").alias("kmer")).agg(F.count("*").alias("n_in"))
    n_out = edges.groupBy(F.col("source").alias("kmer")).agg(F.count("*").alias("n_out"))
    return counted.select("kmer").join(n_in, "kmer", "left").join(n_out, "kmer", "left").na.fill(0, ["n_in", "n_out"])


#: Steps of paths up to which what they look for is broadcast, so that the table looked in is not shuffled.
FEW_STEPS = 400_000


def unitigs(counted: DataFrame) -> DataFrame:
    """(contig): the k-mers of ``counted`` with unbranched paths joined up; a cycle begins at its smallest k-mer.

    K-mers are numbered in their order, and numbers travel instead of texts. Paths are compressed by pointer jumping: each round doubles how far a k-mer
    sees back to its path's first one, so the rounds grow with the logarithm of the longest path. A k-mer that sees the first one is left alone from then on.
    """
    from ..plans.tables import written

    named = written(counted.select("kmer").repartitionByRange("kmer").sortWithinPartitions("kmer").withColumn("id", F.monotonically_increasing_id()), "named")
    # an overlap that one k-mer ends with and one begins with is a link without a branch
    none = F.lit(None).cast("long")
    ends = named.select(F.expr("substring(kmer, 2)").alias("overlap"), F.col("id").alias("back"), none.alias("id"))
    begins = named.select(F.expr("substring(kmer, 1, length(kmer) - 1)").alias("overlap"), none.alias("back"), "id")
    met = ends.unionByName(begins).groupBy("overlap").agg(F.count("back").alias("n_back"), F.count("id").alias("n_id"), F.min("back").alias("back"), F.min("id").alias("id"))
    links = written(met.where("n_back = 1 and n_id = 1 and back <> id").select("id", "back"), "links")
    paths, rings = _seen_back(named.select("id"), links)
    if not rings.isEmpty():
        # what has no first k-mer runs in a cycle: cut before its smallest k-mer and numbered from there
        own = links.join(rings.select("id"), "id", "left_semi").join(rings.select(F.col("least").alias("id")).distinct(), "id", "left_anti")
        paths = paths.unionByName(_seen_back(rings.select("id"), own)[0])
    letters = paths.join(named.select("id", F.substring("kmer", -1, 1).alias("c")), "id").groupBy("head").agg(F.array_sort(F.collect_list(F.struct("steps", "c"))).alias("s"))
    whole = letters.join(named.select(F.col("id").alias("head"), F.expr("substring(kmer, 1, length(kmer) - 1)").alias("first")), "head")
    return whole.select(F.concat("first", F.array_join(F.transform("s", lambda x: x["c"]), "")).alias("contig"))


def _seen_back(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, head, steps) of the nodes (id) that are in paths along ``links`` (id, back), and (id, least) of those in cycles, with the smallest node of each."""
    from ..plans.tables import written

    plain = ["id", "at", "steps", "least", "known"]
    state = nodes.join(links, "id", "left").select("id", F.coalesce("back", "id").alias("at"), F.when(F.col("back").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.least("id", "back").alias("least"), F.col("back").isNull().alias("known"))
    state = written(state, "paths")
    known, open_ = state.where("known"), state.where("not known")
    n, reach = open_.count(), 1
    while n:
        # of each node that is seen: what it sees itself
        seen = known.unionByName(open_)
        if n <= FEW_STEPS:
            seen = seen.join(F.broadcast(open_.select(F.col("at").alias("id"))), "id", "left_semi")
        seen = seen.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("steps2"), F.col("least").alias("least2"), F.col("known").alias("known2"))
        then = open_.select("id", "at", "steps", "least").join(seen, "at").select("id", F.col("at2").alias("at"), (F.col("steps") + F.col("steps2")).alias("steps"), F.least("least", "least2").alias("least"), F.col("known2").alias("known"))
        then = written(then.select(plain), "paths")
        known, open_ = known.unionByName(then.where("known")), then.where("not known")
        before, n, reach = n, open_.count(), reach * 2
        # a path that is not seen to its end gets shorter in each round, so the rest are cycles; each has been gone round when as many steps are seen
        if n == before and reach >= n:
            break
    return known.select("id", F.col("at").alias("head"), "steps"), open_.select("id", "least")


def quality_kmers(reads: DataFrame, seq: str, qual: str, k: int = 31, least: int = 20, mode: int = 2) -> DataFrame:
    """The other columns with ``kmer``, in upper case, of windows of enough quality: mode 0 takes all, 1 those whose middle base has ``least``, 2 those whose bases all have.

    Reads whose quality is missing or of another length have k-mers in mode 0 only.
    """
    if mode not in (0, 1, 2):
        raise ValueError(f"there is no quality mode {mode}")
    others = [c for c in reads.columns if c not in (seq, qual)]
    marked = reads.select(*others, (F.upper(seq) if mode == 0 else quality_cased(F.col(seq), F.col(qual), least)).alias(seq))
    found = kmers(marked, seq, k)
    tested = {0: F.lit(True), 1: F.substring("kmer", k // 2 + 1, 1) == F.upper(F.substring("kmer", k // 2 + 1, 1)), 2: F.col("kmer") == F.upper("kmer")}
    return found.where(tested[mode]).withColumn("kmer", F.upper("kmer"))


def repeats_masked(references: DataFrame, id_col: str, seq: str, k: int) -> DataFrame:
    """(id, masked): N wherever a k-mer stands that all references together hold more than once. Letters of one reference meet in one row."""
    found = kmers(references.select(id_col, seq), seq, k, positions=True)
    repeated = found.groupBy("kmer").agg(F.count("*").alias("n_")).where("n_ > 1").select("kmer")
    covered = found.join(repeated, "kmer", "left_semi").select(id_col, F.explode(F.sequence("pos", F.col("pos") + k - 1)).alias("pos")).distinct().withColumn("n_", F.lit("N"))
    letters = references.select(id_col, F.posexplode(F.split(seq, "")).alias("at_", "c_")).select(id_col, F.col("at_").cast("long").alias("pos"), "c_")
    merged = letters.join(covered, [id_col, "pos"], "left").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("n_", "c_").alias("c")))).alias("l_"))
    return merged.select(id_col, F.array_join(F.transform("l_", lambda x: x["c"]), "").alias("masked"))


def sample_sketches(reads: DataFrame, sample: str, seq: str, k: int = 17, size: int = 50, least: int = 5) -> DataFrame:
    """(sample, hash): the ``size`` smallest md5 of the k-mers that a sample's reads hold ``least`` times or more.

    Runs of k-mers are shuffled, not k-mers; each task keeps its smallest before samples are brought together.
    """
    counted = runs.counts(reads, seq, k, least=least, by=sample)
    hashes = counted.select(sample, F.md5("kmer").alias("hash"))
    return hashes.withColumn("r_", F.row_number().over(Window.partitionBy(sample).orderBy("hash"))).where(F.col("r_") <= size).drop("r_")


def containment(queries: DataFrame, index: DataFrame, query_id: str, ref_id: str) -> DataFrame:
    """(query, ref, shared, containment): the share of a query's sketch that a reference's holds; pairs that share nothing are left out."""
    sizes = queries.groupBy(query_id).agg(F.count("*").alias("n_"))
    shared = checked_broadcast(queries).join(index, "hash").groupBy(query_id, ref_id).agg(F.count("*").alias("shared"))
    return shared.join(sizes, query_id).select(query_id, ref_id, "shared", F.round(F.col("shared") / F.col("n_"), 9).alias("containment"))


def sample_alignment(mapped: DataFrame, reference: DataFrame, sample: str, chrom: str, seq: str) -> DataFrame:
    """(sample, aligned): the mapped bases (sample, chrom, pos, mapped) of each sample, chromosome after chromosome, '-' where none is mapped.

    ``reference`` (sample, chrom, seq) names each sample's chromosomes. A sample's letters meet in one row, as its text is one.
    """
    places = reference.select(sample, chrom, F.posexplode(F.split(seq, "")).alias("at_", "c_")).select(sample, chrom, F.col("at_").cast("long").alias("pos"))
    letters = places.join(mapped.select(sample, chrom, "pos", "mapped"), [sample, chrom, "pos"], "left")
    rows = letters.groupBy(sample).agg(F.array_sort(F.collect_list(F.struct(chrom, "pos", F.coalesce("mapped", F.lit("-")).alias("c")))).alias("l_"))
    return rows.select(sample, F.array_join(F.transform("l_", lambda x: x["c"]), "").alias("aligned"))
