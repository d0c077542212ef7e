"""Distances between aligned sequences, single-linkage clusters and what is shown of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import column_state
from ..plans.tables import ranked
from .components import components

#: Letters of a block of aligned sequences, and columns that are compared at once (few enough for exact sums in single precision).
BLOCK_BYTES, COLUMNS = 32 << 20, 1 << 20


def snp_distance(a: Column, b: Column) -> Column:
    """The number of columns in which both sequences have a base (T and U are one) and differ."""
    bases = lambda s: F.split(F.translate(F.upper(s), "U", "T"), "")
    real = ("A", "C", "G", "T")
    return F.aggregate(F.zip_with(bases(a), bases(b), lambda x, y: F.when(x.isin(*real) & y.isin(*real) & (x != y), 1).otherwise(0)), F.lit(0).cast("long"), lambda s, x: s + x)


def _base_rows(seqs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The sequences as numbers, 0 to 3 for bases and 4 for all else, each filled up to the longest."""
    lookup = np.full(256, 4, "u1")
    for i, letters in enumerate((b"Aa", b"Cc", b"Gg", b"TtUu")):
        lookup[list(letters)] = i
    raw = [lookup[np.frombuffer((s or "").encode("latin-1", "replace"), "u1")] for s in seqs]
    out = np.full((len(raw), max(map(len, raw), default=0)), 4, "u1")
    for row, r in zip(out, raw, strict=True):
        row[: len(r)] = r
    return out


def _differences(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """For each pair of rows the columns in which both have a base and differ: columns with two bases less equal ones, as products of indicator matrices."""
    n = min(one.shape[1], two.shape[1])
    out = np.zeros((len(one), len(two)), "i8")
    for at in range(0, n, COLUMNS):
        x, y = one[:, at : min(at + COLUMNS, n)], two[:, at : min(at + COLUMNS, n)]
        counts = (x < 4).astype("f4") @ (y < 4).astype("f4").T
        for base in range(4):
            counts -= (x == base).astype("f4") @ (y == base).astype("f4").T
        out += counts.astype("i8")
    return out


def pairwise_snp(aligned: DataFrame, sample: str = "sample", seq: str = "seq", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b, snp_distance) of every pair a < b of samples; distances are those of ``snp_distance``.

    All pairs are what is asked for, so work grows with their number. Samples are dealt into blocks of about ``block_bytes`` letters, each
    pair of blocks (the second not before the first) is one key that both are sent to, and a task counts its pairs by matrix products. No task
    holds more than two blocks. Sequences of different lengths are compared as far as both go; null ones differ nowhere. Sample names are
    distinct; a name that comes twice is compared with others each time.
    """
    kind = dict(aligned.dtypes)[sample]
    letters = aligned.agg(F.coalesce(F.sum(F.length(seq)), F.lit(0))).first()[0]
    n = max(1, -(-int(letters) // block_bytes))
    own = aligned.select(F.col(sample).alias("name"), F.col(seq).alias("seq"), F.pmod(F.xxhash64(sample), F.lit(n)).cast("int").alias("own"))
    blocks = F.sequence(F.lit(0), F.lit(n - 1))
    keyed = own.withColumn("other", F.explode(blocks)).select("name", "seq", "own", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))

    def compare(t: pa.Table) -> pa.Table:
        one, two = t.column("one")[0].as_py(), t.column("two")[0].as_py()
        names, rows, side = t.column("name").combine_chunks(), _base_rows(t.column("seq").to_pylist()), t.column("own").to_numpy()
        left, right = np.flatnonzero(side == one), np.flatnonzero(side == two)
        d = _differences(rows[left], rows[right])
        i, j = np.indices(d.shape).reshape(2, -1)
        a, b = names.take(pa.array(left[i])), names.take(pa.array(right[j]))
        less = pc.less(a, b)
        # pairs of two blocks come once, in either order; those of one block twice
        swap = pc.greater(a, b) if one != two else pa.array(np.zeros(len(i), bool))
        keep = pc.or_(less, swap)
        out = pa.table([pc.if_else(swap, b, a), pc.if_else(swap, a, b), pa.array(d.ravel())], names=["a", "b", "snp_distance"])
        return out.filter(keep)

    return keyed.groupBy("one", "two").applyInArrow(compare, f"a {kind}, b {kind}, snp_distance long")


def single_linkage(samples: DataFrame, distances: DataFrame, threshold: int = 20, sample: str = "sample") -> DataFrame:
    """(sample, cluster): samples joined by chains of distances <= threshold; clusters are numbered from 1 by their smallest sample."""
    rooted = components(distances.where(F.col("snp_distance") <= threshold).select("a", "b"))
    named = samples.select(sample).join(rooted, F.col(sample) == F.col("node"), "left").select(sample, F.coalesce("root", sample).alias("root"))
    # one row for each cluster is numbered
    numbers = ranked(named.select("root").distinct(), "cluster", "root")
    return named.join(numbers, "root").select(sample, "cluster")


def split_by_location(clusters: DataFrame, order: str = "ord") -> DataFrame:
    """(name, cluster) with clusters split by location and numbered from 1 by first appearance. ``clusters`` has name, cluster, location and ``ord``."""
    located = clusters.withColumn("location", F.coalesce("location", F.lit("")))
    firsts = located.groupBy("cluster", "location").agg(F.min(order).alias("first_"))
    numbers = ranked(firsts, "id_", "first_").select("cluster", "location", "id_")
    return located.join(numbers, ["cluster", "location"]).select("name", F.col("id_").alias("cluster"))


def timeline(clusters: DataFrame) -> DataFrame:
    """(cluster, date, cluster_size, cases) from (cluster, date): members without a date are left out."""
    cases = clusters.where(F.col("date").isNotNull() & (F.col("date").cast("string") != "")).groupBy("cluster", "date").agg(F.count("*").alias("cases"))
    return cases.withColumn("cluster_size", F.sum("cases").over(Window.partitionBy("cluster")))


def known_links(links: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """Links whose two ends are nodes, with their opacity 0.3 + 0.7 (1 - d / the largest d, at least 1)."""
    ids = nodes.select(F.col(node).alias("n_")).distinct()
    kept = links.join(ids, F.col("source") == F.col("n_"), "left_semi").join(ids, F.col("target") == F.col("n_"), "left_semi")
    most = kept.agg(F.greatest(F.coalesce(F.max("snp_distance"), F.lit(1)), F.lit(1)).alias("most_"))
    return kept.join(F.broadcast(most)).select("source", "target", "snp_distance", F.round(0.3 + 0.7 * (1 - F.col("snp_distance") / F.col("most_")), 9).alias("opacity"))


def column_states(reference: str, mapped: str) -> Column:
    """The state of each column of two sequences, as one text."""
    return F.array_join(F.zip_with(F.split(reference, ""), F.split(mapped, ""), column_state), "")


def match_runs(pairs: DataFrame, key: str, reference: str, mapped: str) -> DataFrame:
    """(key, run, start, length, state): runs of columns in which a mapped sequence matches ('match'), differs ('mismatch') or has no base ('unmapped').

    Columns beyond the shorter sequence are unmapped. Runs are cut within each row, so nothing is shuffled.
    """
    n = F.length(reference)
    # both are taken apart once; what the mapped sequence lacks is null
    state = lambda r, m: F.when(m.isNull() | m.isin("-", ""), "u").when(m == r, "m").otherwise("x")
    states = F.zip_with(F.split(reference, ""), F.split(F.substring(F.col(mapped), F.lit(1), n), ""), state)
    coded = pairs.where(n > 0).select(key, F.array_join(F.when(F.col(mapped).isNull(), F.array_repeat(F.lit("u"), n)).otherwise(states), "").alias("s_"))
    cut = coded.select(key, F.posexplode(F.regexp_extract_all("s_", F.lit("(m+|x+|u+)"), 1)).alias("run", "piece"))
    w = Window.partitionBy(key).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    named = F.when(F.col("piece").startswith("m"), "match").when(F.col("piece").startswith("x"), "mismatch").otherwise("unmapped")
    return cut.select(key, F.col("run").cast("long").alias("run"), F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0)).cast("long").alias("start"), F.length("piece").cast("long").alias("length"), named.alias("state"))


def collapsed_gaps(columns: DataFrame, key: str, pos: str = "pos", base: str = "base") -> DataFrame:
    """(key, start, end, gap): a key's columns (one row for each sample and column) in stretches that no sample has a base in, and stretches that one has."""
    gaps = columns.groupBy(key, pos).agg(F.bool_and(F.col(base) == "-").alias("gap"))
    runs = gaps.withColumn("run_", F.col(pos) - F.row_number().over(Window.partitionBy(key, "gap").orderBy(pos)))
    return runs.groupBy(key, "gap", "run_").agg(F.min(pos).cast("long").alias("start"), (F.max(pos) + 1).cast("long").alias("end")).drop("run_")
