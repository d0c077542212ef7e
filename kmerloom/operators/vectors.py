"""Operators of vectors: neighbours, preservation, fit measures, duplicates, batches and the projection network."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import batch_cap, padded_length
from ..plans.tables import importable, ranked, written

#: Rows of a block of vectors, at most and, unless a caller says so, at least; blocks are multiplied in pairs. Blocks that go by in one task, and scores that are held at once.
BLOCK_ROWS, LEAST_BLOCK, OTHER_BLOCKS, HELD_SCORES = 4096, 256, 64, 1 << 18
#: Rows of two blocks that are multiplied at once, so that their scores stay in the cache, and scores of a row of which the largest is taken first.
TILE, STRETCH = 512, 256


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _doubles(x: bytes, rows: int, kind: str) -> np.ndarray:
    return np.frombuffer(x, kind).reshape(rows, -1).astype("f8", copy=False)


def _packed(rows: DataFrame, block_rows: int, kind: str = "<f8") -> DataFrame:
    """(block, ids, x): ids and vectors of each partition of (id, v) in blocks of at most ``block_rows``, numbers of ``kind``; block is the partition's number. A written table."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, block_rows):
                part = b.slice(lo, block_rows)
                if n and n + part.num_rows > block_rows:
                    yield packed(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield packed(held)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        b, at = pa.concat_batches(held), TaskContext.get().partitionId()
        ids, x = b.column(0).to_numpy().astype("<i8"), _matrix(b.column(1)).astype(kind)
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([ids.tobytes()]), pa.array([x.tobytes()])], names=["block", "ids", "x"])

    return written(rows.mapInArrow(pack, "block int, ids binary, x binary"), "blocks")


def knn(vectors: DataFrame, id_col: str, vec: str, k: int = 15, metric: str = "cosine", block_rows: int | None = None) -> DataFrame:
    """(id, neighbour, rank, score) of each row's k nearest other rows, among all rows.

    Rows are packed into blocks and every block meets every other, so the work grows with the square of the rows; a task
    keeps the k best of each row it saw. Cosine similarities of zero vectors are 0; ties go to the smaller id. Cosines are
    first multiplied in single precision, and only pairs that its error cannot keep from a row's best so far are computed in double precision.
    """
    spark = vectors.sparkSession
    importable(spark)
    # floats travel as they are; they are computed with in double precision
    single = dict(vectors.select(F.col(vec).alias("v")).dtypes)["v"] == "array<float>"
    kind = "<f4" if single else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col(vec) if single else F.col(vec).cast("array<double>")).alias("v")).where("v is not null")
    cores = spark.sparkContext.defaultParallelism
    n = rows.count()
    size = block_rows or min(max(n // (4 * cores), LEAST_BLOCK), BLOCK_ROWS)
    parts = max(1, -(-n // size))
    blocks = _packed(rows.repartition(parts), block_rows or 2 * size, kind)  # one for each partition
    # a pair of blocks is a row of megabytes, so only few go into an Arrow batch
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)
    # a task has one block of queries, by which many others go, so that its best so far are soon good ones
    queries = blocks.repartitionById(parts, "block").select(F.monotonically_increasing_id().alias("key_"), "ids", "x")
    others = blocks.select(F.col("ids").alias("other_ids"), F.col("x").alias("other_x")).coalesce(max(1, parts // OTHER_BLOCKS))
    # the queries go along with the first block of a partition that they meet, not with each
    others = others.withColumn("first_", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0)
    pairs = queries.crossJoin(others).select("key_", "ids", F.when(F.col("first_"), F.col("x")).alias("x"), "other_ids", "other_x")

    def best(ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = min(k, score.shape[1])
        by = np.where(np.isnan(score), np.inf, score)  # first, as Spark and DuckDB sort them
        at, column = np.nonzero(by >= np.partition(by, -most, 1)[:, -most, None])
        order = np.lexsort((ids[at, column], -by[at, column], at))
        at, column = at[order], column[order]
        first = np.arange(len(at)) - np.searchsorted(at, at) < most
        column = column[first].reshape(len(ids), most)
        return np.take_along_axis(ids, column, 1), np.take_along_axis(score, column, 1)

    def euclidean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by a block's key: the best neighbours so far and their scores
        owns: dict[int, tuple[bytes, np.ndarray]] = {}
        for b in batches:
            for key, raw, own, other, theirs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                mine, ids = np.frombuffer(raw, "<i8"), np.frombuffer(other, "<i8")
                if key not in owns:
                    owns[key] = raw, _doubles(own, len(mine), kind)
                q, x = owns[key][1], _doubles(theirs, len(ids), kind)
                score = np.round(np.stack([-np.sqrt(((v - x) ** 2).sum(1)) for v in q]), 9)
                score[mine[:, None] == ids[None]] = -np.inf
                new = best(np.broadcast_to(ids, score.shape), score)
                if key in kept:
                    new = best(*(np.concatenate(c, 1) for c in zip(kept[key], new, strict=True)))
                kept[key] = new
        for key, (ids, score) in kept.items():
            mine = np.repeat(np.frombuffer(owns[key][0], "<i8"), ids.shape[1])
            real = score.ravel() != -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(c[real]) for c in (mine, ids.ravel(), score.ravel())], names=["id", "neighbour", "score"])

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, Nearest] = {}
        for b in batches:
            for key, raw, own, other, theirs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key not in kept:
                    kept[key] = Nearest(raw, own, k, kind)
                kept[key].meet(other, theirs)
        for nearest in kept.values():
            mine, ids, score = nearest.found()
            yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(ids), pa.array(score)], names=["id", "neighbour", "score"])

    near = pairs.mapInArrow(cosine if metric == "cosine" else euclidean, "id long, neighbour long, score double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "neighbour")).cast("long")).where(F.col("rank") <= k)
    return ranked.select("id", "neighbour", "rank", F.col("score") if metric == "cosine" else (-F.col("score")).alias("score"))


class Unit:
    """Rows of a block: ids, vectors, norms, vectors of length 1 in single precision, and which rows single precision says nothing of."""

    def __init__(self, ids: bytes, x: bytes, kind: str = "<f8"):
        self.ids = np.frombuffer(ids, "<i8")
        self.x = _doubles(x, len(self.ids), kind)
        with np.errstate(all="ignore"):
            self.norm = np.sqrt((self.x * self.x).sum(1))
            self.odd = ~((self.norm == 0) & ~self.x.any(1)) & ~((self.norm > 1e-100) & (self.norm < 1e100))
            self.unit = np.where(self.odd[:, None] | (self.norm == 0)[:, None], 0.0, self.x / np.where(self.norm > 0, self.norm, 1)[:, None]).astype("f4")


def _true(flags: np.ndarray) -> np.ndarray:
    """Where ``flags`` are true, of which few are: eight are asked at once."""
    whole = len(flags) // 8 * 8
    eights = np.flatnonzero(flags[:whole].view("u8"))
    which = np.flatnonzero(flags[:whole].reshape(-1, 8)[eights])
    return np.concatenate((eights[which >> 3] * 8 + (which & 7), whole + np.flatnonzero(flags[whole:])))


def _at_least(score: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of scores that reach their row's floor, of which few do: only stretches of a row whose largest does are looked through."""
    wide = STRETCH if score.shape[1] % STRETCH == 0 else score.shape[1]
    stretches = score.reshape(len(score), -1, wide)
    at, stretch = np.nonzero(stretches.max(2) >= floor[:, None])
    which, column = np.nonzero(stretches[at, stretch] >= floor[at, None])
    return at[which], stretch[which] * wide + column


class Nearest:
    """A block's ``k`` nearest by cosine among all rows that it has met; a row does not meet itself."""

    def __init__(self, ids: bytes, x: bytes, k: int, kind: str = "<f8"):
        self.own, self.k, self.kind = Unit(ids, x, kind), k, kind
        # single precision's error of a product of unit vectors, and that of rounding to nine digits
        self.slack = (self.own.x.shape[1] + 16) * 2.0**-23 + 1e-8
        self.floor = np.full(len(self.own.ids), -np.inf)  # of each row the worst of its k best, or less than any
        self.rows, self.ids, self.score = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def meet(self, ids: bytes, x: bytes) -> None:
        other = Unit(ids, x, self.kind)
        odd = np.flatnonzero(other.odd)
        if len(other.ids) > self.k and np.isneginf(self.floor).any():
            step = max(1, HELD_SCORES // len(other.ids))
            for lo in range(0, len(self.own.ids), step):
                hi = min(lo + step, len(self.own.ids))
                # the k best of this block are no better than those of all
                sure = np.where(self.own.ids[lo:hi, None] == other.ids[None], np.float32(-np.inf), self.own.unit[lo:hi] @ other.unit.T)
                sure[:, odd] = -np.inf
                self.floor[lo:hi] = np.maximum(self.floor[lo:hi], np.partition(sure, -self.k, 1)[:, -self.k] - self.slack)
        for lo in range(0, len(self.own.ids), TILE):
            mine = self.own.odd[lo : lo + TILE]
            for left in range(0, len(other.ids), TILE):
                theirs = other.odd[left : left + TILE]
                score = self.own.unit[lo : lo + TILE] @ other.unit[left : left + TILE].T
                floor = np.nextafter((self.floor[lo : lo + TILE] - self.slack).astype("f4"), np.float32(-np.inf))
                if mine.any() or theirs.any():
                    at, column = np.divmod(_true((mine[:, None] | theirs[None] | (score >= floor[:, None])).ravel()), len(theirs))
                else:
                    at, column = _at_least(score, floor)
                for a in range(0, len(at), HELD_SCORES // 4):
                    self._exact(at[a : a + HELD_SCORES // 4] + lo, column[a : a + HELD_SCORES // 4] + left, other)
        if self.waiting > self.k * len(self.own.ids):
            self._settle()

    def _exact(self, at: np.ndarray, column: np.ndarray, other: Unit) -> None:
        apart = self.own.ids[at] != other.ids[column]
        at, column = at[apart], column[apart]
        with np.errstate(all="ignore"):
            n = self.own.norm[at] * other.norm[column]
            score = np.where(n > 0, np.einsum("ij,ij->i", self.own.x[at], other.x[column]) / np.where(n > 0, n, 1), 0.0)
        self.held.append((at, other.ids[column], np.round(score, 9)))
        self.waiting += len(at)
        if self.waiting > 2 * HELD_SCORES:
            self._settle()

    def _settle(self) -> None:
        """Leave each row's k best."""
        if not self.waiting:
            return
        at, ids, score = (np.concatenate(c) for c in zip((self.rows, self.ids, self.score), *self.held, strict=True))
        by = np.where(np.isnan(score), np.inf, score)  # first, as Spark and DuckDB sort them
        order = np.lexsort((ids, -by, at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        order, at, place = order[place < self.k], at[place < self.k], place[place < self.k]
        self.rows, self.ids, self.score = at, ids[order], score[order]
        full = place == self.k - 1
        self.floor[at[full]] = np.maximum(self.floor[at[full]], by[order[full]])
        self.held, self.waiting = [], 0

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, neighbour, score)."""
        self._settle()
        return self.own.ids[self.rows], self.ids, self.score


def neighbourhood_preservation(high: DataFrame, low: DataFrame) -> DataFrame:
    """(n, k, preservation, baseline): the share of neighbours (id, neighbour) in ``high`` that ``low`` has too, and what chance gives."""
    sizes = high.groupBy("id").agg(F.count("*").alias("k")).agg(F.count("*").alias("n"), F.max("k").alias("k"))
    shared = high.select("id", "neighbour").join(low.select("id", "neighbour"), ["id", "neighbour"]).agg(F.count("*").alias("shared"))
    return sizes.join(F.broadcast(shared)).select("n", "k", F.round(F.col("shared") / (F.col("n") * F.col("k")), 9).alias("preservation"), F.round(F.col("k") / (F.col("n") - 1), 9).alias("baseline"))


def fit_measures(pairs: DataFrame, predicted: str, target: str) -> DataFrame:
    """(n, mse, variance, r2) over all coordinates of two array columns."""
    c = pairs.select(F.explode(F.arrays_zip(F.col(predicted).alias("p"), F.col(target).alias("t"))).alias("z")).select(F.col("z.p").cast("double").alias("p"), F.col("z.t").cast("double").alias("t"))
    m = c.agg(F.count("*").alias("n"), F.avg((F.col("p") - F.col("t")) ** 2).alias("mse"), F.var_pop("t").alias("variance"))
    return m.select("n", F.round("mse", 9).alias("mse"), F.round("variance", 9).alias("variance"), F.round(1 - F.col("mse") / F.col("variance"), 6).alias("r2"))


def worst_differences(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(worst_abs, worst_cosine) of two array columns."""
    from ..functions.vectors import cosine

    return pairs.agg(F.max(F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))).alias("worst_abs"), F.min(cosine(F.col(a), F.col(b))).alias("worst_cosine"))


def first_of_equal(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """Of rows with an equal value the first. Compared by value, so without the collisions of a hash.

    Values are reduced to the first row's order by a hashed aggregation before anything is joined back.
    """
    firsts = rows.groupBy(value).agg(F.min(F.struct(*order)).alias("first_"))
    return firsts.select("first_.*", value)


def batch_plan(records: DataFrame, id_col: str, residues: str, budget: int = 16_000_000, heads: int = 20, most: int = 64) -> DataFrame:
    """(id, padded, cap, batch_no): records of one padded length share batches of at most ``cap``; batches are numbered within their length."""
    padded = records.select(id_col, F.col(residues).cast("long").alias("residues_"), padded_length(F.col(residues)).alias("padded"))
    capped = padded.withColumn("cap", batch_cap(F.col("padded"), budget, heads, most))
    at = ranked(capped, "at_", "residues_", id_col, within="padded")
    return at.select(id_col, "padded", "cap", F.floor((F.col("at_") - 1) / F.col("cap")).cast("long").alias("batch_no"))


def fixed_batches(records: DataFrame, id_col: str, residues: str, size: int, group: str | None = None) -> DataFrame:
    """(id, batch_no): records by length in batches of ``size``, within each ``group``."""
    at = ranked(records, "at_", residues, id_col, within=group)
    return at.select(id_col, *([group] if group else []), F.floor((F.col("at_") - 1) / size).cast("long").alias("batch_no"))


def mlp_project(vectors: DataFrame, id_col: str, vec: str, layers: list[tuple[np.ndarray, np.ndarray]], slope: float = 0.1) -> DataFrame:
    """(id, projected) by a network of (weights out x in, bias) layers, leaky ReLU between them. The weights' size is the model's."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast([(np.asarray(w, "f4"), np.asarray(b, "f4")) for w, b in layers])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1)).astype("f4")
            for i, (w, bias) in enumerate(shared.value):
                x = (x @ w.T if len(x) else np.zeros((0, len(bias)), "f4")) + bias
                if i < len(shared.value) - 1:
                    x = np.where(x > 0, x, slope * x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float32()))], names=["id", "projected"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), vec).mapInArrow(run, "id long, projected array<float>")


def seeded_split(rows: DataFrame, id_col: str, seed: int = 42, holdout: float = 0.15) -> DataFrame:
    """``rows`` with ``holdout``: a reproducible share of about ``holdout``, decided by each id's md5 alone."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("long")
    return rows.withColumn("holdout", draw < int(holdout * 2**32))


def subsample(rows: DataFrame, id_col: str, proportion: float, seed: int = 0) -> DataFrame:
    """A reproducible share of rows, decided by each id's md5 alone."""
    return seeded_split(rows, id_col, seed, proportion).where("holdout").drop("holdout")


def remaining(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Rows whose key the manifest of finished work does not have."""
    return rows.join(manifest.select(key).distinct(), key, "left_anti")


def batch_bounds(batched: DataFrame, *batch: str) -> DataFrame:
    """(batch_min, batch_max): records in the smallest and in the largest batch; a batch is named by the columns given."""
    return batched.groupBy(*batch).agg(F.count("*").alias("n_")).agg(F.min("n_").alias("batch_min"), F.max("n_").alias("batch_max"))


def seeded_shuffle(rows: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """``rows`` with ``place``, from 1: an order that the seed and each id's md5 decide, ties by id."""
    drawn = rows.withColumn("draw_", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))))
    return ranked(drawn, "place", "draw_", id_col).drop("draw_")


def in_input_order(batched: DataFrame, id_col: str) -> DataFrame:
    """``batched`` with ``place``, from 0: where a record stood in the input, whose order is that of its ids."""
    return ranked(batched, "place", id_col).withColumn("place", F.col("place") - 1)
