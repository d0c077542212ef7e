"""Operator 4: approximate nearest neighbours with a hash-prefix forest.

Each tree hashes a vector to a string of ``DEPTH`` bits, bit after bit the side of a random hyperplane on which it
lies; a tree is the sorted array of its strings. A query descends in every tree to the longest prefix that any
row shares with it, and then all trees ascend together, a bit at a time, until the rows with a prefix of that
length in common number ``share`` of the rows for each tree. These candidates are ranked by exact Euclidean
distance in double precision.

Rows are indexed in blocks of at most ``BLOCK_ROWS``, each a forest of its own; every query is answered in every block and the
blocks' best are merged. So the candidates are the same share of the rows at every size, which is what vectors
without small intrinsic dimension need for a steady recall (measured in the README), and a task holds one block.
Queries are packed into blocks of at most ``QUERY_BYTES`` too. A block of rows meets each block of queries as one row of a
join, so the plan does not grow with the queries, no task holds more than a block of either, and nothing passes through the driver.

Equal vectors are one entry of a forest with its ``k + 1`` smallest ids, which are all that any query can need of
them. Hyperplanes come from a seed and stand halfway between rows of a bounded sample of the vectors. Vectors of each
dimension are searched among themselves.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part. A query has fewer
than k rows if fewer other vectors of its dimension take part. Ties go to the smaller id. Rows of equal id stand for themselves; a
query leaves out all rows of its own id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import nonempty, prepare, written

TREES, DEPTH, SHARE, SEED = 48, 40, 0.012, 7
#: Rows of a block; bytes of a block of queries; rows of each dimension that planes are drawn from.
BLOCK_ROWS, QUERY_BYTES, SAMPLE = 16_384, 8 << 20, 512
_ONE = np.uint64(1)


class Planes:
    """Random hyperplanes for all trees, each halfway between two rows of a sample: they follow the rows' own directions."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        a, b = rng.integers(len(sample), size=(2, trees * depth))
        # where both rows are the same, any direction will do
        self.normals = (sample[a] - sample[b]).T + 1e-9 * rng.normal(size=(sample.shape[1], trees * depth))
        self.offsets = ((sample[a] + sample[b]).T / 2 * self.normals).sum(0)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """The hash strings of vectors, trees x rows, the first bit uppermost."""
        bits = (x @ self.normals > self.offsets).reshape(len(x), self.trees, self.depth)
        weights = _ONE << np.arange(self.depth - 1, -1, -1, dtype="u8")
        return (bits * weights).sum(2, dtype="u8").T.copy()


class Forest:
    def __init__(self, planes: Planes, ids: np.ndarray, x: np.ndarray, k: int = 10):
        self.planes, self.k = planes, k
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        _, first, inverse = np.unique(x, axis=0, return_index=True, return_inverse=True)
        self.x = x[first]
        by_vector = np.argsort(inverse.ravel(), kind="stable")
        cuts = np.searchsorted(inverse.ravel()[by_vector], np.arange(len(first) + 1))
        self.ids = [ids[by_vector[a : min(b, a + k + 1)]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if any(len(np.unique(i)) < len(i) for i in self.ids):  # rows of equal id: all rows of the vector stay
            self.ids = [ids[by_vector[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        strings = planes.strings(self.x)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def candidates(self, queries: np.ndarray, share: float) -> Iterator[np.ndarray]:
        """For each query the vectors that it gets by descending and ascending together."""
        strings, depth, n = self.planes.strings(queries), self.planes.depth, len(self.x)
        wanted = max(4 * self.k * self.planes.trees, ceil(share * n * self.planes.trees))
        low = np.zeros((depth + 1, self.planes.trees, len(queries)), "i8")
        high = np.full((depth + 1, self.planes.trees, len(queries)), n, "i8")
        for length in range(1, depth + 1):
            rest = (_ONE << np.uint64(depth - length)) - _ONE
            for t in range(self.planes.trees):
                low[length, t] = np.searchsorted(self.sorted[t], strings[t] & ~rest, "left")
                high[length, t] = np.searchsorted(self.sorted[t], strings[t] | rest, "right")
        enough = (high - low).sum(1) >= min(wanted, n * self.planes.trees)  # length x query; shorter prefixes hold more
        level = depth - np.argmax(enough[::-1], axis=0)
        for q, length in enumerate(level.tolist()):
            yield np.unique(np.concatenate([self.order[t, low[length, t, q] : high[length, t, q]] for t in range(self.planes.trees)]))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, share: float = SHARE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, ids, distances) of the k nearest candidates of each query."""
        for k in range(0, len(queries), 256):
            for own, q, c in zip(query_ids[k : k + 256].tolist(), queries[k : k + 256], self.candidates(queries[k : k + 256], share), strict=True):
                d = np.sqrt(((self.x[c] - q) ** 2).sum(1))
                if len(c) > self.k + 1:  # the own vector may be one of them
                    near = d <= np.partition(d, self.k + 1)[self.k + 1] if len(c) > self.k + 2 else np.ones(len(c), bool)
                    c, d = c[near], d[near]
                ids = np.concatenate([self.ids[i] for i in c]) if len(c) else np.zeros(0, "i8")
                dist = np.repeat(d, [len(self.ids[i]) for i in c])
                other = ids != own
                ids, dist = ids[other], dist[other]
                best = np.lexsort((ids, dist))[: self.k]
                yield own, ids[best], dist[best]


def usable(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = F.col("v")
    d = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return d.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(~bad).where(F.exists(v, lambda x: x != 0))


def _stacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def packed(rows: DataFrame, block_rows) -> DataFrame:
    """(dim, block, ids binary, x binary): rows (dim, vec_id, v) packed within their partitions, ``block_rows(dim)`` at most to a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[int, int] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, x = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
            count[dim] = 0
            name = int(np.uint64(xxhash.xxh3_64_intdigest(ids.tobytes())).view("i8"))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([name]), pa.array([ids.astype("<i8").tobytes()]), pa.array([x.astype("<f8").tobytes()])], names=["dim", "block", "ids", "x"])

        for b in nonempty(batches):
            dims = b.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == dim))
                ids, x, most = own.column(1).to_numpy(), _stacked(own.column(2)), block_rows(dim)
                while len(ids):
                    n = min(len(ids), most - count.get(dim, 0))
                    held.setdefault(dim, []).append((ids[:n], x[:n]))
                    count[dim] = count.get(dim, 0) + n
                    ids, x = ids[n:], x[n:]
                    if count[dim] == most:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return rows.mapInArrow(run, "dim int, block long, ids binary, x binary")


def nearest(embeddings: DataFrame, k: int = 10, every: int = 100, share: float = SHARE, trees: int = TREES, block_rows: int = BLOCK_ROWS, query_bytes: int = QUERY_BYTES, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows found nearest to each row whose id is divisible by ``every``."""
    spark = embeddings.sparkSession
    prepare(spark)
    rows = usable(embeddings, vec_id, embedding).select(F.size("v").alias("dim"), "vec_id", "v")
    dims = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    planes = {}
    for r in dims:
        sample = rows.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
        planes[r["dim"]] = Planes(np.array([x["v"] for x in sample]), trees)
    planes = spark.sparkContext.broadcast(planes)
    # rows are dealt evenly, so a partition is about one block
    blocks = written(packed(rows.repartition(max(1, ceil(sum(r["n"] for r in dims) / block_rows))), lambda dim: 2 * block_rows), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0).repartition(max(1, ceil(sum(r["q"] * r["dim"] * 8 for r in dims) / query_bytes)))
    queries = written(packed(asked, lambda dim: max(1, query_bytes // (8 * dim))), "queries")
    # every block meets every block of queries of its dimension: partitions with partitions, as the dimension alone is no key to shuffle by
    pairs = blocks.hint("shuffle_replicate_nl").join(queries.select(F.col("dim").alias("of"), F.col("ids").alias("query_ids"), F.col("x").alias("query_x")), F.col("dim") == F.col("of"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, forest = None, None
        for b in nonempty(batches):
            for dim, block, ids, x, _, query_ids, queries in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name != (dim, block):
                    name, forest = (dim, block), Forest(planes.value[dim], np.frombuffer(ids, "<i8"), np.frombuffer(x, "<f8").reshape(-1, dim), k)
                hits = list(forest.search(np.frombuffer(query_ids, "<i8"), np.frombuffer(queries, "<f8").reshape(-1, dim), share))
                counts = [len(i) for _, i, _ in hits]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _, _ in hits], counts)), pa.array(np.concatenate([i for _, i, _ in hits])), pa.array(np.concatenate([d for _, _, d in hits]))], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_sql(k: int = 10, every: int = 100) -> str:
    """Exact nearest neighbours in DuckDB SQL; the operator's are approximate, so tests measure recall against this."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) ** 2))) AS score FROM v q, v c WHERE q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM d QUALIFY rank <= {k}"""
