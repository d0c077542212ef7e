"""Layouts of vectors in the plane: the fuzzy graph of neighbours, its layout in rounds, and a network that learns to place new vectors.

The graph is joins and sums of DataFrames, a round of the layout joins blocks of nodes; a node with very many neighbours is summed up in parts. What the driver gets has the
size of one vector squared (principal axes) or of the network, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import BROADCAST_BYTES, checked_broadcast, importable, ranked, remove, written
from .vectors import knn

#: Steps of the search for a neighbourhood's width, its smallest width as a share of the mean distance; other nodes that push a node in a round, how hard, and the largest move.
WIDTH_STEPS, LEAST_WIDTH, PUSHES, PUSH, MOST = 64, 1e-3, 10, 5.0, 4.0
#: Nodes of a block of a layout, at least, and its blocks, at most; links in a row, and bytes of moves that a task holds; rows that are trained on together.
LEAST_NODES, MOST_BLOCKS, LINKS, HELD_BYTES, PACKED = 1 << 15, 32, 1 << 20, 64 << 20, 2048


# --- the graph ---------------------------------------------------------------------------------------------------------


def widths(distance: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rho and sigma of each row of distances: the smallest one above 0, and the width with which the weights sum to log2 of their number."""
    n = held.sum(1)
    positive = np.where(held & (distance > 0), distance, np.inf)
    rho = positive.min(1, initial=np.inf)
    rho[~np.isfinite(rho)] = 0.0
    target = np.log2(np.maximum(n, 1))
    lo, hi, mid = np.zeros(len(n)), np.full(len(n), np.inf), np.ones(len(n))
    over = np.where(held, np.maximum(distance - rho[:, None], 0), np.inf)
    for _ in range(WIDTH_STEPS):
        total = np.exp(-over / mid[:, None]).sum(1)
        above = total > target
        hi, lo = np.where(above, mid, hi), np.where(above, lo, mid)
        mid = np.where(np.isinf(hi), mid * 2, (lo + hi) / 2)
    mean = np.where(held, distance, 0).sum(1) / np.maximum(n, 1)
    return rho, np.maximum(mid, np.maximum(LEAST_WIDTH * mean, 1e-12))


def fuzzy_graph(near: DataFrame) -> DataFrame:
    """(a, b, weight) of neighbours (id, neighbour, distance), a < b: how surely the two are neighbours for either, x + y - x y of both weights."""
    own = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))).alias("n_")).select("id", F.col("n_.neighbour").alias("to"), F.col("n_.distance").alias("far"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sizes = np.diff(b.column(1).offsets.to_numpy())
            held = np.arange(sizes.max())[None] < sizes[:, None]
            distance = np.zeros(held.shape)
            distance[held] = b.column(2).flatten().to_numpy(zero_copy_only=False)
            rho, sigma = widths(distance, held)
            weight = np.exp(-np.maximum(distance - rho[:, None], 0) / sigma[:, None])[held]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), sizes)), b.column(1).flatten(), pa.array(weight)], names=["id", "neighbour", "w"])

    weights = own.mapInArrow(run, "id long, neighbour long, w double")
    pairs = weights.groupBy(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b"))
    both = F.when(F.count("*") > 1, F.min("w") * F.max("w")).otherwise(F.lit(0.0))
    return pairs.agg((F.sum("w") - both).alias("weight"))


# --- the layout --------------------------------------------------------------------------------------------------------


def curve(min_dist: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) with which 1 / (1 + a x^2b) is closest to 1 up to ``min_dist`` and exp(-(x - min_dist) / spread) from there on, by damped least squares."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p, damping = np.array([1.0, 1.0]), 1e-2
    cost = np.inf
    for _ in range(500):
        power = x ** (2 * p[1])
        f = 1 / (1 + p[0] * power)
        r = y - f
        now = float(r @ r)
        jacobian = np.stack([-power * f**2, -p[0] * power * 2 * np.log(x) * f**2], 1)
        step = np.linalg.solve(jacobian.T @ jacobian + damping * np.eye(2), jacobian.T @ r)
        trial = np.maximum(p + step, 1e-3)
        r2 = y - 1 / (1 + trial[0] * x ** (2 * trial[1]))
        if float(r2 @ r2) < now:
            p, damping = trial, damping / 3
            if abs(cost - now) < 1e-15:
                break
            cost = now
        else:
            damping *= 4
    return float(p[0]), float(p[1])


def _sums(rows: DataFrame, sums, size: int, parts: int = 32) -> np.ndarray:
    """The sum of ``sums(batch)``, vectors of ``size`` numbers, over all Arrow batches: by task, then by ``parts`` tasks, whose sums the driver adds."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += sums(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["v"])

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for v in b.column(0):
                total += np.frombuffer(v.as_buffer(), "f8")
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["v"])

    return sum((np.frombuffer(r[0], "f8") for r in rows.mapInArrow(first, "v binary").repartition(parts).mapInArrow(then, "v binary").collect()), np.zeros(size))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(column), -1)


def principal_places(vectors: DataFrame, id_col: str, vec: str, width: float = 5.0) -> DataFrame:
    """(id, x, y): vectors on their two principal axes, the first of deviation ``width``. Vectors are of one length, without nulls."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).where("v is not null")
    one = rows.select(F.size("v")).first()
    d = one[0] if one else 0

    def moments(b: pa.RecordBatch) -> np.ndarray:
        v = _rows(b.column(0))
        return np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()])

    total = _sums(rows.select("v"), moments, 1 + d + d * d)
    n = max(total[0], 1.0)
    mean = total[1 : d + 1] / n
    values, axes = np.linalg.eigh(total[d + 1 :].reshape(d, d) / n - np.outer(mean, mean)) if d else (np.zeros(0), np.zeros((0, 0)))
    top = axes[:, ::-1][:, :2] if d > 1 else np.eye(max(d, 1), 2)
    # an axis has no direction of its own: the larger part points up
    top = top * np.where(np.abs(top).max(0) == top.max(0), 1.0, -1.0) if d else top
    scale = width / np.sqrt(max(values[-1], 1e-12)) if d else 1.0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = (_rows(b.column(1)) - mean) @ top * scale
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at[:, 0].copy()), pa.array(at[:, 1].copy())], names=["id", "x", "y"])

    return rows.mapInArrow(place, "id long, x double, y double")


def _block_links(links: DataFrame, size: int, tasks: int) -> DataFrame:
    """(p, q, i, j, w, v): links (i, j, w, v) of nodes of block p to nodes of block q, at most ``LINKS`` to a row; i and j count within their blocks.

    Links are sorted by ranges, so those of two blocks that have very many are dealt out like others.
    """
    names = ["p", "q", "i", "j", "w", "v"]
    at = links.select(F.floor(F.col("i") / size).cast("int").alias("p"), F.floor(F.col("j") / size).cast("int").alias("q"), (F.col("i") % size).cast("int").alias("i"), (F.col("j") % size).cast("int").alias("j"), "w", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        of, n = None, 0
        for b in batches:
            c = [x.to_numpy() for x in b.columns]
            cuts = [0, *(np.flatnonzero((np.diff(c[0]) != 0) | (np.diff(c[1]) != 0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if n and (of != (c[0][lo], c[1][lo]) or n + hi - lo > LINKS):
                    yield packed(of, held)
                    held, n = [], 0
                of, n = (c[0][lo], c[1][lo]), n + hi - lo
                held.append([x[lo:hi] for x in c[2:]])
        if n:
            yield packed(of, held)

    def packed(of: tuple[int, int], held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [pa.array([np.concatenate(x).astype(kind).tobytes()]) for x, kind in zip(zip(*held, strict=True), ("<i4", "<i4", "<f8", "<f8"), strict=True)]
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in of), *columns], names=names)

    return at.repartitionByRange(tasks, *names[:4]).sortWithinPartitions(*names[:4]).mapInArrow(pack, "p int, q int, i binary, j binary, w binary, v binary")


def _block_places(numbered: DataFrame, size: int, parts: int) -> DataFrame:
    """(block, ids, at): ids and places of (no, id, x, y), ``size`` nodes to a block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            block, ids, x, y = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(block[:1], pa.int32()), pa.array([ids.astype("<i8").tobytes()]), pa.array([np.stack([x, y]).astype("<f8").tobytes()])], names=["block", "ids", "at"])

    # one block to a partition
    blocks = numbered.select(F.floor(F.col("no") / size).cast("int").alias("block"), "id", "x", "y", "no").repartitionById(parts, "block").sortWithinPartitions("no").drop("no")
    return blocks.mapInArrow(pack, "block int, ids binary, at binary")


def forces(p: int, q: int, own: np.ndarray, other: np.ndarray, links: tuple[np.ndarray, ...] | None, n: int, size: int, offsets: list[int], a: float, b: float) -> Iterator[tuple[int, np.ndarray]]:
    """(block, moves) of the nodes of blocks ``p`` and ``q``, of places (2, nodes): by their ``links`` (i, j, w, v), or if None by the pushes of nodes ``offsets`` further, of ``n``."""
    if links is not None:
        i, j, w, v = links
        d = own[:, i] - other[:, j]
        d2 = (d * d).sum(0)
        d2 = np.where(d2 > 0, d2, 1.0)  # equal places: d is 0
        power = d2**b
        pull = np.clip(-2 * a * b * power / (d2 * (1 + a * power)) * d, -MOST, MOST)
        yield p, np.stack([np.bincount(i, w * c, own.shape[1]) for c in pull])
        yield q, np.stack([np.bincount(j, -v * c, other.shape[1]) for c in pull])
        return
    for mine, theirs, x, y in ((p, q, own, other), (q, p, other, own))[: 1 + (p != q)]:
        moves = None
        for shift in (s for o in offsets for s in (o, o - n)):
            # node k of mine meets node k + ahead of theirs
            ahead = (mine - theirs) * size + shift
            lo, hi = max(0, -ahead), min(x.shape[1], y.shape[1] - ahead)
            if lo < hi:
                d = x[:, lo:hi] - y[:, lo + ahead : hi + ahead]
                d2 = (d * d).sum(0)
                moves = np.zeros(x.shape) if moves is None else moves
                moves[:, lo:hi] += np.clip(2 * b / ((0.001 + d2) * (1 + a * d2**b)) * d, -MOST, MOST) * (PUSH / PUSHES**2)
        if moves is not None:
            yield mine, moves


def layout(graph: DataFrame, places: DataFrame, rounds: int = 40, min_dist: float = 0.1, block_nodes: int | None = None) -> DataFrame:
    """(id, x, y): nodes moved so that linked ones (a, b, weight) come together and others stay apart, from ``places`` (id, x, y).

    In a round each node moves by the weighted mean of its links' pull, and is pushed by ``PUSHES`` other nodes, whose distance in number changes
    from round to round, so every node is met and nothing is drawn at random. Moves get smaller from round to round. Nodes without links are only pushed.

    Nodes are dealt in at most ``MOST_BLOCKS`` blocks, unless they are few; links are grouped by two blocks once. A round joins blocks, not nodes: what it
    shuffles grows as the nodes, and a task holds two blocks, their links in pieces, and the moves of some blocks.
    """
    a, b = curve(min_dist)
    spark = places.sparkSession
    importable(spark)
    numbered = written(ranked(places, "no", "id").select((F.col("no") - 1).alias("no"), "id", "x", "y"), "places")
    n = numbered.count()
    if n < 2:
        return numbered.select("id", "x", "y")
    size = block_nodes or max(LEAST_NODES, -(-n // MOST_BLOCKS))
    parts, tasks = -(-n // size), spark.sparkContext.defaultParallelism
    # a row is of megabytes, so only few go into an Arrow batch
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)
    number = checked_broadcast(numbered.select("id", "no"))
    links = graph.join(number.select(F.col("id").alias("a"), F.col("no").alias("i")), "a").join(number.select(F.col("id").alias("b"), F.col("no").alias("j")), "b").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "weight")
    links = written(links, "links")
    sums = checked_broadcast(links.select(F.explode(F.array("i", "j")).alias("no"), "weight").groupBy("no").agg(F.sum("weight").alias("w_")))
    for c, w in (("i", "w"), ("j", "v")):
        links = links.join(sums.select(F.col("no").alias(c), F.col("w_").alias(w)), c)
    links = links.select("i", "j", (F.col("weight") / F.col("w")).alias("w"), (F.col("weight") / F.col("v")).alias("v"))
    none = F.lit(None).cast("binary")
    pairs = spark.range(parts).select(F.col("id").cast("int").alias("p")).join(spark.range(parts).select(F.col("id").cast("int").alias("q"))).where("p <= q").select("p", "q", *(none.alias(c) for c in "ijwv"))
    pairs = written(_block_links(links, size, tasks).union(pairs).repartition(tasks), "pairs")
    now = written(_block_places(numbered, size, parts), "blocks")
    ids = now.select("block", "ids")
    now = now.select("block", "at")
    small = n * 16 <= BROADCAST_BYTES
    for r in range(rounds):
        step = 1.0 - r / rounds
        offsets = [1 + (r * PUSHES + s) * 7919 % (n - 1) for s in range(PUSHES)]

        def moved(batches: Iterator[pa.RecordBatch], offsets: list[int] = offsets) -> Iterator[pa.RecordBatch]:
            part, held = TaskContext.get().partitionId() << 32, {}
            for rows in batches:
                for p, q, *links, own, other in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    at = (np.frombuffer(c, "<f8").reshape(2, -1) for c in (own, other))
                    for block, moves in forces(p, q, *at, None if links[0] is None else tuple(map(np.frombuffer, links, ("<i4", "<i4", "<f8", "<f8"))), n, size, offsets, a, b):
                        held[block] = held[block] + moves if block in held else moves
                    if sum(m.nbytes for m in held.values()) > HELD_BYTES:
                        yield from given(held, part)
                        part, held = part + 1, {}
            yield from given(held, part)

        def given(held: dict[int, np.ndarray], part: int) -> Iterator[pa.RecordBatch]:
            for block, moves in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part]), pa.array([moves.tobytes()])], names=["block", "part", "at"])

        def summed(batches: Iterator[pa.RecordBatch], step: float = step) -> Iterator[pa.RecordBatch]:
            block, at, moves = None, None, 0.0
            for rows in batches:
                for of, part, raw in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    if part < 0:  # a block's places come first
                        if block is not None:
                            yield blocked(block, at + step * moves)
                        block, at, moves = of, np.frombuffer(raw, "<f8"), 0.0
                    else:
                        moves = moves + np.frombuffer(raw, "<f8")
            if block is not None:
                yield blocked(block, at + step * moves)

        def blocked(block: int, at: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([at.tobytes()])], names=["block", "at"])

        side = F.broadcast(now) if small else now
        both = pairs.join(side.select(F.col("block").alias("p"), F.col("at").alias("own")), "p").join(side.select(F.col("block").alias("q"), F.col("at").alias("other")), "q")
        moves = both.select("p", "q", "i", "j", "w", "v", "own", "other").mapInArrow(moved, "block int, part long, at binary")
        # sums in one order, so a layout can be repeated
        rows = now.select("block", F.lit(-1).cast("long").alias("part"), "at").union(moves).repartitionById(parts, "block").sortWithinPartitions("block", "part")
        then, now = now, written(rows.mapInArrow(summed, "block int, at binary"), "blocks")
        if r:
            remove(then)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for raw, at in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                own = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(own), *map(pa.array, np.frombuffer(at, "<f8").reshape(2, -1))], names=["id", "x", "y"])

    return ids.join(now, "block").select("ids", "at").mapInArrow(unpack, "id long, x double, y double")


def embed(vectors: DataFrame, id_col: str, vec: str, k: int = 15, rounds: int = 40, min_dist: float = 0.1) -> DataFrame:
    """(id, x, y): the layout of the fuzzy graph of each vector's k nearest others by cosine, from its principal axes. Null vectors are left out."""
    near = knn(vectors, id_col, vec, k).select("id", "neighbour", (1 - F.col("score")).alias("distance"))
    return layout(written(fuzzy_graph(near), "graph"), principal_places(vectors, id_col, vec), rounds, min_dist)


# --- a network that learns a layout ----------------------------------------------------------------------------------------


def _unpacked(flat: np.ndarray, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes[:-1], sizes[1:], strict=True):
        out.append((flat[at : at + a * b].reshape(b, a), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def gradient(layers: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, target: np.ndarray, slope: float = 0.1) -> np.ndarray:
    """The gradient of the summed squared error of a leaky network, in the order of its layers' weights and offsets, and that error at the end."""
    inputs, value = [], x
    for i, (w, c) in enumerate(layers):
        inputs.append(value)
        value = value @ w.T + c
        if i < len(layers) - 1:
            value = np.where(value > 0, value, slope * value)
    error = value - target
    back, out = 2 * error, []
    for i in range(len(layers) - 1, -1, -1):
        out[:0] = [(back.T @ inputs[i]).ravel(), back.sum(0)]
        if i:
            back = (back @ layers[i][0]) * np.where(inputs[i] > 0, 1.0, slope)
    return np.concatenate([*out, [float((error**2).sum())]])


def train_projection(rows: DataFrame, vec: str, target: str, hidden: tuple[int, ...] = (256, 128), steps: int = 150, rate: float = 0.01, seed: int = 42) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[float]]:
    """Layers for ``vectors.mlp_project`` that take ``vec`` to ``target``, and the mean squared error before each step.

    Every step sums the gradients of all rows by task; the driver holds the network alone. Steps are Adam's.
    """
    spark = rows.sparkSession
    importable(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, PACKED):
                part = b.slice(lo, PACKED)
                yield pa.RecordBatch.from_arrays([*(pa.array([_rows(c).astype("<f8").tobytes()]) for c in part.columns), pa.array([part.num_rows])], names=["v", "t", "n"])

    # a row is of megabytes, so only few go into an Arrow batch
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)
    whole = rows.select(F.col(vec).cast("array<double>").alias("v"), F.col(target).cast("array<double>").alias("t")).where("v is not null and t is not null")
    # packed once, as each step reads all of them; one task to a core
    held = written(whole.mapInArrow(pack, "v binary, t binary, n long").repartition(spark.sparkContext.defaultParallelism), "training")
    one = held.select((F.octet_length("v") / 8 / F.col("n")).cast("int"), (F.octet_length("t") / 8 / F.col("n")).cast("int")).first()
    if one is None:
        raise ValueError("there is nothing to learn from")
    sizes, n = (one[0], *hidden, one[1]), held.agg(F.sum("n")).first()[0] * one[1]
    rng = np.random.default_rng(seed)
    flat = np.concatenate([x for a, b in zip(sizes[:-1], sizes[1:], strict=True) for x in (rng.normal(0, (2 / a) ** 0.5, a * b), np.zeros(b))])
    mean, spread, errors = np.zeros(len(flat)), np.zeros(len(flat)), []
    for step in range(1, steps + 1):
        layers = _unpacked(flat, sizes)

        def summed(b: pa.RecordBatch, layers: list[tuple[np.ndarray, np.ndarray]] = layers) -> np.ndarray:
            return sum(gradient(layers, *(np.frombuffer(x, "<f8").reshape(k, -1) for x in (v, t))) for v, t, k in zip(*(c.to_pylist() for c in b.columns), strict=True))

        total = _sums(held, summed, len(flat) + 1, parts=4)
        g = total[:-1] / n
        errors.append(total[-1] / n)
        mean, spread = 0.9 * mean + 0.1 * g, 0.999 * spread + 0.001 * g * g
        decay = 1 - 0.9 * (step - 1) / steps
        flat = flat - decay * rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    return _unpacked(flat, sizes), errors
