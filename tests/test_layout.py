"""The fuzzy graph against numpy, the layout by the neighbours it keeps, the network by its gradient and its error."""

import numpy as np
import pytest
from kmerloom.operators import layout, vectors
from pyspark.sql import functions as F


def clusters(n=240, d=12, k=8, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(k, d)) * 3
    return np.arange(n), (centres[np.arange(n) % k] + r.normal(size=(n, d)) * 0.4).round(6)


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row], 1.0) for i, row in zip(ids, x, strict=True)], "vec_id long, v array<double>, x double").repartition(3)


def plain_graph(near):
    """Weights by bisection of each width on its own."""
    w = {}
    for i, rows in near.items():
        d = np.array([x for _, x in rows])
        rho = min([x for x in d if x > 0], default=0.0)
        lo, hi = 0.0, 1e9
        for _ in range(200):
            mid = (lo + hi) / 2
            if np.exp(-np.maximum(d - rho, 0) / mid).sum() > np.log2(len(d)):
                hi = mid
            else:
                lo = mid
        sigma = max(mid, 1e-3 * d.mean(), 1e-12)
        for (j, x) in rows:
            w[i, j] = float(np.exp(-max(x - rho, 0) / sigma))
    return {(a, b): w.get((a, b), 0) + w.get((b, a), 0) - w.get((a, b), 0) * w.get((b, a), 0) for a, b in {(min(p), max(p)) for p in w}}


def test_graph_equals_bisection(spark):
    ids, x = clusters(60)
    near = vectors.knn(table(spark, ids, x), "vec_id", "v", 7).select("id", "neighbour", (1 - F.col("score")).alias("distance"))
    near = near.where("not (id = 3 and distance > 0.02)")  # rows of different lengths
    by = {}
    for r in near.orderBy("id", "distance", "neighbour").collect():
        by.setdefault(r["id"], []).append((r["neighbour"], r["distance"]))
    got = {(r["a"], r["b"]): r["weight"] for r in layout.fuzzy_graph(near).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in plain_graph(by).items()}
    assert all(0 < v <= 1 + 1e-12 for v in got.values())
    equal = spark.createDataFrame([(1, 2, 0.0), (1, 3, 0.0), (2, 1, 0.0)], "id long, neighbour long, distance double")
    assert {(r["a"], r["b"]): r["weight"] for r in layout.fuzzy_graph(equal).collect()} == {(1, 2): 1.0, (1, 3): 1.0}
    assert layout.fuzzy_graph(equal.limit(0)).count() == 0


def test_curve_is_the_known_one():
    a, b = layout.curve(0.1)
    assert a == pytest.approx(1.577, abs=0.01) and b == pytest.approx(0.895, abs=0.01)


def test_layout_keeps_neighbours(spark):
    ids, x = clusters()
    df = table(spark, ids, x)
    places = layout.embed(df, "vec_id", "v", 15, rounds=25)
    high = vectors.knn(df, "vec_id", "v", 15)
    low = vectors.knn(places.select(F.col("id"), F.array("x", "y").alias("p")), "id", "p", 15, metric="euclidean")
    r = vectors.neighbourhood_preservation(high, low).first()
    assert places.count() == len(ids) and r["preservation"] > 4 * r["baseline"]


def plain_layout(links, places, rounds):
    """The rounds over numpy arrays, nodes in the order of their ids."""
    a, b = layout.curve()
    ids = sorted(places)
    x, n = np.array([places[i] for i in ids]), len(ids)
    at = {v: k for k, v in enumerate(ids)}
    i, j = (np.array([at[e[k]] for e in links for k in ends], int) for ends in ((0, 1), (1, 0)))
    w = np.repeat([e[2] for e in links], 2)
    total = np.maximum(np.bincount(i, w, n), 1e-300)[:, None]
    most = lambda m: np.clip(m, -layout.MOST, layout.MOST)
    for r in range(rounds):
        d = x[i] - x[j]
        d2 = (d * d).sum(1, keepdims=True)
        with np.errstate(all="ignore"):
            pull = np.where(d2 > 0, -2 * a * b * d2 ** (b - 1) / (1 + a * d2**b), 0.0)
        moves = np.zeros((n, 2))
        np.add.at(moves, i, w[:, None] * most(pull * d))
        pushes = np.zeros((n, 2))
        for s in range(layout.PUSHES):
            d = x - x[(np.arange(n) + 1 + (r * layout.PUSHES + s) * 7919 % (n - 1)) % n]
            d2 = (d * d).sum(1, keepdims=True)
            pushes += most(2 * b / ((0.001 + d2) * (1 + a * d2**b)) * d) / layout.PUSHES
        x = x + (1 - r / rounds) * (moves / total + layout.PUSH * pushes / layout.PUSHES)
    return dict(zip(ids, x, strict=True))


def test_layout_equals_plain_rounds(spark, monkeypatch):
    """Blocks of all sizes, a node that all are linked to, nodes without links, equal places; in pieces, and without broadcasts."""
    r = np.random.default_rng(3)
    places = {i * 3: tuple(r.normal(size=2).tolist()) for i in range(90)} | {1000: (1.0, 2.0), 1001: (1.0, 2.0)}
    ids = sorted(places)[:-5] + [1000, 1001]
    links = {(x, y): float(r.random()) for x, y in (sorted(map(int, r.choice(ids, 2, replace=False))) for _ in range(300))} | {(0, i): 0.5 for i in ids[1:]} | {(1000, 1001): 1.0}
    graph = spark.createDataFrame([(*e, w) for e, w in links.items()], "a long, b long, weight double").repartition(3)
    df = spark.createDataFrame([(i, *p) for i, p in places.items()], "id long, x double, y double").repartition(3)
    want = plain_layout([(*e, w) for e, w in links.items()], places, 5)
    for nodes, pieces in ((None, False), (7, False), (40, True), (91, True)):
        if pieces:
            for name, value in (("LINKS", 10), ("HELD_BYTES", 500), ("BROADCAST_BYTES", 0)):
                monkeypatch.setattr(layout, name, value)
        rows = layout.layout(graph, df, 5, block_nodes=nodes).collect()
        assert len(rows) == len(places)
        assert {i: (x, y) for i, x, y in rows} == {i: pytest.approx(tuple(p), abs=1e-9) for i, p in want.items()}
    two = spark.createDataFrame([(5, 0.0, 0.0), (9, 1.0, 0.0)], "id long, x double, y double")
    want = plain_layout([], {5: (0.0, 0.0), 9: (1.0, 0.0)}, 3)
    assert {i: (x, y) for i, x, y in layout.layout(graph.limit(0), two, 3).collect()} == {i: pytest.approx(tuple(p), abs=1e-12) for i, p in want.items()}


def test_rounds_shuffle_blocks(spark):
    """A round shuffles some rows for each block, not one for each node or link."""
    n = 5000
    graph = spark.range(n).select(F.col("id").alias("a"), ((F.col("id") * 7 + 1) % n).alias("b"), F.lit(0.5).alias("weight")).where("a < b")
    places = spark.range(n).select("id", F.sin("id").alias("x"), F.cos("id").alias("y"))

    def shuffled(rounds):
        sc = spark.sparkContext
        sc.setJobGroup(f"rounds-{rounds}", "")
        layout.layout(graph, places, rounds).write.format("noop").mode("overwrite").save()
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        store, jobs = sc._jsc.sc().statusStore(), sc.statusTracker()
        stages = {s for j in jobs.getJobIdsForGroup(f"rounds-{rounds}") for s in jobs.getJobInfo(j).stageIds}
        rows = 0
        for s in stages:
            try:
                rows += store.lastStageAttempt(s).shuffleWriteRecords()
            except Exception:  # a stage that was never run
                pass
        return rows

    few, more = shuffled(1), shuffled(5)
    sc = spark.sparkContext
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert few >= n and more - few < n


def test_odd_layouts(spark):
    ids, x = clusters(1)
    assert layout.layout(spark.createDataFrame([], "a long, b long, weight double"), layout.principal_places(table(spark, ids, x), "vec_id", "v")).count() == 1
    none = table(spark, ids, x).limit(0)
    assert layout.principal_places(none, "vec_id", "v").count() == 0
    with pytest.raises(ValueError):
        layout.train_projection(none, "v", "v")


def test_gradient_and_training(spark):
    r = np.random.default_rng(0)
    sizes = (3, 5, 4, 2)
    flat = r.normal(size=sum(a * b + b for a, b in zip(sizes[:-1], sizes[1:], strict=True)))
    x, t = r.normal(size=(7, 3)), r.normal(size=(7, 2))
    error = lambda f: layout.gradient(layout._unpacked(f, sizes), x, t)[-1]
    unit = np.eye(len(flat)) * 1e-6
    assert layout.gradient(layout._unpacked(flat, sizes), x, t)[:-1] == pytest.approx([(error(flat + e) - error(flat - e)) / 2e-6 for e in unit], abs=1e-5)
    ids, v = clusters(120, 6, 4)
    rows = [(int(i), row.tolist(), [float(np.tanh(row[0])), float(row[1] - row[2] / 2)]) for i, row in zip(ids, v, strict=True)]
    df = spark.createDataFrame([*rows, (999, None, None)], "vec_id long, v array<double>, t array<double>").repartition(3)
    layers, errors = layout.train_projection(df, "v", "t", hidden=(16, 8), steps=25, rate=0.03)
    assert errors[-1] < 0.2 * errors[0] and [w.shape for w, _ in layers] == [(16, 6), (8, 16), (2, 8)]
    got = vectors.mlp_project(df.where("v is not null"), "vec_id", "v", layers)
    fit = vectors.fit_measures(got.join(df, F.col("id") == F.col("vec_id")).select("projected", "t"), "projected", "t").first()
    assert fit["mse"] <= errors[-1] * 1.2


def test_nearest_of_odd_and_equal_vectors(spark, monkeypatch):
    """Equal to all cosines in double precision: copies, zeros, huge, tiny, infinite and missing components, blocks of several sizes; few pairs are computed one by one."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(260, 8)), r.normal(size=(3, 8)).repeat(30, 0), r.normal(size=(40, 8)) * 1e-7 + 1, np.zeros((4, 8)), r.normal(size=(3, 8)) * 1e200, r.normal(size=(3, 8)) * 1e-200])
    x = np.concatenate([x, [[np.inf, *x[0, 1:]], [np.nan, *x[1, 1:]]]])[r.permutation(len(x) + 2)]
    ids = r.permutation(len(x)) * 3
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(1))
        n = np.outer(norm, norm)
        score = np.round(np.where(n > 0, np.einsum("ik,jk->ij", x, x) / np.where(n > 0, n, 1), 0.0), 9)
    want = {}
    for i, own in zip(ids, score, strict=True):
        others = sorted((-np.inf if np.isnan(s) else -s, j) for s, j in zip(own, ids, strict=True) if i != j)[:7]
        want[int(i)] = [(int(j), s) for s, j in others]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, v array<double>")
    for how in ({}, {"block_rows": 50}):
        got = {}
        for row in vectors.knn(df, "vec_id", "v", 7, **how).orderBy("id", "rank").collect():
            got.setdefault(row["id"], []).append((row["neighbour"], -np.inf if np.isnan(row["score"]) else -row["score"]))
        assert {i: [j for j, _ in own] for i, own in got.items()} == {i: [j for j, _ in own] for i, own in want.items()}
        assert all(s == pytest.approx(t, abs=2e-9) for i, own in got.items() for (_, s), (_, t) in zip(own, want[i], strict=True))
    computed, exact = [], vectors.Nearest._exact
    monkeypatch.setattr(vectors.Nearest, "_exact", lambda self, at, column, other: (computed.append(len(at)), exact(self, at, column, other))[1])
    plain = r.normal(size=(4000, 16))
    nearest = vectors.Nearest(np.arange(1000).tobytes(), plain[:1000].tobytes(), 15)
    for lo in range(0, 4000, 1000):
        nearest.meet(np.arange(lo, lo + 1000).tobytes(), plain[lo : lo + 1000].tobytes())
    assert len(nearest.found()[0]) == 15_000 and sum(computed) < 0.02 * 4_000_000


def test_floats_travel_as_they_are(spark):
    """Vectors of floats have the neighbours that they have as doubles, in blocks that are half as large, whose queries go along once."""
    r = np.random.default_rng(8)
    x = r.normal(size=(700, 10)).astype("f4")
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<float>")
    for metric in ("cosine", "euclidean"):
        one, two = (sorted(map(tuple, vectors.knn(df.withColumn("v", F.col("v").cast(kind)), "vec_id", "v", 5, metric, block_rows=150).collect())) for kind in ("array<float>", "array<double>"))
        assert len(one) == 3500 and one == two
    assert len(vectors._packed(df.select(F.col("vec_id").alias("id"), "v").repartition(1), 700, "<f4").first()["x"]) == 700 * 10 * 4


def test_scores_that_reach_their_floor():
    r = np.random.default_rng(1)
    for columns in (1, 18, 256, 512, 530):
        score, floor = r.normal(size=(40, columns)).astype("f4"), r.normal(size=40).astype("f4") + 1
        floor[:3] = -np.inf
        at, column = vectors._at_least(score, floor)
        assert set(zip(at.tolist(), column.tolist(), strict=True)) == set(zip(*(c.tolist() for c in np.nonzero(score >= floor[:, None])), strict=True))
