"""Neighbour joining and SNP distances against plain forms."""

import random
import re

import pytest
from kmerloom.operators import clusters, trees
from kmerloom.sources import tabular
from pyspark.sql import functions as F


def plain_tree(names, d):
    """Edges (parent, child, length) by the textbook's rounds; ties to the smallest numbers."""
    n = len(names)
    d = {(i, j): d[i][j] for i in range(n) for j in range(n)}
    alive, new, edges = list(range(n)), n, []
    while len(alive) > 2:
        r = {i: sum(d[i, j] for j in alive if j != i) for i in alive}
        _, i, j = min(((len(alive) - 2) * d[i, j] - r[i] - r[j], i, j) for i in alive for j in alive if i < j)
        left = d[i, j] / 2 + (r[i] - r[j]) / (2 * (len(alive) - 2))
        edges += [(new, i, max(left, 0)), (new, j, max(d[i, j] - left, 0))]
        for k in alive:
            if k not in (i, j):
                d[new, k] = d[k, new] = (d[i, k] + d[j, k] - d[i, j]) / 2
        alive = [k for k in alive if k not in (i, j)] + [new]
        new += 1
    if len(alive) == 2:
        edges.append((max(alive), min(alive), max(d[alive[0], alive[1]], 0)) if n > 2 else (0, 1, d[0, 1]))
    return edges


def table_of(spark, names, d):
    rows = [(names[i], names[j], float(d[i][j])) for i in range(len(names)) for j in range(i + 1, len(names))]
    return spark.createDataFrame(rows, "a string, b string, snp_distance double")


def paths(edges, n):
    near = {}
    for p, c, w in edges:
        near.setdefault(p, []).append((c, w))
        near.setdefault(c, []).append((p, w))
    out = {}
    for s in range(n):
        todo, seen = [(s, 0.0)], {s}
        while todo:
            at, far = todo.pop()
            if at < n:
                out[s, at] = far
            for x, w in near[at]:
                if x not in seen:
                    seen.add(x)
                    todo.append((x, far + w))
    return out


def test_joining_equals_the_textbook(spark):
    rng = random.Random(6)
    names = [f"s{i:02d}" for i in range(9)]
    d = [[0] * 9 for _ in names]
    for i in range(9):
        for j in range(i):
            d[i][j] = d[j][i] = rng.randint(1, 12)
    got = trees.neighbour_joining(table_of(spark, names, d).repartition(3)).collect()
    want = plain_tree(names, d)
    assert sorted((r["parent"], r["child"]) for r in got) == sorted((p, c) for p, c, _ in want)
    assert {(r["parent"], r["child"]): pytest.approx(r["length"]) for r in got} == {(p, c): w for p, c, w in want}
    assert {r["child"]: r["name"] for r in got if r["name"]} == dict(enumerate(names))


def test_tree_distances_come_back(spark):
    """Distances along a tree give that tree: path lengths are the distances, and so are those read from the Newick text."""
    rng = random.Random(3)
    n, edges, alive, new = 7, [], list(range(7)), 7
    while len(alive) > 1:
        i, j = rng.sample(alive, 2)
        edges += [(new, i, rng.randint(1, 9)), (new, j, rng.randint(1, 9))]
        alive, new = [k for k in alive if k not in (i, j)] + [new], new + 1
    full = paths(edges, n)
    names = ["a", "b b", "c:", "d'", "e", "f", "g"]
    tree = trees.neighbour_joining(table_of(spark, names, [[full[i, j] for j in range(n)] for i in range(n)]))
    got = paths([(r["parent"], r["child"], r["length"]) for r in tree.collect()], n)
    assert got == {k: pytest.approx(v) for k, v in full.items()}
    text = tabular.newick(tree)
    assert text.endswith(";") and text.count("(") == n - 2 and "'d'''" in text and "'b b'" in text
    assert sorted(round(float(x), 6) for x in re.findall(r":([\d.]+)", re.sub(r"'[^']*'", "", text))) == sorted(round(r["length"], 6) for r in tree.collect())


def test_small_and_bad_trees(spark):
    two = table_of(spark, ["x", "y"], [[0, 3], [3, 0]])
    assert [tuple(r) for r in trees.neighbour_joining(two).collect()] == [(0, 1, "y", 3.0)]
    empty = table_of(spark, ["x"], [[0]])
    assert trees.neighbour_joining(empty).count() == 0 and tabular.newick(trees.neighbour_joining(empty)) == ";"
    with pytest.raises(ValueError):
        trees.neighbour_joining(table_of(spark, ["x", "y", "z"], [[0, 1, 2], [1, 0, 3], [2, 3, 0]]).where("a = 'x'"))


def test_blocks_of_sequences(spark):
    """Distances by matrix products over many blocks equal those of the Column form; odd sequences, too."""
    rng = random.Random(2)
    rows = [(f"n{i:03d}", "".join(rng.choice("ACGTacgtUu-N?é") for _ in range(rng.randint(0, 60)))) for i in range(40)] + [("zz", None), ("yy", "")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "sample string, seq string, own int, one int")
    plain = df.select(F.col("sample").alias("a"), F.col("seq").alias("x")).crossJoin(df.select(F.col("sample").alias("b"), F.col("seq").alias("y"))).where("a < b")
    want = sorted(map(tuple, plain.select("a", "b", F.coalesce(clusters.snp_distance(F.col("x"), F.col("y")), F.lit(0)).alias("d")).collect()))
    for size in (1 << 20, 200):
        assert sorted(map(tuple, clusters.pairwise_snp(df, block_bytes=size).collect())) == want
    assert clusters.pairwise_snp(df.limit(0)).count() == 0
