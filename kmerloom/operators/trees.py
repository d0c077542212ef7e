"""Neighbour-joining trees from a table of distances.

The distances stay a table of pairs. Each round sums every node's distances, finds the pair with the smallest Q, replaces the two by a new node
and writes the table anew; the driver gets one row of each round, so what it holds is the tree. There are as many rounds as samples, as the
method joins one pair after another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import ranked, remove, written

#: Nodes up to which their sums (two numbers each) are broadcast.
MOST_SUMS = 400_000


def neighbour_joining(distances: DataFrame, a: str = "a", b: str = "b", value: str = "snp_distance") -> DataFrame:
    """(parent, child, name, length): the edges of the unrooted tree of (a, b, distance) of each pair of samples.

    Samples are numbered from 0 in order of name, inner nodes from there on in order of joining; name is null for inner nodes. Of pairs
    of equal Q the one with the smallest numbers is joined. Lengths are not below 0. The last inner node is the parent of three. Pairs may be given
    in either or both orders (the larger distance counts); it fails if one is missing. Two samples are one edge, from the first to the second. One sample or none has no edges.
    """
    spark = distances.sparkSession
    given = distances.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(value).cast("double").alias("d")).where("a <> b")
    names = given.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    kind = dict(names.dtypes)["name"]
    numbers = written(ranked(names, "id", "name").select("name", (F.col("id") - 1).alias("id")), "names")
    of = lambda c, as_: numbers.select(F.col("name").alias(c), F.col("id").alias(as_))
    pairs = given.join(of("a", "x"), "a").join(of("b", "y"), "b").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.max("d").alias("d"))
    now = written(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), "d")), "distances")
    total = m = numbers.count()
    if now.count() != total * (total - 1):
        raise ValueError("neighbour joining needs the distance of every pair of samples")
    edges: list[tuple] = []
    while m > 2:
        sums = now.groupBy("x").agg(F.sum("d").alias("r"))
        sums = F.broadcast(sums) if m <= MOST_SUMS else sums
        other = sums.select(F.col("x").alias("y"), F.col("r").alias("r_y"))
        q = (F.lit(m - 2.0) * F.col("d") - F.col("r") - F.col("r_y")).alias("q")
        best = now.where("x < y").join(sums, "x").join(other, "y").agg(F.min(F.struct(q, "x", "y", "d", "r", "r_y")).alias("b")).first()["b"]
        x, y, d, new = best["x"], best["y"], best["d"], total + len(edges) // 2
        left = d / 2 + (best["r"] - best["r_y"]) / (2 * (m - 2))
        edges += [(new, x, max(left, 0.0)), (new, y, max(d - left, 0.0))]
        rest = now.where(~F.col("x").isin(x, y) & ~F.col("y").isin(x, y))
        to_new = now.where(F.col("x").isin(x, y) & ~F.col("y").isin(x, y)).groupBy("y").agg(((F.sum("d") - d) / 2).alias("d")).withColumn("x", F.lit(new).cast("long"))
        then, now = now, written(rest.unionByName(to_new.select("x", "y", "d")).unionByName(to_new.select(F.col("y").alias("x"), F.col("x").alias("y"), "d")), "distances")
        remove(then)
        m -= 1
    if m == 2:
        x, y, d = now.where("x > y" if total > 2 else "x < y").first()
        edges.append((x, y, max(d, 0.0)))
    tree = spark.createDataFrame(edges, "parent long, child long, length double")
    named = tree.join(numbers, F.col("child") == F.col("id"), "left")
    return named.select("parent", "child", F.col("name").cast(kind).alias("name"), "length")
