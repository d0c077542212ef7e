"""Connected components of an edge table by alternating star rounds in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import remove, written

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of an edge, root being the smallest node reachable.

    Each round sends every node's smallest neighbour to all its larger neighbours (large star) and then links a
    node's smaller neighbours to the smallest of them (small star), so the number of rounds grows with the
    logarithm of the largest component. Both steps take minima before they shuffle, hold one row for each edge and
    gather no neighbour lists. Rounds end when a round changes nothing; each round's edges are a written table. So are the minima:
    joined as a table, Spark can split the rows of a node with very many neighbours.
    """
    now = written(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct(), "edges")
    fingerprint = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = written(both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m")), "least")
        # large star: each node's larger neighbours go to its smallest neighbour
        large = written(both.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct(), "large")
        remove(least)
        # small star: a node and its smaller neighbours go to the smallest of them
        least = written(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        joined = large.join(least, "hi")
        small = joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
        then, now = now, written(small, "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        for used in (then, large, least):
            remove(used)
        if state == fingerprint:
            break
        fingerprint = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
