"""Intervals (0-based, half-open): bins, overlap queries, merging and the linear index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import MIN_SHIFT, bin_of, bins_touched
from ..plans.tables import checked_broadcast


def with_bin(features: DataFrame, beg: str = "beg", end: str = "end") -> DataFrame:
    return features.withColumn("bin", bin_of(F.col(beg), F.col(end)))


def overlaps(features: DataFrame, queries: DataFrame, seq: str = "seq", beg: str = "beg", end: str = "end") -> DataFrame:
    """Every pair of a query (columns q_*) and a feature that overlap on one sequence.

    A feature has one bin; a query looks in every bin that may hold a feature which overlaps it. That makes an equi-join on
    (seq, bin), with the overlap itself as the condition left over. ``queries`` has q_seq, q_beg and q_end.
    """
    probes = queries.withColumn("probe_bin", F.explode(bins_touched(F.col("q_beg"), F.col("q_end"))))
    joined = with_bin(features, beg, end).join(checked_broadcast(probes), (F.col(seq) == F.col("q_seq")) & (F.col("bin") == F.col("probe_bin")))
    return joined.where((F.col(beg) < F.col("q_end")) & (F.col(end) > F.col("q_beg"))).drop("probe_bin")


def buffered(beg: Column, end: Column, share: float = 0.25) -> tuple[Column, Column]:
    """An interval with a share of its length added on either side."""
    extra = F.floor((end - beg) * share)
    return F.greatest(beg - extra, F.lit(0)), end + extra


def merged(intervals: DataFrame, key: str, beg: str = "beg", end: str = "end", gap: int = 65_536) -> DataFrame:
    """(key, beg, end, n): intervals of a key joined where the next begins at most ``gap`` after the furthest end so far."""
    w = Window.partitionBy(key).orderBy(beg, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.select(key, beg, end, F.when(before.isNull() | (F.col(beg) > before + gap), 1).otherwise(0).alias("new_"))
    return marked.withColumn("run_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "run_").agg(F.min(beg).alias(beg), F.max(end).alias(end), F.count("*").alias("n")).drop("run_")


#: Features of a task. Spark joins small shuffled pieces up to as many tasks as there are cores, so what a task sorts would grow with the table.
TASK_ROWS = 1 << 18


def tasks_for(features: DataFrame) -> int:
    return max(1, -(-features.count() // TASK_ROWS))


def linear_index(features: DataFrame, seq: str = "seq", beg: str = "beg", end: str = "end", offset: str = "offset", tasks: int | None = None) -> DataFrame:
    """(seq, window, offset): for each 2^14 window up to the last one touched the first offset of a feature that touches it, or of the next window that has one."""
    touched = features.where(F.col(end) > 0).select(seq, offset, F.explode(F.sequence(F.shiftright(beg, MIN_SHIFT), F.shiftright(F.greatest(F.col(end) - 1, F.col(beg)), MIN_SHIFT))).alias("window"))
    firsts = touched.where("window >= 0").groupBy(seq, "window").agg(F.min(offset).alias(offset)).repartition(tasks or tasks_for(features), seq)
    w = Window.partitionBy(seq).orderBy("window")
    known = firsts.select(seq, "window", F.first(offset, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias(offset), F.lag("window", 1, -1).over(w).alias("before_"))
    return known.select(seq, F.explode(F.sequence(F.col("before_") + 1, F.col("window"))).alias("window"), offset)
