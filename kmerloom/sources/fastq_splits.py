"""FASTQ files read in splits: one file is many tasks, and only records that cross the edge of a split are shuffled.

A record is four lines, blank lines between records do not count, so a line's part in its record hangs on all lines before it. The part
that the next line plays is one of four states, and what a split does to them (where it ends from each state and how many records it closes)
can be told without its beginning. A first pass finds that for every split, the splits of a file are strung together, and a second pass,
which knows its split's first state and record number, cuts the records. Compressed files are one split each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import remove, written

LINES = 4
#: Splits up to whose number what is known of them is broadcast, some 100 bytes each; beyond it lines are shuffled by their split.
MOST_BROADCAST_SPLITS = 100_000


def _runs(b: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Neighbouring rows of one split: (file, block, rows)."""
    files, starts = b.column(0).to_pylist(), b.column(1).to_pylist()
    at = 0
    while at < len(files):
        end = at + 1
        while end < len(files) and starts[end] == starts[at] and files[end] == files[at]:
            end += 1
        yield files[at], starts[at], b.slice(at, end - at)
        at = end


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, ends, closed) of each split: from each of the four states its last state and the records closed."""
    seen: dict[tuple[str, int], tuple[list[int], list[int]]] = {}
    for b in batches:
        for file, block, rows in _runs(b):
            ends, closed = seen.setdefault((file, block), (list(range(LINES)), [0] * LINES))
            blank = pc.equal(pc.binary_length(pc.utf8_rtrim(rows.column(2), "\r")), 0)
            lines = blank.to_pylist() if pc.any(blank).as_py() else None
            for s in range(LINES):
                if lines is None:
                    at = ends[s] + rows.num_rows
                    closed[s], ends[s] = closed[s] + at // LINES, at % LINES
                    continue
                for is_blank in lines:
                    if ends[s] or not is_blank:
                        ends[s] += 1
                    if ends[s] == LINES:
                        closed[s], ends[s] = closed[s] + 1, 0
    if seen:
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int64()), pa.array([seen[k][0] for k in keys], pa.list_(pa.int64())), pa.array([seen[k][1] for k in keys], pa.list_(pa.int64()))], names=["file", "block", "ends", "closed"])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, ord, part, l0 to l3): whole records with part null, and single lines of records that cross an edge with their part."""
    names = ["file", "ord", "part", "l0", "l1", "l2", "l3"]
    now, part, ord_, held = None, 0, 0, []

    def loose() -> list[tuple]:
        return [(now[0], ord_, p, line, None, None, None) for p, line in held]

    for b in batches:
        out: list[tuple] = []
        for file, block, rows in _runs(b):
            if now != (file, block):
                out += loose()
                now, part, ord_, held = (file, block), rows.column(3)[0].as_py(), rows.column(4)[0].as_py(), []
            for line in rows.column(2).to_pylist():
                line = line.rstrip("\r")
                if not part and not line:
                    continue
                held.append((part, line))
                part += 1
                if part == LINES:
                    out += [(file, ord_, None, *(x for _, x in held))] if len(held) == LINES else loose()
                    part, ord_, held = 0, ord_ + 1, []
        if out:
            yield _table(out, names)
    if held:
        yield _table(loose(), names)


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int32(), *[pa.string()] * LINES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, header, seq, qual) of FASTQ files, ``ord`` a record's number in its file, from 0.

    A header without '@', a third line without '+', unequal lengths and a partial last record fail. Empty reads are kept; empty files have no records.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    splits = written(text.mapInArrow(_effects, "file string, block long, ends array<long>, closed array<long>"), "splits")
    # a file's splits in their order, a row of numbers each; the state is carried from one to the next
    in_order = F.array_sort(F.collect_list(F.struct("block", "ends", "closed")))
    first = F.struct(F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("ord"), F.array().cast("array<struct<block:bigint,part:bigint,ord:bigint>>").alias("known"))
    step = lambda a, s: F.struct(F.get(s["ends"], a["part"].cast("int")).alias("part"), (a["ord"] + F.get(s["closed"], a["part"].cast("int"))).alias("ord"), F.array_append(a["known"], F.struct(s["block"].alias("block"), a["part"].alias("part"), a["ord"].alias("ord"))).alias("known"))
    known = splits.groupBy("file").agg(in_order.alias("s")).select("file", F.explode(F.aggregate("s", first, step)["known"]).alias("k")).select("file", "k.block", "k.part", "k.ord")
    known = written(known, "split-starts")
    few = known.count() <= MOST_BROADCAST_SPLITS
    remove(splits)
    if few:
        joined = text.join(F.broadcast(known), ["file", "block"])
    else:
        numbered = text.withColumn("at", F.monotonically_increasing_id())
        joined = numbered.join(known, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "at")
    cut = joined.select("file", "block", "value", "part", "ord").mapInArrow(_lines, "file string, ord long, part int, l0 string, l1 string, l2 string, l3 string")
    whole = cut.where("part is null").select("file", "ord", "l0", "l1", "l2", "l3")
    line = lambda p: F.max(F.when(F.col("part") == p, F.col("l0"))).alias(f"l{p}")
    crossing = cut.where("part is not null").groupBy("file", "ord").agg(*(line(p) for p in range(LINES)))
    return _checked(whole.unionByName(crossing))


def _checked(records: DataFrame) -> DataFrame:
    """(file, ord, header, seq, qual) of records given as their four lines; what is no record fails."""
    bad = (
        F.when(F.col("l0").isNull() | F.col("l1").isNull() | F.col("l2").isNull() | F.col("l3").isNull(), F.lit("FASTQ: a partial record"))
        .when(~F.col("l0").startswith("@"), F.lit("FASTQ: a header without @"))
        .when(~F.col("l2").startswith("+"), F.lit("FASTQ: a third line without +"))
        .when(F.length("l1") != F.length("l3"), F.lit("FASTQ: sequence and quality of unequal length"))
    )
    header = F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(F.col("l0").substr(F.lit(2), F.lit(1 << 30)))
    return records.select("file", "ord", header.alias("header"), F.col("l1").alias("seq"), F.col("l3").alias("qual"))
