"""Streams of reads: chunks with records that cross them, and filters that keep running counts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RECORD = "file string, ord long, header string, seq string"


def fasta_from_chunks(chunks: DataFrame, file: str = "file", number: str = "chunk", text: str = "text", last: str = "last") -> DataFrame:
    """A stream (file, chunk number from 0, text, whether it is the file's last) as records of FASTA.

    What a chunk leaves unfinished is kept as the file's state until its next chunk; chunks that arrive early wait
    there too. The state of a file is its open record and early chunks.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carry, expected, ord_, early = state.get if state.exists else ("", 0, 0, "[]")
        waiting: dict[int, tuple[str, bool]] = {int(n): (t, bool(e)) for n, t, e in json.loads(early)}
        for f in frames:
            waiting.update({int(n): (t or "", bool(e)) for n, t, e in zip(f[number], f[text], f[last], strict=True)})
        out, done = [], False
        while expected in waiting:
            more, done = waiting.pop(expected)
            carry, expected = carry + more.replace("\r", ""), expected + 1
            pieces = ("\n" + carry).split("\n>")
            complete, carry = (pieces[1:], "") if done else (pieces[1:-1], (">" + pieces[-1]) if len(pieces) > 1 else pieces[0].removeprefix("\n"))
            for record in complete:
                header, _, body = record.partition("\n")
                out.append((key[0], ord_, header, body.replace("\n", "")))
                ord_ += 1
        if done:
            state.remove()
        else:
            state.update((carry, expected, ord_, json.dumps([(n, t, e) for n, (t, e) in waiting.items()])))
        if out:
            yield pd.DataFrame(out, columns=["file", "ord", "header", "seq"])

    return chunks.groupBy(file).applyInPandasWithState(step, RECORD, "carry string, expected long, ord long, early string", "append", GroupStateTimeout.NoTimeout)


def running_counts(verdicts: DataFrame, length: str = "bases", kept: str = "kept", group: str | None = None) -> DataFrame:
    """(reads_in, reads_out, bases_in, bases_out) so far, of a stream or a table of filter verdicts."""
    by = verdicts.groupBy(group) if group else verdicts.groupBy()
    return by.agg(F.count("*").alias("reads_in"), F.count_if(kept).alias("reads_out"), F.sum(length).alias("bases_in"), F.coalesce(F.sum(F.when(F.col(kept), F.col(length))), F.lit(0)).alias("bases_out"))


def depleted_stream_counts(spark: SparkSession, path: str, index: DataFrame, id_col: str, seq: str, group: str, k: int, w: int, files_a_batch: int = 1000) -> DataFrame:
    """(group, reads_in, reads_out, bases_in, bases_out) of all parquet files of a folder (or of one file), read as a stream.

    Each batch is filtered against the index and adds a table of partial sums, which ``mode('overwrite')`` under the batch's
    own number makes safe to repeat; the sums are added up once the stream has read what there is.
    """
    from ..operators.kmers import contained
    from ..plans.tables import new_path

    out, checkpoint = new_path(spark, "stream"), new_path(spark, "stream-state")
    known = index.select("kmer").distinct()

    def batch(rows: DataFrame, number: int) -> None:
        verdicts = contained(rows, known, id_col, seq, k, w)
        joined = rows.select(id_col, group, F.length(seq).cast("long").alias("bases")).join(verdicts.select(id_col, "kept"), id_col)
        running_counts(joined, group=group).write.mode("overwrite").parquet(f"{out}/batch={number}")

    parquet_stream(spark, path, files_a_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    sums = spark.read.parquet(out)
    return sums.groupBy(group).agg(*(F.sum(c).alias(c) for c in ("reads_in", "reads_out", "bases_in", "bases_out")))


def parquet_stream(spark: SparkSession, path: str, files_a_batch: int) -> DataFrame:
    """All parquet files of a folder, or one file, as a stream."""
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    return stream.parquet(path if _is_folder(spark, path) else f"{folder}/{name[:-1]}[{name[-1]}]")


#: Places that the runs of a stream of reads go to, whose letters are not known beforehand; tasks take several.
STREAM_PLACES = 4096


def chunked_kmer_counts(spark: SparkSession, path: str, seq: str, k: int, qual: str | None = None, least_quality: int = 20, mode: int = 2, files_a_chunk: int = 1000, least: int = 1) -> DataFrame:
    """(kmer, n), ``n`` of ``least`` or more, of all reads in the parquet files of a folder (or in one file), taken in as a stream, chunk of files after chunk.

    Each chunk's runs of k-mers are appended as a part, some bytes a letter, and counted once at the end. If there are qualities, its k-mers of enough quality are
    counted on their own instead, and the parts added up. A chunk that is repeated after a failure takes the place of its part.
    """
    from ..operators import runs
    from ..operators.kmers import quality_kmers
    from ..plans.tables import new_path, spread
    from ..sources.appended import append_part, read_parts

    folder, checkpoint = new_path(spark, "kmer-parts"), new_path(spark, "stream-state")

    def chunk(rows: DataFrame, number: int) -> None:
        if qual is None:
            append_part(runs.packed_runs(spread(rows.select(seq)), seq, k, STREAM_PLACES), folder, number)
        else:
            append_part(quality_kmers(rows.select(seq, qual), seq, qual, k, least_quality, mode).groupBy("kmer").agg(F.count("*").alias("n")), folder, number)

    parquet_stream(spark, path, files_a_chunk).writeStream.foreachBatch(chunk).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if qual is not None:
        return read_parts(spark, folder, "kmer string, n long").groupBy("kmer").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    parts = read_parts(spark, folder, "place int, by int, runs int, size long, data binary")
    tasks = min(STREAM_PLACES, runs.tasks_for(parts, int(parts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) // 4))
    dealt = parts.withColumn("place", F.col("place") % tasks).repartitionById(tasks, "place")
    return runs.gathered(dealt, k, least=least).select("kmer", "n")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
