"""What the operators of this subpackage share: table access, scratch tables and Arrow plumbing."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import new_path, remove, shared_dir, table, written

__all__ = ["BATCH_ROWS", "filtered", "fold", "free_name", "held_out", "new_path", "nonempty", "prepare", "remove", "shared_dir", "table", "texts_of", "written"]

#: Rows and bytes of an Arrow batch, whichever is reached first. Texts can be long, so batches are kept small; parameters,
#: not limits on what is processed.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep Arrow batches small. Both hold for the whole session, as plans run later."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """A column's strings; null becomes the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def nonempty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filtered(df: DataFrame, mask, column: str) -> DataFrame:
    """The rows of ``df``, with all columns, for which ``mask(column's values)`` holds. Row by row: no shuffle.

    ``mask`` gets the values of an Arrow batch as a list and returns a list of booleans.
    """
    prepare(df.sparkSession)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in nonempty(batches):
            yield b.filter(pa.array(mask(b.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)
