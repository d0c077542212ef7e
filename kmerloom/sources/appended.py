"""Append-only tables in parts: a part counts once it is marked as done, so a killed writer leaves nothing half and a repeated one doubles nothing.

``folder/data/part=N`` holds a part's rows and ``folder/done/part=N`` its mark, written after them with their number. Spark commits a folder as a
whole; what is left between rows and mark is a part without a mark, which readers pass over and the next attempt writes anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def done_parts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, rows) of the parts that are marked as done."""
    if not _exists(spark, f"{folder}/done"):
        return spark.createDataFrame([], "part long, rows long")
    return spark.read.schema("rows long, part long").parquet(f"{folder}/done").select("part", "rows")


def append_part(rows: DataFrame, folder: str, part: int) -> None:
    """Write the rows of a part and mark it. A part that is marked already stays as it is."""
    spark = rows.sparkSession
    if _exists(spark, f"{folder}/done/part={part}/_SUCCESS"):
        return
    rows.write.mode("overwrite").parquet(f"{folder}/data/part={part}")
    spark.read.schema(rows.schema).parquet(f"{folder}/data/part={part}").agg(F.count("*").alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/done/part={part}")


def read_parts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all parts that are marked, and of no others. Part folders are pruned by the list of marks."""
    done = [r["part"] for r in done_parts(spark, folder).select("part").collect()]  # one number for each part
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, part long").parquet(f"{folder}/data").where(F.col("part").isin(done)).drop("part")


def remaining_parts(spark: SparkSession, folder: str, parts: DataFrame, part: str = "part") -> DataFrame:
    """The rows of ``parts`` whose number is not marked as done: what a resumed run has left to do."""
    done = done_parts(spark, folder).select(F.col("part").alias("done_"))
    return parts.join(done, F.col(part) == F.col("done_"), "left_anti")
