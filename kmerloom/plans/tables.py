"""Tables between steps: where they are written, and how they are joined."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of values, with ROW_BYTES for each row on top, up to which a side of a join is broadcast.
BROADCAST_BYTES, ROW_BYTES = 24 << 20, 32

#: Folders of tables that are removed when the program ends, with the file system configuration they were made with.
_made: dict[str, object] = {}


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the program was started. Holds for the whole session, as plans run later."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only a local session may go without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="kmerloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/kmerloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: its lineage ends there. Removed when the program ends, if not before."""
    spark = df.sparkSession
    path = new_path(spark, label)
    if not _made:
        atexit.register(_remove_all)
    _made[path] = spark.sparkContext._jsc.hadoopConfiguration()
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark_jvm, folder: str, configuration) -> None:
    path = spark_jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(configuration).delete(path, True)


def _remove_all() -> None:
    from pyspark import SparkContext

    if SparkContext._gateway is not None:
        for folder, configuration in _made.items():
            _delete(SparkContext._gateway.jvm, folder, configuration)
    _made.clear()


def remove(df: DataFrame) -> None:
    """Delete a table that ``written`` made, once nothing needs it any more."""
    spark = df.sparkSession
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if "/kmerloom/" in folder:
            _delete(spark.sparkContext._jvm, folder, spark.sparkContext._jsc.hadoopConfiguration())


def checked_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, evaluated once into a table, and marked for broadcast if its values have at most ``most`` bytes, else left for Spark to shuffle."""
    df = written(df, "side")
    bytes_ = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)).cast("long") for c in df.columns]
    size = df.agg(F.sum(sum(bytes_[1:], bytes_[0]) + ROW_BYTES)).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def ranked(df: DataFrame, name: str, *order: str, within: str | None = None) -> DataFrame:
    """``df`` with a column ``name``: each row's number, from 1, in the given order, within its group if there is one.

    Rows are sorted by ranges, and only one count for each partition is summed up in one place, so no task holds a whole group.
    """
    keys = [within, *order] if within else list(order)
    rows = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(name, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(name, 33)
    counts = rows.groupBy(part.alias("part_")).agg(F.count("*").alias("n_"))
    starts = counts.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_") + 1).alias("start_"))
    at = F.col("start_") + F.col(name).bitwiseAND((1 << 33) - 1)
    out = rows.join(F.broadcast(starts), part == F.col("part_")).select(*df.columns, at.alias(name))
    if within is None:
        return out
    firsts = out.groupBy(F.col(within).alias("group_")).agg(F.min(name).alias("first_"))
    return out.join(firsts, F.col(within).eqNullSafe(F.col("group_"))).select(*df.columns, (F.col(name) - F.col("first_") + 1).alias(name))


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Rows dealt out evenly before they are expanded, where a table is read in fewer pieces than the cluster has cores.

    Told from what is known without running anything: the number of files, and the bytes of the plan against those of a piece.
    """
    spark = df.sparkSession
    wanted = least or spark.sparkContext.defaultParallelism
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    pieces = max(len(df.inputFiles()), known // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(wanted) if pieces < wanted else df
