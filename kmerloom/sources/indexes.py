"""Indexes of k-mers or sketch hashes that are kept: bucketed tables with a checked header.

A folder holds the rows, dealt into buckets by key and sorted in them, and a header that says how they were made (k, w, sketch size, alphabet and whatever else) and how they are dealt.
Loaded, an index is a table whose buckets Spark knows, so a join on its key shuffles the other side only, however large the index is. Loading checks the header
against what the caller works with: an index of another k finds nothing, and nothing would tell.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1


def save_index(index: DataFrame, folder: str, key: str, buckets: int, **made_with: int | str) -> None:
    """Write an index dealt into ``buckets`` by ``key``, with what it was made with. The header is written last: a folder without one is no index."""
    spark = index.sparkSession
    name = f"kmerloom_index_{uuid.uuid4().hex[:12]}"
    dealt = index.repartition(buckets, key)  # as buckets are dealt, so that each is one file
    dealt.write.format("parquet").mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", f"{folder}/rows").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the rows stay in their folder
    header = {"format": FORMAT, "key": key, "buckets": buckets, "schema": index.schema.json(), "made_with": made_with}
    spark.createDataFrame([(json.dumps(header, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/header")


def index_header(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/header").first()[0])


def load_index(spark: SparkSession, folder: str, **expected: int | str) -> DataFrame:
    """The rows of an index as a bucketed table. Fails if it was made with other values than expected, or does not say."""
    from pyspark.sql.types import StructType

    header = index_header(spark, folder)
    if header.get("format") != FORMAT:
        raise ValueError(f"{folder}: an index of format {header.get('format')}, not {FORMAT}")
    wrong = {n: header["made_with"].get(n) for n, v in expected.items() if header["made_with"].get(n) != v}
    if wrong:
        raise ValueError(f"{folder}: made with {wrong}, not {({n: expected[n] for n in wrong})}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(header["schema"])).fields)
    name = f"kmerloom_index_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{header['key']}`) SORTED BY (`{header['key']}`) INTO {header['buckets']} BUCKETS LOCATION '{folder}/rows'")
    return spark.table(name)


def held_by(queries: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """The rows of ``queries`` whose key the index holds. The index stays where it is; rows of frequent keys are split by Spark as in any join."""
    return queries.join(index.select(F.col(key)).hint("merge"), key, "left_semi")
