"""Kept indexes: nothing of them is shuffled in a join, and those made otherwise are turned down."""

import pytest
from kmerloom.operators import kmers
from kmerloom.sources import indexes
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_is_not_shuffled(spark, tmp_path):
    folder = str(tmp_path / "index")
    seqs = spark.createDataFrame([("ACGTACGTTGCATGGACCATTGACCATGA" * 3,), ("TTTTTTTTTTACGATCAGCATCAGCATCACGACTACGACT",)], "seq string")
    index = kmers.minimizers(seqs, "seq", 15, 5).select("kmer").distinct()
    indexes.save_index(index, folder, "kmer", 6, k=15, w=5, alphabet="dna")
    loaded = indexes.load_index(spark, folder, k=15, w=5)
    assert sorted(loaded.collect()) == sorted(index.collect()) and indexes.index_header(spark, folder)["made_with"] == {"k": 15, "w": 5, "alphabet": "dna"}
    reads = spark.createDataFrame([(i, s) for i, s in enumerate(["ACGTACGTTGCATGGACCATTGACCATGA", "GGGGGGGGGGGGGGGGGGGGGGGG", "CATCAGCATCACGACTACGACT"])], "id int, seq string")
    own = kmers.minimizers(reads, "seq", 15, 5)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = indexes.held_by(own, loaded, "kmer")
        assert sorted(r["id"] for r in joined.select("id").distinct().collect()) == sorted(r["id"] for r in own.join(index, "kmer", "left_semi").select("id").distinct().collect()) != []
        plan = plan_of(joined)
        assert "Bucketed: true" in plan
        # one exchange, that of the reads
        assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
        # an aggregation by key shuffles nothing at all
        assert "Exchange" not in plan_of(loaded.groupBy("kmer").agg(F.count("*")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_wrong_indexes_fail(spark, tmp_path):
    folder = str(tmp_path / "sketch")
    rows = spark.createDataFrame([(f"h{i}", i % 3) for i in range(30)], "hash string, ref int")
    indexes.save_index(rows, folder, "hash", 4, k=17, sketch=50)
    assert indexes.load_index(spark, folder, k=17, sketch=50).count() == 30
    for wrong in ({"k": 21}, {"k": 17, "sketch": 100}, {"w": 5}):
        with pytest.raises(ValueError, match="made with"):
            indexes.load_index(spark, folder, **wrong)
    with pytest.raises(Exception):
        indexes.load_index(spark, str(tmp_path / "none"))
    indexes.save_index(rows.limit(0), str(tmp_path / "empty"), "hash", 4, k=17)
    assert indexes.load_index(spark, str(tmp_path / "empty"), k=17).count() == 0
