"""Parts that are appended once, whatever is killed and repeated, and chunked counts of a stream of reads."""

from kmerloom.operators import kmers
from kmerloom.sources import appended
from kmerloom.streaming import reads


def rows(spark, part, n=5):
    return spark.createDataFrame([(f"p{part}r{i}", i) for i in range(n)], "name string, n long")


def test_killed_between_rows_and_mark(spark, tmp_path):
    folder = str(tmp_path / "table")
    assert appended.read_parts(spark, folder, "name string, n long").count() == 0 and appended.done_parts(spark, folder).count() == 0
    appended.append_part(rows(spark, 1), folder, 1)
    rows(spark, 2).write.parquet(f"{folder}/data/part=2")  # killed before its mark
    assert sorted(r["name"] for r in appended.read_parts(spark, folder, "name string, n long").collect()) == [f"p1r{i}" for i in range(5)]
    wanted = spark.createDataFrame([(i,) for i in (1, 2, 3)], "part long")
    assert [r["part"] for r in appended.remaining_parts(spark, folder, wanted).orderBy("part").collect()] == [2, 3]
    for part in (1, 2, 3, 2, 1):  # repeats change nothing, not even with other rows
        appended.append_part(rows(spark, part) if part != 3 else rows(spark, 3, 0), folder, part)
    assert sorted(r["name"] for r in appended.read_parts(spark, folder, "name string, n long").collect()) == [f"p{p}r{i}" for p in (1, 2) for i in range(5)]
    assert {r["part"]: r["rows"] for r in appended.done_parts(spark, folder).collect()} == {1: 5, 2: 5, 3: 0}


def test_chunks_of_reads(spark, tmp_path):
    df = spark.createDataFrame([("ACGTACGTAA" * (i % 4), "IIII#IIIII" * (i % 4), i) for i in range(40)] + [(None, None, 1)], "seq string, qual string, n int").repartition(6)
    df.write.parquet(str(tmp_path / "reads"))
    plain = lambda d: sorted(map(tuple, d.collect()))
    for size in (1, 100):
        assert plain(reads.chunked_kmer_counts(spark, str(tmp_path / "reads"), "seq", 5, files_a_chunk=size)) == plain(kmers.counts(df, "seq", 5))
    want = kmers.quality_kmers(df.select("seq", "qual"), "seq", "qual", 5).groupBy("kmer").count()
    assert plain(reads.chunked_kmer_counts(spark, str(tmp_path / "reads"), "seq", 5, qual="qual", files_a_chunk=2)) == plain(want)
