"""Counts behind a sketch equal plain counts, whatever the sketch's size."""

import random

import numpy as np
import pytest
from kmerloom.operators import counting, kmers


def reads(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ACGT") for _ in range(3000))
    rows = [text[i : i + 100] for i in range(0, 2900, 9)] + ["".join(rng.choice("ACGTé漢") for _ in range(200)) for _ in range(60)] + [None, "", "ACG", "A" * 3000]
    return spark.createDataFrame([(r, 1, "b", 2) for r in rows], "seq string, block int, kmer string, page int").repartition(5)


@pytest.mark.parametrize("k,least,bits", [(21, 2, None), (31, 5, None), (8, 1, 16), (13, 300, 16)])
def test_equal_to_plain_counts(spark, k, least, bits):
    df = reads(spark)
    want = kmers.min_count(kmers.counts(df, "seq", k), least)
    assert sorted(map(tuple, counting.prefiltered_counts(df, "seq", k, least, bits).collect())) == sorted(map(tuple, want.collect()))


def test_single_kmers_stay_out_of_the_shuffle(spark):
    rng = random.Random(8)
    rows = [("".join(rng.choice("ACGT") for _ in range(500)),) for _ in range(200)]
    df = spark.createDataFrame(rows + [("ACGTTGCATTAGGACCATTGACCATTGACGT",)] * 3, "seq string")
    found = counting.prefiltered_counts(df, "seq", 31, 2)
    assert found.collect() == [("ACGTTGCATTAGGACCATTGACCATTGACGT"[:31], 3)]
    # of some 94,000 k-mers next to none pass the sketch
    cut = kmers.blocks(df.select("seq"), "seq", 31).select("block")
    opened = sum(int(np.unpackbits(np.frombuffer(r["open"], "u1")).sum()) for r in counting.sketch(cut, 31, 2, 22).collect())
    assert opened < 0.06 * 94_000


def test_hashes_and_empty_tables(spark):
    h, starts = counting.kmer_hashes(["abcabc", "ab", "", "cabca"], 3)
    assert starts.tolist() == [0, 1, 2, 3, 8, 9, 10] and h[0] == h[3] == h[5] and h[1] == h[6] and h[2] == h[4]
    assert counting.prefiltered_counts(spark.createDataFrame([], "seq string"), "seq").count() == 0
