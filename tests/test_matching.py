"""k-mers that an index may have: all that it has, next to no others, whatever the pieces texts are cut in."""

import random

import pytest
from kmerloom.functions import letters
from kmerloom.operators import kmers, matching


def texts():
    rng = random.Random(2)
    return ["".join(rng.choice("abé漢 ") for _ in range(n)) for n in (0, 4, 5, 40, 700, 3000)] + [None]


@pytest.mark.parametrize("flank", [None, 2])
def test_all_of_the_index_and_no_others(spark, flank):
    df = spark.createDataFrame(list(enumerate(texts())), "id int, s string")
    of = (lambda x: x) if flank is None else (lambda x: x[:2] + x[3:])
    known = {of(texts()[4][i : i + 5]) for i in range(60)} | {"zzzzz"[: 5 if flank is None else 4]}
    got = sorted(map(tuple, matching.matching(df, "s", 5, sorted(known), flank).collect()))
    assert got == sorted((i, p, t[p : p + 5]) for i, t in enumerate(texts()) if t for p in range(len(t) - 4) if of(t[p : p + 5]) in known)
    assert matching.matching(df, "s", 5, [], flank).count() == 0


def test_only_kmers_of_the_index_are_rows(spark, monkeypatch):
    """Before, each k-mer of each read was a row that met the index in a join."""
    df = spark.createDataFrame(list(enumerate(texts())), "id int, s string")
    index = kmers.kmers(df.where("id = 3"), "s", 9)
    found = kmers.kmers_in(df.select("id", "s"), "s", 9, index)
    assert found.count() < 100 < kmers.kmers(df, "s", 9).count()
    mapped = [sorted(map(tuple, kmers.map_to_reference(df, df.where("id = 3").withColumnRenamed("id", "c"), "id", "c", "s", 3).collect()))]
    monkeypatch.setattr(kmers, "KNOWN", 0)
    mapped.append(sorted(map(tuple, kmers.map_to_reference(df, df.where("id = 3").withColumnRenamed("id", "c"), "id", "c", "s", 3).collect())))
    assert mapped[0] == mapped[1] and mapped[0]
    assert letters.GROUP > 3000
