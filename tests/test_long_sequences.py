"""Operators on sequences a hundred times longer: time follows the length."""

import random
import time

from kmerloom.operators import clusters
from kmerloom.sources import fastx


def test_runs_of_a_long_pair(spark):
    rng = random.Random(1)
    reference = "".join(rng.choice("ACGT") for _ in range(1_000_000))
    mapped = "".join("-" if 100_000 <= i < 300_000 else c if i % 50_000 else "N" for i, c in enumerate(reference))[:900_000]
    df = spark.createDataFrame([(1, reference, mapped), (2, "ACGT", None), (3, "ACGT", "ACGTTT"), (4, "", "A"), (5, None, "A")], "k long, r string, m string")
    began = time.perf_counter()
    got = {}
    for r in clusters.match_runs(df, "k", "r", "m").orderBy("k", "run").collect():
        got.setdefault(r["k"], []).append((r["start"], r["length"], r["state"]))
    assert time.perf_counter() - began < 60
    assert set(got) == {1, 2, 3} and got[2] == [(0, 4, "unmapped")] and got[3] == [(0, 4, "match")]
    assert sum(x[1] for x in got[1]) == len(reference) and (100_000, 200_000, "unmapped") in got[1] and got[1][-1] == (900_000, 100_000, "unmapped") and got[1][0] == (0, 1, "mismatch")


def test_index_of_many_records(spark):
    text = "".join(f">r{i} x\n{'ACGT' * (i % 30)}\n" for i in range(30_000))
    began = time.perf_counter()
    rows = fastx.fai_index(spark.createDataFrame([(1, text), (1, ">a\nAC\n"), (2, ""), (3, None)], "k long, text string"), "k").orderBy("k", "ord", "offset").collect()
    assert time.perf_counter() - began < 60 and len(rows) == 30_001
    raw = text.encode()
    for r in rows[5::997]:
        assert raw[r["offset"] : r["offset"] + r["length"]] == b"ACGT" * (r["ord"] % 30)
