"""Minimizers and smallest hashes from arrays, against plain loops: long texts in pieces, letters of several bytes, short texts."""

import hashlib
import random

import numpy as np
import pytest
from kmerloom.functions import letters
from kmerloom.operators import kmers, minima


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def texts():
    rng = random.Random(4)
    make = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    return ["", None, "a", make(6, "ab"), make(60, "abc"), make(900, "ab"), "a" * 300, make(500, "aé漢😀b"), make(3000, "abcdefgh ")]


@pytest.mark.parametrize("k,w", [(31, 15), (5, 3), (3, 9), (1, 4), (56, 2), (8, 1)])
@pytest.mark.parametrize("group", [1 << 18, 100])
def test_minimizers_equal_plain_ones(monkeypatch, k, w, group):
    monkeypatch.setattr(letters, "GROUP", group)
    got = [(int(r), int(p), t[x : x + k]) for rows, places, _, t, at in minima.minimizers_of(texts(), k, w) for r, p, x in zip(rows, places, at, strict=True)]
    want = set()
    for row, t in enumerate(texts()):
        own = [(md5(t[i : i + k]), i, t[i : i + k]) for i in range(len(t) - k + 1)] if t else []
        want |= {(row, *min(own[i : i + w])[1:]) for i in range(max(len(own) - w + 1, min(len(own), 1)))}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("k", [1, 3, 4, 17, 31, 55, 56])
def test_md5(k):
    text = "".join(t for t in texts() if t)
    high, low = minima.md5_of_windows(letters.codes_of(text), k, np.ones(len(text) - k + 1, bool))
    assert [f"{h:016x}{x:016x}" for h, x in zip(high.tolist(), low.tolist(), strict=True)] == [md5(text[i : i + k]) for i in range(len(text) - k + 1)]


def test_no_kmer_is_exploded(spark):
    """Before, every window of every block was a row or an array entry of Spark's; now tasks hand over minimizers and smallest hashes only."""
    df = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts())], "id int, s string")
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (kmers.minimizers(df, "s", 5, 3), kmers.sketches(df, "id", "s", 5, 4))]
    assert all("Generate" not in p and "MapInArrow" in p for p in plans)
    got = sorted((r["id"], r["hash"]) for r in kmers.sketches(df, "id", "s", 5, 4).collect())
    want = {i: set() for i in range(7)}
    for i, t in enumerate(texts()):
        want[i % 7] |= {md5(t[j : j + 5]) for j in range(len(t) - 4)} if t else set()
    assert got == sorted((i, h) for i, own in want.items() for h in sorted(own)[:4])


def test_large_and_small_indexes_agree(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(texts())) + [(8, texts()[5])], "id int, s string")
    index = kmers.minimizers(df.where("id in (4, 7)"), "s", 5, 3).select("kmer")
    small = sorted(map(tuple, kmers.contained(df, index, "id", "s", 5, 3).collect()))
    monkeypatch.setattr(kmers, "KNOWN", 0)
    assert small == sorted(map(tuple, kmers.contained(df, index, "id", "s", 5, 3).collect())) and any(r[2] for r in small)
