"""The near-duplicate stage where very many texts share the same rare shingles."""

import random
import time

import pytest
from kmerloom.llm import simhash


def chains(texts):
    """Ids of each chain's smallest, by brute force over all pairs."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4:
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    return {i for i, x in enumerate(label) if i == x}


def page(rng, n, at, word):
    words = [f"c{i}" for i in range(n)]
    words[at] = word
    return " ".join(words)


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r["doc_id"] for r in simhash.first_of_each_group(df).collect()}


@pytest.mark.parametrize("block", [4096, 15])
def test_pages_that_differ_in_a_word(spark, monkeypatch, block):
    """Similarities below and above the threshold, from one template; whole classes that only another text joins."""
    monkeypatch.setattr(simhash, "BLOCK_SETS", block)
    rng = random.Random(1)
    low = [page(rng, 29, 14, f"u{i}") for i in range(60)]  # 20 of 30 shingles: 0.667
    high = [page(rng, 80, 40, f"x{i} y") for i in range(40)]
    two = [" ".join(f"d{k}" if k != 7 else f"p{i % 6}" for k in range(29)) for i in range(24)]  # copies, and words that several pages have
    between = [page(rng, 49, 24, f"v{i} extra") for i in range(30)] + [" ".join(f"c{i}" for i in range(49))]
    texts = low + high + two + between
    rng.shuffle(texts)
    assert kept(spark, texts) == chains(texts)


def test_a_class_is_joined_by_another_text(spark):
    """Pages with 6 shingles of their own of 46: 0.77 with each other, 0.87 with the page that has none."""
    core = [f"c{i}" for i in range(44)]
    texts = [" ".join([*core, *(f"t{i}x{k}" for k in range(6))]) for i in range(30)]
    assert kept(spark, texts) == chains(texts) == set(range(30))
    texts.append(" ".join(core))
    assert kept(spark, texts) == chains(texts) == {0}


def test_many_pages_of_one_template(spark):
    rng = random.Random(3)
    texts = [page(rng, 29, 14, f"u{i}") for i in range(20_000)]
    began = time.perf_counter()
    assert len(kept(spark, texts)) == 20_000
    assert time.perf_counter() - began < 120
