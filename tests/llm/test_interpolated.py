"""Operator 12 against counts in dictionaries and a plain expectation-maximisation."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from kmerloom.llm import base, interpolated
from kmerloom.llm import queries as llm

SCHEMA = "doc_id long, text string, chunk long, side int, n long, cell string, order_ int, score int"


def tokens_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w] + ["</end>"]


def side(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 if doc_id is not None else -1


def counted(docs, order):
    """Per order, how often each n-gram stands; contexts of a document's beginning are marks."""
    grams = [Counter() for _ in range(order + 1)]
    for _, t in docs:
        seq = ["<b>"] * (order - 1) + tokens_of(t)
        for i in range(order - 1, len(seq)):
            for m in range(1, order + 1):
                grams[m][tuple(seq[i - m + 1 : i + 1])] += 1
        for m in range(1, order):
            grams[m][("<b>",) * m] += 1
    return grams


def evidence(docs, grams, order):
    """For each token (document, counts by order, contexts from the second order on)."""
    for k, (_, t) in enumerate(docs):
        seq = ["<b>"] * (order - 1) + tokens_of(t)
        for i in range(order - 1, len(seq)):
            yield k, [grams[m][tuple(seq[i - m + 1 : i + 1])] for m in range(1, order + 1)], [grams[m - 1][tuple(seq[i - m + 1 : i])] for m in range(2, order + 1)]


def level(c):
    return 0 if c == 0 else min(1 + int(math.log2(c)), interpolated.LEVELS - 1)


def brute(docs, order, weights=None):
    train = [d for d in docs if side(d[0]) != 2]
    grams = counted(train, order)
    own = {k: v for k, v in grams[1].items() if k != ("<b>",)}
    n, v = sum(own.values()), len(own)
    base_score, known, total, score = ([0.0] * len(docs) for _ in range(4))
    for k, c, x in evidence(docs, grams, order):
        base_score[k] += math.log10((c[0] + 1) / (n + v + 1))
        known[k] += c[0] > 0
        total[k] += 1
        if weights:
            p = 1 / (v + 1)
            p = weights[0][0] * c[0] / n + (1 - weights[0][0]) * p
            for m in range(1, order):
                w = weights[m][level(x[m - 1])]
                p = w * (c[m] / x[m - 1] if x[m - 1] else 0) + (1 - w) * p
            score[k] += math.log10(p)
    return n, v, [(d[0], side(d[0]) == 2, int(t), int(h), n, b, s) for d, t, h, b, s in zip(docs, total, known, base_score, score, strict=True)]


def em(docs, order, rounds=interpolated.ROUNDS):
    """Weights learned from the deleted fold, token by token."""
    train = [d for d in docs if side(d[0]) != 2]
    rest, gone = [d for d in train if side(d[0]) != 3], [d for d in train if side(d[0]) == 3]
    grams, everything = counted(rest, order), counted(train, order)
    v = len([k for k in everything[1] if k != ("<b>",)])
    n = sum(c for k, c in grams[1].items() if k != ("<b>",))
    found = [(c, x) for _, c, x in evidence(gone, grams, order)]
    weights = [{0: 0.5}] + [{b: 0.5 if b else 0.0 for b in range(interpolated.LEVELS)} for _ in range(order - 1)]
    for _ in range(rounds):
        own, reach = [Counter() for _ in range(order)], [Counter() for _ in range(order)]
        for c, x in found:
            at = [0, *map(level, x)]
            f = [c[0] / n, *((a / b if b else 0) for a, b in zip(c[1:], x, strict=True))]
            p = [1 / (v + 1)]
            for m in range(order):
                p.append(weights[m][at[m]] * f[m] + (1 - weights[m][at[m]]) * p[-1])
            r = 1.0
            for m in reversed(range(order)):
                part = r * weights[m][at[m]] * f[m] / p[m + 1]
                own[m][at[m]] += part
                reach[m][at[m]] += r
                r -= part
        weights = [{b: (own[m][b] + 0.5) / (reach[m][b] + 1) if b or m == 0 else 0.0 for b in w} for m, w in enumerate(weights)]
    return weights


def corpus(n, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(n):
        words, w = [], rng.choice(vocabulary)
        for _ in range(rng.randint(0, 60)):
            w = vocabulary[(vocabulary.index(w) * 7 + rng.choice([1, 1, 1, 2, 5])) % 60] if rng.random() < 0.8 else rng.choice(vocabulary)
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, " ".join(words)))
    return docs + [(None, "w1 w2"), (5, None), (5, ""), (9, "  \n\t "), (11, "É é\x0bx\x1cy"), (13, "long " * 30_000), (14, "w1 w2"), (14, "w1 w2")]


def results(df):
    return sorted(map(tuple, df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=str)


@pytest.mark.parametrize("order,size,keys", [(3, 1 << 20, 1 << 20), (3, 4_000, 500), (2, 20_000, 100), (1, 20_000, 1000)])
def test_against_dictionaries(spark, monkeypatch, order, size, keys):
    docs, kept, learned = corpus(300), [], interpolated.learned
    monkeypatch.setattr(interpolated, "learned", lambda *a: kept.append(learned(*a)) or kept[-1])
    df = spark.createDataFrame([(*d, 1, 1, 1, "c", 1, 1) for d in docs], SCHEMA).repartition(5)
    rows = results(interpolated.score_documents(df, order, chunk_bytes=size, bucket_keys=keys))
    own = [dict(enumerate(w.tolist())) for w in kept[0]]
    want = sorted(brute(docs, order, own)[2], key=str)
    assert [r[:5] for r in rows] == [w[:5] for w in want]
    for r, w in zip(rows, want, strict=True):
        assert r[5:] == pytest.approx(w[5:], rel=1e-9)
    # weights learned from cells of whole octaves against those of a plain form that sees every deleted token: as good to a thousandth
    gone = [d for d in docs if side(d[0]) == 3]

    def likelihood(weights):
        rest = [d for d in docs if side(d[0]) not in (2, 3)]
        return sum(s for *_, s in scored(rest, gone, order, weights))

    assert likelihood(own) >= likelihood(em(docs, order)) * 1.001


def scored(rest, others, order, weights):
    """Texts of ``others`` scored by the counts of ``rest`` alone."""
    grams = counted(rest, order)
    own = {k: v for k, v in grams[1].items() if k != ("<b>",)}
    n, v = sum(own.values()), len(own)
    for _, c, x in evidence(others, grams, order):
        p = 1 / (v + 1)
        p = weights[0][0] * c[0] / n + (1 - weights[0][0]) * p
        for m in range(1, order):
            w = weights[m][level(x[m - 1])]
            p = w * (c[m] / x[m - 1] if x[m - 1] else 0) + (1 - w) * p
        yield None, math.log10(p)


def test_whole_table(spark, data):
    docs = [tuple(r) for r in base.table(spark, data, "documents").select("doc_id", "text").collect()]
    rows = results(llm.op12_lm_scores(spark, data))
    want = sorted(brute(docs, 3)[2], key=str)
    assert [r[:5] for r in rows] == [w[:5] for w in want]
    assert all(a[5] == pytest.approx(b[5], rel=1e-12) for a, b in zip(rows, want, strict=True))
    # the model tells held-out texts better than single words do
    assert sum(r[6] for r in rows if r[1]) > sum(r[5] for r in rows if r[1])
    assert all(r[6] < 0 for r in rows)


def test_weights_make_held_out_tokens_likelier():
    rng = np.random.default_rng(5)
    n, f = rng.integers(1, 9, 400), [rng.random(400) * 0.01, rng.random(400) * (rng.random(400) < 0.5)]
    levels = [np.zeros(1, "i8"), rng.integers(0, 5, 400)]
    f[1][levels[1] == 0] = 0

    def likelihood(rounds):
        w = interpolated.learned(n, f, levels, 1e-3, rounds)
        return float((n * np.log(interpolated.mixture(f, levels, w, 1e-3)[-1])).sum())

    at = [likelihood(r) for r in (0, 1, 3, 30)]
    assert at == sorted(at) and at[-1] > at[0]


def test_numbers_as_bytes():
    rng = np.random.default_rng(1)
    for keys in (np.zeros(0, "u8"), np.array([2**64 - 1], "u8"), np.array([0, 2**64 - 1], "u8"), np.unique(rng.integers(0, 2**64, 1000, "u8"))):
        assert (interpolated.unpack_sorted(interpolated.pack_sorted(keys)) == keys).all()
    counts = np.array([0, 1, 254, 255, 256, 10**12])
    assert (interpolated.unpack_counts(interpolated.pack_counts(counts), 6) == counts).all()


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert interpolated.score_documents(empty).count() == 0
    only = [i for i in range(60) if side(i) == 2][:3]  # nothing to learn from
    rows = results(interpolated.score_documents(spark.createDataFrame([(i, "a b", 1, 1, 1, "c", 1, 1) for i in only], SCHEMA)))
    assert [r[1:] for r in rows] == [(True, 3, 0, 0, 0.0, 0.0)] * 3
