"""Operator 2: what is learned from, and the fit against kernel ridge regression on plain sets."""

import random
import zlib

import numpy as np
import pytest
from kmerloom.llm import language


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_repeated_ids_and_rows_keep_their_language(spark):
    rng = random.Random(1)
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    for one in ids[:3]:
        rows = [(one, words(rng, "abcdef", 12), "en") for _ in range(4000)] + [(i, words(rng, "uvwxyz", 12), "xx") for i in ids] + [(ids[5], "same text here", "yy")] * 2000 + [(ids[6], "lonely row", "zz"), (ids[7], None, "nn"), (None, "null id", "oo")]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
        got = language.training_rows(df, 300, "doc_id", "text", "lang")
        assert {k: len(v) for k, v in got.items()} == {"en": 300, "xx": len(ids), "yy": 300, "zz": 1}
        again = language.training_rows(df.repartition(3), 300, "doc_id", "text", "lang")
        assert again == got
    assert "en" in language.fit(df).languages


def test_bytes_are_bounded(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1]
    df = spark.createDataFrame([(i, "a" * 1000, "en") for i in ids] + [(i, "b" * 1000, "de") for i in ids], "doc_id long, text string, lang string")
    got = language.training_rows(df, 300, "doc_id", "text", "lang", text_bytes=20_000)
    assert {k: len(v) for k, v in got.items()} == {"de": 10, "en": 10}
    assert {k: len(v) for k, v in language.training_rows(df, 300, "doc_id", "text", "lang", text_bytes=10).items()} == {"de": 2, "en": 2}


def test_fit_equals_nystroem_ridge_on_sets():
    rng = random.Random(7)
    texts = {name: [words(rng, letters, rng.randint(3, 20)) for _ in range(n)] for name, letters, n in (("aa", "abcdefg", 30), ("bb", "defghij", 12), ("cc", "ghijklm", 5))}
    model = language.fit_texts(texts, landmarks=4, ridge=0.05)

    def grams(t):
        t = f" {t} "
        return {t[i : i + n] for n in language.ORDERS for i in range(len(t) - n + 1)}

    def kernel(x, y):
        return np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in map(grams, y)] for a in map(grams, x)])

    marks = [t for own in texts.values() for t in own[:4]]
    every, label = [t for own in texts.values() for t in own], np.repeat(np.arange(3), [len(v) for v in texts.values()])
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    f = np.hstack([kernel(every, marks) @ root, np.ones((len(every), 1))])
    share = (len(every) / (3 * np.bincount(label)))[label]
    y = np.where(label[:, None] == np.arange(3), 1.0, -1.0)
    solved = np.linalg.solve(f.T @ (f * share[:, None]) + 0.05 * np.eye(f.shape[1]), f.T @ (y * share[:, None]))
    new = [words(rng, letters, 15) for letters in ("abcdefg", "defghij", "ghijklm", "xyz") for _ in range(3)]
    want = np.hstack([kernel(new, marks) @ root, np.ones((len(new), 1))]) @ solved
    assert model.scores(new) == pytest.approx(want, rel=1e-6, abs=1e-8)
