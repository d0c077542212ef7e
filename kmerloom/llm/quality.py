"""Operator 5: a quality classifier of random Fourier features over document statistics.

Each whole text gives a short vector of statistics. Standardised by the training rows, the vector is mapped to
random Fourier features, whose inner products approximate a Gaussian kernel. Ridge regression on them is fitted
from normal equations summed by partition, and its scores are turned into probabilities by isotonic regression
over a histogram of scores. All three passes sum over all labelled rows; the driver gets moments, one Gram
matrix and one histogram, whose sizes do not depend on the data. Between the levels that isotonic regression finds the
probability rises with the raw score, so it keeps the raw scores' order and is never 0 or 1.

Rows are dealt by crc32 of the id, modulo 3: remainder 1 is held out, and 0 and 2 are the two halves of the training
rows. The ridge is fitted on both; the calibration sees each half with the scores of a ridge fitted on the other. Labels, lang, source and ids are never inputs of a score.

Defined results: null and empty texts have all-zero statistics and get their score like any other. Without
training labels every score is 0.5 and ``good_rows`` keeps all rows. Several labels of one id all count. Rows of equal id
are scored each. Equal texts have equal scores. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import checked_broadcast
from .base import filtered, fold, held_out, nonempty, prepare, texts_of, written

STATISTICS = (
    "log_chars", "log_words", "mean_word", "word_spread", "upper", "digits", "spaces", "line_feeds", "sentence_marks", "commas", "quotes", "exclaims", "pipes_slashes", "symbols", "controls", "beyond_ascii",
    "shouted_words", "words_with_symbols", "one_letter_words", "long_words", "distinct_words", "top_word", "repeated_lines", "mean_line", "short_lines", "alphabet_entropy", "brackets", "markup", "echoed_words")
FEATURES, GAMMA, RIDGE, SEED, BINS = 384, 0.005, 0.3, 17, 1024

# Classes of ASCII bytes.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "spaces": b" \t", "line_feeds": b"\n\r", "sentence_marks": b".?", "commas": b",;:", "quotes": b"\"'`", "exclaims": b"!", "pipes_slashes": b"|/\\", "symbols": b"#$%&*+=@^_~", "brackets": b"()[]{}", "markup": b"<>"}
_LOOKUP = np.zeros((256, len(CLASSES)), "f8")
for _i, _bytes in enumerate(CLASSES.values()):
    _LOOKUP[list(_bytes), _i] = 1
_SYMBOLS = bytes(b for c in ("exclaims", "pipes_slashes", "symbols", "brackets", "markup") for b in CLASSES[c])
_BLANKED = bytes.maketrans(_SYMBOLS, b"\x00" * len(_SYMBOLS))


def statistics(text: str) -> list[float]:
    """The statistics of a whole text, in the order of STATISTICS."""
    raw = text.encode()
    n = len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
    share = dict(zip(CLASSES, (counts @ _LOOKUP / n).tolist(), strict=True))
    control = float(counts[:32].sum() - counts[[9, 10, 13]].sum() + counts[127]) / n
    p = counts[counts > 0] / n
    words, lines = raw.split(), raw.splitlines()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), "i8", len(words)) if words else np.zeros(1, "i8")
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    shouted = sum(c for w, c in seen.items() if len(w) > 1 and w.isupper())
    marked = raw.translate(_BLANKED).split()
    with_symbols = sum(b"\x00" in w for w in marked)
    echoed = sum(map(bytes.__eq__, words, words[1:]))
    # Square roots of shares: a few marks tell more than the same number on top of many.
    share = {k: v ** 0.5 for k, v in share.items()}
    return [
        np.log1p(n), np.log1p(len(words)), float(lengths.mean()), float(lengths.std()), share["upper"], share["digits"], share["spaces"], share["line_feeds"], share["sentence_marks"], share["commas"], share["quotes"], share["exclaims"],
        share["pipes_slashes"], share["symbols"], control, float(counts[128:].sum()) / n, (shouted / m) ** 0.5, (with_symbols / m) ** 0.5, float((lengths == 1).sum()) / m, float((lengths > 20).sum()) / m, len(seen) / m ** 0.8, max(seen.values(), default=0) / m,
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), sum(len(x) < 30 for x in lines) / max(1, len(lines)), float(-(p * np.log(p)).sum()), share["brackets"], share["markup"], (echoed / m) ** 0.5]


def document_statistics(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_, doc_id, x binary): the statistics of each row as doubles. Row by row: no shuffle."""
    prepare(documents.sparkSession)
    kind = dict(documents.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in nonempty(batches):
            x = [np.array(statistics(t), "<f8").tobytes() for t in texts_of(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], names=["row_", "doc_id", "x"])

    rows = documents.select(F.monotonically_increasing_id().alias("row_"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"row_ long, doc_id {kind}, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), len(STATISTICS))


def _summed(rows: DataFrame, sums, size: int) -> np.ndarray:
    """The sum over all Arrow batches of ``sums(batch)``, a vector of ``size`` numbers: added up by partition, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in nonempty(batches):
            total += sums(b)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["k", "v"])

    out = np.zeros(size)
    for k, v in rows.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v")).collect():
        out[k] = v
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    low: float
    high: float
    at: np.ndarray  # raw scores, rising, and the calibrated probability at each; linear in between
    level: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.omega + self.phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def bins(self, raw: np.ndarray) -> np.ndarray:
        return np.clip((raw - self.low) / (self.high - self.low) * BINS, 0, BINS - 1).astype("i8")

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.level)


def isotonic(values: np.ndarray, weights: np.ndarray) -> list[tuple[float, int]]:
    """The non-decreasing sequence closest to values by weighted squares (pool adjacent violators), as (level, number of values) of its steps."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return [(v, int(n)) for v, _, n in blocks]


def calibrated(n: np.ndarray, ones: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores and the probability at each, from a histogram of raw scores between low and high and of those with label 1.

    Half a row of either label at both ends of the scores keeps every level off 0 and 1. Each step of the isotonic sequence runs from
    its lowest to its highest score, with a small rise; between steps the curve is linear, and beyond the outermost ones it goes half of
    the way that is left to 0 and 1.
    """
    held = np.flatnonzero(n)
    total, of_ones = n[held].astype("f8"), ones[held].astype("f8")
    centre = low + (held + 0.5) * (high - low) / len(n)
    width = (high - low) / len(n)
    total, of_ones, centre = (np.concatenate([[end[0]], x, [end[1]]]) for x, end in ((total, (1, 1)), (of_ones, (0.5, 0.5)), (centre, (centre[0] - width, centre[-1] + width))))
    steps, k = isotonic(of_ones / total, total), 0
    levels = [0.0, *(p for p, _ in steps), 1.0]
    at, level = [low - (high - low)], [levels[1] / 2]
    for i, (p, size) in enumerate(steps, 1):
        # a step rises by a tenth of what lies between it and the next one
        at += [centre[k] - 0.4 * width, centre[k + size - 1] + 0.4 * width]
        level += [p, p + 0.1 * (levels[i + 1] - p)]
        k += size
    return np.array([*at, high + (high - low)]), np.array([*level, (1 + level[-1]) / 2])


def fit(rows: DataFrame, labels: DataFrame, label: str = "quality", features: int = FEATURES, gamma: float = GAMMA, ridge: float = RIDGE, seed: int = SEED) -> QualityModel | None:
    """Fit on the rows of ``document_statistics`` that have labels and are not held out. None without labels."""
    known = labels.where(F.col(label).isNotNull() & F.coalesce(fold() != 1, F.lit(False))).select("doc_id", F.col(label).cast("double").alias("y_"), fold().cast("int").alias("fold_"))
    train = written(rows.join(known, "doc_id").select("x", "y_", "fold_"), "labelled")
    d = len(STATISTICS)

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x = _matrix(b.column(0))
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    sums = _summed(train.select("x"), moments, 1 + 2 * d)
    if not sums[0]:
        return None
    mean = sums[1 : d + 1] / sums[0]
    scale = np.sqrt(np.maximum(sums[d + 1 :] / sums[0] - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(seed)
    m = QualityModel(mean, scale, rng.normal(0, np.sqrt(2 * gamma), (d, features)), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), -0.5, 1.5, np.zeros(0), np.zeros(0))
    k = features + 1
    fit_rows = train.select("x", "y_", (F.col("fold_") == 2).cast("int").alias("half"))

    def normal(b: pa.RecordBatch) -> np.ndarray:
        f, y, half = m.features(_matrix(b.column(0))), b.column(1).to_numpy(), b.column(2).to_numpy()
        return np.concatenate([x for h in (0, 1) for g, z in [(f[half == h], y[half == h])] for x in ((g.T @ g).ravel(), g.T @ z)])

    sums = _summed(fit_rows, normal, 2 * (k * k + k)).reshape(2, -1)
    penalty = np.full(k, ridge)
    penalty[-1] = 1e-6

    def solved(total: np.ndarray) -> np.ndarray:
        return np.linalg.solve(total[: k * k].reshape(k, k) + np.diag(penalty), total[k * k :])

    m.weights = solved(sums.sum(0))
    # each half's rows get the scores of the other half's fit; a half without rows leaves the whole fit to both
    other = [solved(sums[1 - h]) if sums[1 - h].any() else m.weights for h in (0, 1)]

    def histogram(b: pa.RecordBatch) -> np.ndarray:
        f, half = m.features(_matrix(b.column(0))), b.column(2).to_numpy()
        at = m.bins(np.where(half == 0, f @ other[0], f @ other[1]))
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, b.column(1).to_numpy(), minlength=BINS)])

    sums = _summed(fit_rows, histogram, 2 * BINS)
    m.at, m.level = calibrated(sums[:BINS], sums[BINS:], m.low, m.high)
    return m


def classify(documents: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_, doc_id, held_out, score, predicted) of every row; row_ tells rows of one id apart."""
    rows = written(document_statistics(documents, doc_id, text), "statistics")
    model = fit(rows, labels, label)
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in nonempty(batches):
            score = np.full(b.num_rows, 0.5) if model is None else model.score(_matrix(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], names=["row_", "doc_id", "score"])

    scored = rows.mapInArrow(run, f"row_ long, doc_id {kind}, score double")
    return scored.select("row_", "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_rows(documents: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of documents that are predicted to be good, with all their columns.

    Texts are shuffled only to learn from, and only where the labelled ids are too many to be broadcast.
    """
    # statistics of labelled rows only are needed to learn
    known = labels.where(F.col(label).isNotNull() & F.coalesce(fold() != 1, F.lit(False))).select(F.col("doc_id").alias("known_")).distinct()
    learnable = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(checked_broadcast(known), F.col("doc_id") == F.col("known_"), "left_semi")
    model = fit(document_statistics(learnable), labels, label)
    if model is None:
        return documents
    return filtered(documents, lambda texts: model.score(np.array([statistics(t or "") for t in texts])) >= 0.5, text)
