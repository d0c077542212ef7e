"""Operator 2: language identification with string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the number of distinct n-grams of 2 to 4
letters that both hold, over all lengths, divided by the geometric mean of each text's own number. Landmarks (a
bounded sample of training texts) give Nystroem features; a one-versus-rest kernel ridge regression on them
is fitted on a bounded sample of training texts. Texts are scored in batches: presence of the landmarks'
n-grams (texts x n-grams) times the landmarks' presence (n-grams x landmarks) gives the kernel rows, and these
times the ridge weights the languages' scores.

Learned from: rows with text, a non-null lang, a letter and crc32 of the id modulo 3 other than 1. ``PER_LANGUAGE`` rows
of each language are taken at most, those with the smallest hashes of id and text, and ``TEXT_BYTES`` of text in all; the first ``LANDMARKS`` of each, fewer
where the languages' landmarks would be more than ``ALL_LANDMARKS`` together, are landmarks. These bounds are parameters.
Every language counts, and all n-grams of all landmarks are in the kernel. Prediction reads every text whole.

Defined results: null texts and texts without a letter are ``und`` with score 0. Without training rows every text
is ``und``. Of languages with equal scores the first in alphabetical order is predicted. Rows of equal id are predicted each.
A letter is what Unicode calls one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import filtered, fold, held_out, nonempty, prepare

ORDERS = (2, 3, 4)
PER_LANGUAGE, LANDMARKS, ALL_LANDMARKS, RIDGE = 300, 24, 4096, 0.05
#: How far below the lowest hundredth of the learned texts' best scores a text's may be, in parts of what lies between it and
#: their middle, for the text to count as one of a learned language.
SLACK = 0.6
#: Texts scored in one product, bytes of the landmarks' part in it, and characters of a text hashed at once.
ROWS, PRODUCT_BYTES, STRETCH = 64, 32 << 20, 1 << 18
#: Bytes of all texts that are learned from.
TEXT_BYTES = 64 << 20
UNDETERMINED = "und"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


# Every ASCII byte but a-z as a space.
_ASCII = bytes(c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def letters_only(text: str) -> str:
    """The text's letters in lower case, with single spaces for all that stands between them."""
    out = " ".join(text.lower().encode().translate(_ASCII).decode().split())
    if out.isascii() or out.replace(" ", "").isalpha():
        return out
    return " ".join("".join(c if c.isalpha() else " " for c in out).split())


def ngram_hashes(text: str, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Hashes of all n-grams of a text (with repeats), each order apart."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype("u8")
    out = []
    for n in orders:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, "u8")
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * _MULTIPLIER
            h ^= h >> np.uint64(29)
        out.append(h)
    return np.concatenate(out) if out else np.zeros(0, "u8")


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Hashes in order, each once."""
    h = np.sort(hashes)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def distinct_ngrams(text: str) -> np.ndarray:
    """The n-grams of a prepared text with a space at either end."""
    return distinct(ngram_hashes(f" {text} "))


class Table:
    """A hash table of distinct n-grams: an n-gram's column is its place among them. Open addressing, so none is lost."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        self.bits = max(8, int(16 * len(grams)).bit_length())
        self.columns = np.full(1 << self.bits, -1, "i4")
        left, at = np.arange(len(grams)), self._home(grams)
        while len(left):
            free = np.flatnonzero(self.columns[at] < 0)
            self.columns[at[free]] = left[free]  # of several for one slot the last stays
            out = self.columns[at] != left
            left, at = left[out], (at[out] + 1) & (len(self.columns) - 1)

    def _home(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype("i8")

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The columns of those of the n-grams that are in the table."""
        found, at = [], self._home(grams)
        while len(grams):
            column = self.columns[at]
            some = column >= 0
            same = some & (self.grams[column] == grams)
            found.append(column[same])
            on = some & ~same
            grams, at = grams[on], (at[on] + 1) & (len(self.columns) - 1)
        return np.concatenate(found) if found else np.zeros(0, "i4")


@dataclass
class LanguageModel:
    languages: list[str]
    table: Table  # the landmarks' n-grams
    starts: np.ndarray  # n-gram c is held by the landmarks holders[starts[c] : starts[c + 1]]
    holders: np.ndarray
    norms: np.ndarray  # each landmark's number of distinct n-grams
    weights: np.ndarray  # landmarks (and a constant) x languages
    floor: float = -np.inf  # what the best ridge score of a text in a learned language reaches

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel rows of prepared texts against the landmarks, by products over the n-grams that the texts hold."""
        columns, own = [], np.ones(len(texts))
        for i, text in enumerate(texts):
            text = f" {text} "
            # stretches overlap so that no n-gram is lost between them
            parts = [distinct(ngram_hashes(text[max(0, at - max(ORDERS) + 1) : at + STRETCH])) for at in range(0, len(text), STRETCH)]
            grams = parts[0] if len(parts) == 1 else distinct(np.concatenate(parts))
            own[i] = max(1, len(grams))
            columns.append(self.table.find(grams))
        column = np.concatenate(columns)
        used = distinct(column)
        place = np.zeros(len(self.table.grams), "i4")
        place[used] = np.arange(len(used))
        place = place[column]
        row = np.repeat(np.arange(len(texts)), [len(c) for c in columns])
        shared, step = np.zeros((len(texts), len(self.norms))), max(64, PRODUCT_BYTES // (4 * len(self.norms)))
        for lo in range(0, len(used), step):
            part = used[lo : lo + step]
            here = (place >= lo) & (place < lo + step)
            present = np.zeros((len(texts), len(part)), "f4")
            present[row[here], place[here] - lo] = 1
            shared += present @ self._presence(part)
        return shared / np.sqrt(np.outer(own, self.norms))

    def _presence(self, columns: np.ndarray) -> np.ndarray:
        """n-grams x landmarks, 1 where the landmark holds the n-gram."""
        first, count = self.starts[columns], self.starts[columns + 1] - self.starts[columns]
        out, row = np.zeros((len(columns), len(self.norms)), "f4"), np.repeat(np.arange(len(columns)), count)
        out[row, self.holders[np.arange(len(row)) - np.repeat(np.cumsum(count) - count - first, count)]] = 1
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        k = self.kernel(texts)
        return np.hstack([k, np.ones((len(k), 1))]) @ self.weights

    def best(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Languages, scores (softmax of the ridge scores over the languages) and best ridge scores of whole texts."""
        prepared = [letters_only(t or "") for t in texts]
        lang, score, ridge = [UNDETERMINED] * len(texts), [0.0] * len(texts), [-np.inf] * len(texts)
        some = [i for i, t in enumerate(prepared) if t]
        for k in range(0, len(some), ROWS):
            part = some[k : k + ROWS]
            s = self.scores([prepared[i] for i in part])
            e = np.exp(6 * (s - s.max(1, keepdims=True)))
            e /= e.sum(1, keepdims=True)
            for i, j, p, top in zip(part, s.argmax(1).tolist(), e.max(1).tolist(), s.max(1).tolist(), strict=True):
                lang[i], score[i], ridge[i] = self.languages[j], min(1.0, p), top
        return lang, score, ridge

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.best(texts)[:2]


def training_rows(documents: DataFrame, per_language: int, doc_id: str, text: str, lang: str, text_bytes: int = TEXT_BYTES) -> dict[str, list[str]]:
    """Prepared texts by language: for each the rows with the smallest hashes of id and text, ``per_language`` at most, as far as their
    bytes fit into its part of ``text_bytes`` (two rows in any case).

    Rows reach the ranking below a limit that is set, for each language, where enough of its rows lie; repeated rows have one hash, so a
    language of few distinct rows is learned from them all the same.
    """
    spark = documents.sparkSession
    d = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null").where(F.coalesce(fold() != 1, F.lit(False)) & F.col("text").rlike(r"\p{L}"))
    d = d.withColumn("draw", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 30)))
    # the first of 4,096 stretches of hashes that a language has enough rows below
    stretch = F.shiftright("draw", 18)
    counts = d.groupBy("lang", stretch.alias("stretch")).agg(F.count("*").alias("n"))
    below = F.sum("n").over(Window.partitionBy("lang").orderBy("stretch"))
    limits = counts.withColumn("below", below).groupBy("lang").agg(F.coalesce(F.min(F.when(F.col("below") >= per_language, F.col("stretch"))), F.max("stretch")).alias("limit")).collect()
    if not limits:
        return {}
    drawn = d.join(F.broadcast(spark.createDataFrame(limits, "lang string, limit long")), "lang").where(stretch <= F.col("limit"))
    own = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    ranked = drawn.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= per_language)
    sized = ranked.withColumn("bytes", F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("rank")))
    kept = sized.where((F.col("rank") <= 2) | (F.col("bytes") <= text_bytes // len(limits)))
    out: dict[str, list[str]] = {r["lang"]: [] for r in sorted(limits)}
    for r in kept.select("lang", "text").orderBy("lang", "rank").toLocalIterator():
        if t := letters_only(r["text"]):
            out[r["lang"]].append(t)
    return {k: v for k, v in out.items() if v}


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE, all_landmarks: int = ALL_LANDMARKS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel | None:
    """Fit on a bounded sample of the training rows. None if there are none."""
    texts = training_rows(documents, per_language, doc_id, text, lang)
    if not texts:
        return None
    landmarks = min(landmarks, max(2, all_landmarks // len(texts)))
    model = fit_texts(texts, landmarks, ridge)
    model.floor = floor_of(texts, landmarks, ridge)
    return model


def floor_of(texts: dict[str, list[str]], landmarks: int, ridge: float) -> float:
    """What the best ridge score of a text in a learned language reaches: each half of the texts is scored by a fit on the other half."""
    halves = [{k: v[i::2] for k, v in texts.items() if v[i::2]} for i in (0, 1)]
    if not all(halves):
        return -np.inf
    top: list[float] = []
    for known, other in (halves, halves[::-1]):
        model = fit_texts(known, landmarks, ridge)
        top += model.best([t for own in other.values() for t in own])[2]
    low, middle = np.quantile(top, [0.01, 0.5])
    return float(low - SLACK * (middle - low))


def fit_texts(texts: dict[str, list[str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Fit on prepared texts by language."""
    marks = [distinct_ngrams(t) for own in texts.values() for t in own[:landmarks]]
    n, languages = len(marks), len(texts)
    grams, column = np.unique(np.concatenate(marks), return_inverse=True)
    order = np.argsort(column, kind="stable")
    holders = np.repeat(np.arange(n), [len(m) for m in marks])[order].astype("i4")
    starts = np.searchsorted(column[order], np.arange(len(grams) + 1))
    model = LanguageModel(list(texts), Table(grams), starts, holders, np.array([max(1, len(m)) for m in marks], "f8"), np.zeros((n + 1, languages)))
    everything = [(i, t) for i, own in enumerate(texts.values()) for t in own]
    batches = [everything[k : k + ROWS] for k in range(0, len(everything), ROWS)]
    # Nystroem: features K W^(-1/2), with W the kernel among the landmarks
    w = np.vstack([model.kernel([t for own in texts.values() for t in own[:landmarks]][k : k + ROWS]) for k in range(0, n, ROWS)])
    values, vectors = np.linalg.eigh((w + w.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    # rare languages weigh as much as common ones
    size = np.array([len(own) for own in texts.values()])
    share = len(everything) / (languages * size)
    gram, right = np.zeros((root.shape[1] + 1,) * 2), np.zeros((root.shape[1] + 1, languages))
    for part in batches:
        label = np.array([i for i, _ in part])
        f = np.hstack([model.kernel([t for _, t in part]) @ root, np.ones((len(part), 1))])
        weighted = f * share[label][:, None]
        gram += f.T @ weighted
        right += weighted.T @ np.where(label[:, None] == np.arange(languages), 1.0, -1.0)
    solved = np.linalg.solve(gram + ridge * np.eye(len(gram)), right)
    model.weights = np.vstack([root @ solved[:-1], solved[-1:]])
    return model


def identify(documents: DataFrame, model: LanguageModel | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_, doc_id, held_out, lang_pred, score) of every row. Row by row: no shuffle.

    The model holds the landmarks' n-grams; the number of landmarks is bounded by the parameters.
    """
    spark = documents.sparkSession
    prepare(spark)
    kind = dict(documents.dtypes)[doc_id]
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in nonempty(batches):
            m = shared.value
            lang, score = m.predict(b.column(2).to_pylist()) if m else ([UNDETERMINED] * b.num_rows, [0.0] * b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["row_", "doc_id", "lang_pred", "score"])

    rows = documents.select(F.monotonically_increasing_id().alias("row_"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, f"row_ long, doc_id {kind}, lang_pred string, score double")
    return out.select("row_", "doc_id", held_out().alias("held_out"), "lang_pred", "score")


def known_rows(documents: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """The rows of documents in a learned language, with all their columns: their best ridge score reaches the model's floor, which
    is set on the training rows and does not depend on how many languages there are. Texts without a letter go. Without a model
    nothing is known of languages, and all other rows stay."""
    if model is None:
        return documents.where(F.col(text).rlike(r"\p{L}"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def known(texts: list[str | None]) -> list[bool]:
        m = shared.value
        return [top >= m.floor for top in m.best(texts)[2]]

    return filtered(documents, known, text)
