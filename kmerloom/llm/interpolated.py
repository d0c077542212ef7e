"""Operator 12: language-model scores by deleted interpolation of n-gram estimates.

The probability of a token is a nest of mixtures: at each order the maximum-likelihood estimate count / context count,
mixed with the next lower order, down to one share for each known word and one for all others. How much an order
weighs depends on the bucket (a power of two) that its context's count falls into. The weights are learned by
expectation-maximisation on counts held out from the estimates: one fold of the training documents is deleted from all
counts, and its tokens are predicted from what is left. Scores then use the counts of all training documents.

How it runs. Documents are read once into chunks of some megabytes, with local word numbers. A chunk sends the sorted
distinct keys of its n-grams to buckets by their top bits, as differences of few bytes, so an n-gram leaves a
chunk once however often it stands there. Keys of single words have 64 bits, those of longer n-grams 56: among ten thousand million of
these some hundreds share a key and are counted together. A bucket adds up its keys' counts and answers each chunk. Chunk and answers meet, and
every token has its counts. No task holds more than a chunk or a bucket; the number of buckets follows the tokens. Keys are
hashed, so no n-gram is hot. The driver gets two totals and the cells of the held-out fold: estimates by whole octaves,
whose number does not depend on the input. Chunks of more bytes make fewer, larger messages where the corpus is very large.

Defined results: null texts are empty ones, which are their end alone. Rows of equal doc_id are scored each; a null
doc_id belongs to training. Equal texts of one side have equal scores. Without training documents every count is 0 and each token
has probability 1. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import nonempty, prepare, texts_of, written

ORDER, CHUNK_BYTES, BUCKET_KEYS = 3, 8 << 20, 3_000_000
MODULUS, HELD_OUT, DELETED = 7, 2, 3
#: Buckets of context counts: 0, 1, 2-3, 4-7 and so on; the last holds all above.
LEVELS, OCTAVES, ROUNDS = 24, 32, 300
TRAIN, DELETE, TEST = 0, 1, 2
_END, _BEGIN = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" end", b" begin"))
_P1, _P2, _P3, _33 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD), np.uint64(33)


# --- numbers as few bytes --------------------------------------------------------------------------------------------


def pack_sorted(keys: np.ndarray) -> bytes:
    """Rising 64-bit keys: the first, then differences of as many bytes as the largest takes."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + keys[:1].tobytes() + np.ascontiguousarray(steps.view("u1").reshape(-1, 8)[:, :width]).tobytes()


def unpack_sorted(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, "u8")
    width = packed[0]
    steps = np.frombuffer(packed, "u1", offset=9).reshape(-1, width)
    out = np.zeros((len(steps) + 1, 8), "u1")
    out[1:, :width] = steps
    out[0] = np.frombuffer(packed, "u1", 8, 1)
    return np.cumsum(out.view("<u8").ravel(), dtype="u8")


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts below 255 as a byte each; the others follow."""
    return np.minimum(counts, 255).astype("u1").tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def unpack_counts(packed: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(packed, "u1", n).astype("i8")
    out[out == 255] = np.frombuffer(packed, "<i8", offset=n)
    return out


# --- chunks ----------------------------------------------------------------------------------------------------------


def words_of(text: str) -> list[bytes]:
    """Lower-case A-Z, then cut at the six ASCII white-space bytes: what split() of bytes does."""
    return text.encode().lower().split()


class _Held:
    """Documents of a chunk to be: their words as numbers in order of appearance."""

    def __init__(self):
        self.doc_ids, self.lengths, self.index, self.ids, self.size = [], [], {}, array("I"), 0

    def add(self, doc_id, text: str) -> None:
        words, index = words_of(text), self.index
        self.ids.extend([index.setdefault(w, len(index)) for w in words])
        self.doc_ids.append(doc_id)
        self.lengths.append(len(words))
        self.size += len(text) + 64

    def columns(self) -> tuple[bytes, list[bytes]]:
        """The distinct words, most frequent first, and the number of each word in byte planes; both compressed."""
        ids, words = np.frombuffer(self.ids, "u4"), sorted(self.index)
        by_word = np.fromiter(map(self.index.__getitem__, words), "i8", len(words))
        counts = np.bincount(ids, minlength=len(words))
        by_count = np.argsort(-counts[by_word], kind="stable")
        place = np.empty(len(words), "<u4")
        place[by_word[by_count]] = np.arange(len(words), dtype="<u4")
        planes = place[ids].view("u1").reshape(-1, 4)
        z = zstandard.ZstdCompressor(level=1)
        return z.compress(b"\n".join([words[i] for i in by_count.tolist()])), [z.compress(np.ascontiguousarray(planes[:, k]).tobytes()) for k in range(4)]


def chunks(documents: DataFrame, doc_id: str, text: str, chunk_bytes: int) -> DataFrame:
    """(chunk, side, doc_ids, lengths, words, ids): documents of one side (train, delete, test) in chunks. Row by row: no shuffle."""
    prepare(documents.sparkSession)
    kind = dict(documents.dtypes)[doc_id]
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % MODULUS
    side = F.when(fold == HELD_OUT, TEST).when(fold == DELETED, DELETE).otherwise(TRAIN)
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), side.alias("side"))
    id_type = rows.select("doc_id").schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        id_list, part, seq = pa.list_(to_arrow_type(id_type)), TaskContext.get().partitionId() << 32, 0
        held = [_Held() for _ in range(3)]

        def flush(s: int) -> pa.RecordBatch:
            nonlocal seq
            own, held[s] = held[s], _Held()
            words, planes = own.columns()
            seq += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([part + seq], pa.int64()), pa.array([s], pa.int32()), pa.array([own.doc_ids], id_list), pa.array([own.lengths], pa.list_(pa.int64())), pa.array([words], pa.binary()), pa.array([planes], pa.list_(pa.binary()))],
                names=["chunk", "side", "doc_ids", "lengths", "words", "planes"])

        for b in nonempty(batches):
            for i, t, s in zip(b.column(0).to_pylist(), texts_of(b, "text"), b.column(2).to_pylist(), strict=True):
                held[s].add(i, t)
                if held[s].size >= chunk_bytes:
                    yield flush(s)
        for s in range(3):
            if held[s].doc_ids:
                yield flush(s)

    return rows.mapInArrow(run, f"chunk long, side int, doc_ids array<{kind}>, lengths array<long>, words binary, planes array<binary>")


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _P1 + b * _P2
    x ^= x >> _33
    x *= _P3
    return (x ^ (x >> _33)) >> np.uint64(8)


class Tokens:
    """A chunk's documents as n-gram keys: each padded with order - 1 marks in front and one end behind."""

    def __init__(self, lengths: np.ndarray, words: bytes, planes: list[bytes], order: int):
        z = zstandard.ZstdDecompressor()
        n = int(lengths.sum())
        ids = np.stack([np.frombuffer(z.decompress(p), "u1") for p in planes], axis=1).copy().view("<u4").ravel() if n else np.zeros(0, "u4")
        own = z.decompress(words).split(b"\n")
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, own), "u8", len(own))
        d = len(lengths)
        shift = order - 1 + np.arange(d) * order
        seq = np.full(n + d * order, _BEGIN, "u8")
        seq[np.arange(n) + np.repeat(shift, lengths)] = hashes[ids] if n else 0
        ends = np.cumsum(lengths) + shift
        seq[ends] = _END
        self.order, self.starts = order, ends - lengths - (order - 1)
        place = np.arange(len(seq)) - np.repeat(self.starts, lengths + order)
        #: places of tokens, end included
        self.real = np.flatnonzero(place >= order - 1).astype("i4" if len(seq) < 1 << 31 else "i8")
        #: for each order the places that count as its events; the last mark does so for all but the highest
        marked = np.flatnonzero(place >= max(order - 2, 0)).astype(self.real.dtype) if order > 1 else self.real
        self.events = [marked if m < order else self.real for m in range(1, order + 1)]
        keys = [seq]
        for _ in range(1, order):
            k = np.zeros_like(seq)
            k[1:] = _mixed(keys[-1][:-1], seq[1:])
            keys.append(k)
        self.keys = [k[e] for k, e in zip(keys, self.events, strict=True)]
        self.length = len(seq)

    def counted(self, counts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """Order by order, each token's count and its context's (none at the lowest), from the counts of the order's sorted distinct keys.

        Keys are given up on the way, so a chunk's arrays are held for one order at a time.
        """
        before = None
        for m, c in enumerate(counts):
            full = np.zeros(self.length, "i8")
            full[self.events[m]] = c[np.unique(self.keys[m], return_inverse=True)[1]]
            self.keys[m] = self.events[m] = None
            yield full[self.real], None if before is None else before[self.real - 1]
            before = full


def _tokens(b: pa.RecordBatch | pa.Table, k: int, order: int) -> Tokens:
    return Tokens(np.array(b.column("lengths")[k].as_py(), "i8"), b.column("words")[k].as_py(), b.column("planes")[k].as_py(), order)


def _messages(rows: DataFrame, order: int, bits: int) -> DataFrame:
    """(order_, bucket, chunk, side, keys, counts): a chunk's distinct keys of each order, cut by their top bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = [np.arange(1, 1 << bits, dtype="u8") << np.uint64(size - bits) if bits else np.zeros(0, "u8") for size in (64, *[56] * (order - 1))]
        for b in nonempty(batches):
            for k in range(b.num_rows):
                chunk, side = b.column("chunk")[k].as_py(), b.column("side")[k].as_py()
                for m, keys in enumerate(_tokens(b, k, order).keys, 1):
                    own, n = np.unique(keys, return_counts=True)
                    cuts = [0, *np.searchsorted(own, edges[m - 1]).tolist(), len(own)]
                    parts = [(i, lo, hi) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if hi > lo]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([m] * len(parts), pa.int32()), pa.array([i for i, *_ in parts], pa.int32()), pa.array([chunk] * len(parts), pa.int64()), pa.array([side] * len(parts), pa.int32()), pa.array([pack_sorted(own[lo:hi]) for _, lo, hi in parts], pa.binary()), pa.array([pack_counts(n[lo:hi]) for _, lo, hi in parts], pa.binary())],
                        names=["order_", "bucket", "chunk", "side", "keys", "counts"])

    return rows.select("chunk", "side", "lengths", "words", "planes").mapInArrow(run, "order_ int, bucket int, chunk long, side int, keys binary, counts binary")


def _answers(messages: DataFrame) -> DataFrame:
    """(chunk, side, order_, bucket, n, totals, deleted) of each message: its keys' counts in training, and in the deleted fold. Chunk -1 says how many words there are."""
    schema = "chunk long, side int, order_ int, bucket int, n long, totals binary, deleted binary"

    def answer(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        sides = t.column("side").to_pylist()
        keys = [unpack_sorted(x) for x in t.column("keys").to_pylist()]
        sizes = [len(k) for k in keys]
        n = np.concatenate([unpack_counts(x, s) for x, s in zip(t.column("counts").to_pylist(), sizes, strict=True)])
        known, at = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        side = np.repeat(sides, sizes)
        totals = np.bincount(at, np.where(side != TEST, n, 0), len(known)).astype("i8")
        deleted = np.bincount(at, np.where(side == DELETE, n, 0), len(known)).astype("i8")
        ends = np.cumsum(sizes)
        cut = [at[e - s : e] for e, s in zip(ends.tolist(), sizes, strict=True)]
        order, bucket = t.column("order_")[0].as_py(), t.column("bucket")[0].as_py()
        words = int((totals > 0).sum()) - int((totals[known == _BEGIN] > 0).sum()) if order == 1 else 0
        return pa.table(
            [pa.array([-1, *t.column("chunk").to_pylist()], pa.int64()), pa.array([-1, *sides], pa.int32()), pa.array([order] * (len(cut) + 1), pa.int32()), pa.array([bucket] * (len(cut) + 1), pa.int32()), pa.array([words, *sizes], pa.int64()), pa.array([b"", *(pack_counts(totals[a]) for a in cut)], pa.binary()), pa.array([b"", *(pack_counts(deleted[a]) if s == DELETE else b"" for a, s in zip(cut, sides, strict=True))], pa.binary())],
            names=["chunk", "side", "order_", "bucket", "n", "totals", "deleted"])

    return messages.groupBy("order_", "bucket").applyInArrow(answer, schema)


def _answered(t: pa.Table, column: str, order: int) -> list[np.ndarray]:
    """By order, the counts of a chunk's sorted distinct keys: its answers in the order of buckets."""
    by: list[list] = [[] for _ in range(order)]
    for m, bucket, n, packed in zip(*(t.column(c).to_pylist() for c in ("order_", "bucket", "n", column)), strict=True):
        by[m - 1].append((bucket, n, packed))
    return [np.concatenate([unpack_counts(p, n) for _, n, p in sorted(x)]) for x in by]


# --- weights ---------------------------------------------------------------------------------------------------------


def level(context: np.ndarray) -> np.ndarray:
    """The bucket of a context's count."""
    return np.where(context > 0, np.minimum(1 + np.log2(np.maximum(context, 1)).astype("i8"), LEVELS - 1), 0)


@dataclass
class Model:
    tokens: int  # of training, ends included
    words: int  # distinct ones
    weights: list[np.ndarray]  # from the second order on, by bucket; first the lowest order's one weight

    def probability(self, found: Iterator[tuple[np.ndarray, np.ndarray | None]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Order by order, each token's count and its probability so far, from what ``Tokens.counted`` gives."""
        p = 1 / (self.words + 1)
        for w, (count, context) in zip(self.weights, found, strict=True):
            own = w[0] if context is None else w[level(context)]
            p = own * (count / (max(self.tokens, 1) if context is None else np.maximum(context, 1))) + (1 - own) * p
            yield count, p


def mixture(estimates: list[np.ndarray], levels: list[np.ndarray], weights: list[np.ndarray], floor: float) -> list[np.ndarray]:
    """The probability at each order, from the floor up."""
    out = [np.full(len(estimates[0]), floor)]
    for f, at, w in zip(estimates, levels, weights, strict=True):
        out.append(w[at] * f + (1 - w[at]) * out[-1])
    return out


def learned(n: np.ndarray, estimates: list[np.ndarray], levels: list[np.ndarray], floor: float, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Weights that make ``n`` held-out tokens of each kind likely, by expectation-maximisation.

    One more token, half of it in favour, keeps every weight off 0 and 1; a context that was never seen has weight 0.
    """
    sizes = [1, *[LEVELS] * (len(estimates) - 1)]
    weights = [np.full(s, 0.5) for s in sizes]
    for w in weights[1:]:
        w[0] = 0
    for _ in range(rounds):
        below = mixture(estimates, levels, weights, floor)
        reach, moved = n.astype("f8"), 0.0
        for m in range(len(estimates) - 1, -1, -1):
            w, at = weights[m], levels[m] if m else np.zeros(len(n), "i8")
            own = reach * w[at] * estimates[m] / below[m + 1]
            new = (np.bincount(at, own, sizes[m]) + 0.5) / (np.bincount(at, reach, sizes[m]) + 1)
            if m:
                new[0] = 0
            moved = max(moved, float(np.abs(new - w).max()))
            weights[m], reach = new, reach - own
        if moved < 1e-9:
            break
    return weights


def _cells(counts: list[np.ndarray], contexts: list[np.ndarray], tokens: int) -> pa.Table:
    """Tokens of a deleted chunk gathered by the buckets of their contexts and the octaves of their estimates, with the sums of the estimates."""
    estimates = [counts[0] / max(tokens, 1), *(c / np.maximum(x, 1) for c, x in zip(counts[1:], contexts, strict=True))]
    key = np.zeros(len(counts[0]), "i8")
    for f in estimates:
        key = key * (OCTAVES + 1) + np.where(f > 0, np.minimum(-np.log2(np.maximum(f, 1e-300)), OCTAVES - 1).astype("i8"), OCTAVES)
    for x in contexts:
        key = key * LEVELS + level(x)
    known, at = np.unique(key, return_inverse=True)
    sums = [np.bincount(at, f, len(known)) for f in estimates]
    return pa.table([pa.array(known), pa.array(np.bincount(at, minlength=len(known)).astype("i8")), pa.FixedSizeListArray.from_arrays(pa.array(np.stack(sums, axis=1).ravel()), len(sums)).cast(pa.list_(pa.float64()))], names=["cell", "n", "sums"])


def _fit(chunk_rows: DataFrame, answers: DataFrame, order: int) -> Model:
    tokens, deleted = chunk_rows.agg(*(F.coalesce(F.sum(F.when(c, F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x + 1))), F.lit(0)) for c in (F.col("side") != TEST, F.col("side") == DELETE))).first()
    words = answers.where("chunk = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    left = tokens - deleted

    def gather(key, own: pa.Table, theirs: pa.Table) -> pa.Table:
        rest = [a - b for a, b in zip(*(_answered(theirs, c, order) for c in ("totals", "deleted")), strict=True)]
        counts, contexts = zip(*_tokens(own, 0, order).counted(rest), strict=True)
        return _cells(list(counts), list(contexts[1:]), left)

    pairs = chunk_rows.where(F.col("side") == DELETE).select("chunk", "lengths", "words", "planes").groupBy("chunk").cogroup(answers.where(F.col("side") == DELETE).select("chunk", "order_", "bucket", "n", "totals", "deleted").groupBy("chunk"))
    cells = pairs.applyInArrow(gather, "cell long, n long, sums array<double>")
    rows = cells.groupBy("cell").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(m))).alias(f"s{m}") for m in range(order))).toPandas()
    cell, n = rows["cell"].to_numpy("i8"), rows["n"].to_numpy("i8")
    levels = []
    for _ in range(order - 1):
        cell, at = np.divmod(cell, LEVELS)
        levels.insert(0, at)
    estimates = [rows[f"s{m}"].to_numpy("f8") / np.maximum(n, 1) for m in range(order)]
    if not tokens:
        return Model(0, 0, [np.zeros(1), *[np.zeros(LEVELS)] * (order - 1)])
    return Model(tokens, words, learned(n, estimates, [np.zeros(1, "i8"), *levels], 1 / (words + 1)))


# --- the operator ------------------------------------------------------------------------------------------------------


def score_documents(documents: DataFrame, order: int = ORDER, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from documents whose crc32 of the id modulo 7 is not 2. base_score is the add-one unigram log10 probability, score that of the
    interpolated model of ``order``.
    """
    kind = dict(documents.dtypes)[doc_id]
    chunk_rows = written(chunks(documents, doc_id, text, chunk_bytes), "chunks")
    every = chunk_rows.agg(F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x + 2)), F.lit(0))).first()[0]
    bits = max(0, int(every - 1) // bucket_keys).bit_length()
    answers = written(_answers(_messages(chunk_rows, order, bits)), "answers")
    model = _fit(chunk_rows, answers, order)
    id_type = documents.select(doc_id).schema[0].dataType

    def score(key, own: pa.Table, theirs: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_type

        lengths = np.array(own.column("lengths")[0].as_py(), "i8") + 1
        firsts, n, sums = np.cumsum(lengths) - lengths, len(lengths), []
        for count, p in model.probability(_tokens(own, 0, order).counted(_answered(theirs, "totals", order))):
            if not sums:
                sums = [np.add.reduceat(x, firsts) for x in ((count > 0).astype("i8"), np.log10((count + 1) / (model.tokens + model.words + 1)))]
        known, base, scores = *sums, np.add.reduceat(np.log10(p), firsts)
        return pa.table(
            [pa.array(own.column("doc_ids")[0].as_py(), to_arrow_type(id_type)), pa.array([own.column("side")[0].as_py() == TEST] * n), pa.array(lengths), pa.array(known), pa.array([model.tokens] * n, pa.int64()), pa.array(base), pa.array(scores)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    pairs = chunk_rows.groupBy("chunk").cogroup(answers.where("chunk >= 0").select("chunk", "order_", "bucket", "n", "totals").groupBy("chunk"))
    return pairs.applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
