"""Operator 7: SentencePiece encoding and decoding by batched numpy Viterbi.

The model is a byte-pair one: its encoding of a word is not the segmentation with the largest sum of scores but
the one that merges in score order give. That segmentation is also the only one in which any two pieces that
stand together are what the model makes of the two alone. So the Viterbi search here runs over the prefixes of
a word, and a step from piece p to piece q counts 1 if (p, q) is such a pair, and is shut otherwise; the largest
count at a word's end leads back along the only open path. Pairs are decided once each, by merging, and kept in
sorted arrays.

Equal-length words advance together: at every position the hashes of the substrings that end there, one for
each piece length, probe the sorted hashes of the pieces; the open steps' values are compared across lengths,
and the largest is kept with its backpointer. Characters that are no piece stand alone and become byte pieces.
Each distinct word of a batch is searched once and remembered for later batches.

Words are cut where a space mark follows anything else, and wherever two characters meet that no piece has side by
side: no piece spans that.

Defined results: null texts are empty texts and have no ids; decoding gives the text back, but for U+2581, the
model's space mark, which decodes as a space, as the model has it. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import nonempty, prepare, texts_of

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Words that a worker remembers; beyond it starts anew. Longer words are not remembered.
MEMO_WORDS, MEMO_CHARS = 400_000, 64
#: Characters of words searched together; slots for pairs of pieces that are decided.
BATCH_CHARS, PAIR_BITS = 1_000_000, 20
_BASE, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, "i8")
        self.byte_of: dict[int, int] = {}
        usable: dict[str, int] = {}
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                value = int(BYTE.fullmatch(piece)[1], 16)
                self.byte_ids[value], self.byte_of[i] = i, value
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                usable[piece] = i
        if any(MARK in p.lstrip(MARK) for p in usable):
            raise ValueError("pieces of this model span words")
        self.ids, self.score = usable, {p: sp.get_score(i) for p, i in usable.items()}
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.longest = max(map(len, usable))
        # the pieces' hashes by length, sorted, and the id of each
        self.keys: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, "u8"), np.zeros(0, "i8"))]
        for length in range(1, self.longest + 1):
            own = [(p, i) for p, i in usable.items() if len(p) == length]
            codes = np.array([[ord(c) for c in p] for p, _ in own], "u8").reshape(len(own), length)
            h = self._hash(codes)
            order = np.argsort(h)
            self.keys.append((h[order], np.array([i for _, i in own], "i8")[order]))
            if len(np.unique(h)) < len(h):
                raise ValueError("two pieces share a hash")
        self.code_table = np.zeros((n, self.longest), "u8")
        for p, i in usable.items():
            self.code_table[i, : len(p)] = [ord(c) for c in p]
        self.beside = {p[k - 1 : k + 1] for p in usable for k in range(1, len(p))}
        self.pairs: dict[int, bool] = {}
        self.pair_keys, self.pair_open = np.full(1 << PAIR_BITS, -1, "i8"), np.zeros(1 << PAIR_BITS, bool)
        self.memo: dict[str, bytes] = {}

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), "u8")
        for k in range(codes.shape[1]):
            h = h * _BASE + codes[:, k] + np.uint64(1)
        return h

    # merging, for pairs and for what the search leaves open

    def merged(self, text: str) -> list[str]:
        """The pieces of a text by merges in score order, leftmost first among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _open(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the model makes of each two pieces these two again. Below 0 on the left is a word's start or a character that is no piece."""
        key = (np.maximum(left, -1) + 1) * len(self.pieces) + right
        slot = (key.astype("u8") * _SPREAD) >> np.uint64(64 - PAIR_BITS)
        miss = self.pair_keys[slot] != key
        if miss.any():
            for x in np.unique(key[miss]).tolist():
                if x not in self.pairs:
                    a, b = divmod(x, len(self.pieces))
                    b = self.pieces[b]
                    self.pairs[x] = self.merged(b) == [b] if a == 0 else self.merged(self.pieces[a - 1] + b) == [self.pieces[a - 1], b]
            own = key[miss]
            found = np.fromiter(map(self.pairs.__getitem__, own.tolist()), bool, len(own))
            out = self.pair_open[slot]
            out[miss] = found
            # of two pairs in one slot the later stays; what is returned was read before
            self.pair_keys[slot[miss]], self.pair_open[slot[miss]] = own, found
            return out
        return self.pair_open[slot]

    def _candidates(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length the piece that begins at each position of each word, or -1."""
        n, size = codes.shape
        prefix = np.zeros((n, size + 1), "u8")  # hashes of the words' beginnings, modulo 2^64
        for k in range(size):
            prefix[:, k + 1] = prefix[:, k] * _BASE + codes[:, k] + np.uint64(1)
        out, power = [np.zeros((n, 0), "i4")], np.ones(1, "u8")
        for length in range(1, min(size, self.longest) + 1):
            power = power * _BASE
            keys, ids = self.keys[length]
            found = np.full((n, size - length + 1), -1, "i4")
            if len(keys):
                h = prefix[:, length:] - prefix[:, : size - length + 1] * power
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                row, start = np.nonzero(keys[at] == h)
                piece = ids[at[row, start]]
                # a hash only finds the piece; its characters decide
                same = (self.code_table[piece, :length] == codes[row[:, None], start[:, None] + np.arange(length)]).all(1)
                found[row[same], start[same]] = piece[same]
            out.append(found)
        return out

    def _search(self, words: list[str]) -> list[bytes | None]:
        """Ids, as bytes, of words of one length; None where the search finds no path or a character is no piece."""
        n, size = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(n, size).astype("u8")
        at = self._candidates(codes)
        value = np.full((size + 1, n), -1, "i4")  # pieces on the open path to each position; -1: none
        last = np.full((size + 1, n), -1, "i8")  # the piece that ends there
        back = np.zeros((size + 1, n), "i4")  # its length
        value[0] = 0
        for end in range(1, size + 1):
            for length in range(1, min(end, self.longest) + 1):
                start = end - length
                piece = at[length][:, start]
                rows = np.flatnonzero((piece >= 0) & (value[start] >= value[end]) & (value[start] >= 0))
                if len(rows):
                    piece = piece[rows].astype("i8")
                    good = self._open(last[start, rows], piece)
                    rows, piece = rows[good], piece[good]
                    value[end, rows], last[end, rows], back[end, rows] = value[start, rows] + 1, piece, length
        # every word's path backwards, all words a step at a time
        ids = np.zeros((n, size), "<u4")
        end, column, all_rows = np.full(n, size), np.full(n, size), np.arange(n)
        live = all_rows[value[size] > 0]
        while len(live):
            column[live] -= 1
            ids[live, column[live]] = last[end[live], live]
            end[live] -= back[end[live], live]
            live = live[end[live] > 0]
        raw, whole = ids.tobytes(), value[size] > 0
        return [raw[4 * (k * size + c) : 4 * (k + 1) * size] if ok else None for k, (c, ok) in enumerate(zip(column.tolist(), whole.tolist(), strict=True))]

    def _by_merging(self, word: str) -> bytes:
        """The ids of a word by the merges themselves; characters that are no piece become byte pieces."""
        out: list[int] = []
        for piece in self.merged(word):
            i = self.ids.get(piece)
            out.extend(self.byte_ids[list(piece.encode())].tolist() if i is None else [i])
        return np.array(out, "<u4").tobytes()

    def _cut(self, word: str) -> list[str]:
        """The word in parts between which no piece reaches: no piece has the two characters side by side."""
        out, at, beside = [], 0, self.beside
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in beside:
                out.append(word[at:k])
                at = k
        out.append(word[at:])
        return out

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """The ids, as bytes, of distinct words."""
        cuts = {w: self._cut(w) for w in words}
        by_length: dict[int, list[str]] = {}
        for w in set().union(*cuts.values()).difference(self.memo):
            by_length.setdefault(len(w), []).append(w)
        part_ids: dict[str, bytes] = {}
        for length, own in by_length.items():
            step = max(1, BATCH_CHARS // length)
            for k in range(0, len(own), step):
                part = own[k : k + step]
                for w, ids in zip(part, self._search(part), strict=True):
                    part_ids[w] = self._by_merging(w) if ids is None else ids
        memo = self.memo
        return {w: b"".join([part_ids[p] if p in part_ids else memo[p] for p in parts]) for w, parts in cuts.items()} | {w: ids for w, ids in part_ids.items() if w not in cuts}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        split = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        found = [list(map(self.memo.get, words)) for words in split]
        late = [k for k, ids in enumerate(found) if None in ids]
        if late:
            self.memo |= self.encode_words({w for k in late for w, ids in zip(split[k], found[k], strict=True) if ids is None})
            for k in late:
                found[k] = list(map(self.memo.__getitem__, split[k]))
            for w in [w for k in late for w in split[k] if len(w) > MEMO_CHARS]:
                self.memo.pop(w, None)
        return [b"".join(ids) for ids in found]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: byte pieces become their bytes (malformed ones U+FFFD), marks become spaces, the first is dropped."""
        out = bytearray()
        for i in ids.tolist():
            if i in self.byte_of:
                out.append(self.byte_of[i])
            elif i not in self.silent:
                out += self.pieces[i].encode()
        text = out.decode("utf-8", errors="replace").replace(MARK, " ")
        return text.removeprefix(" ")


def encode_documents(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids array) of every row. Row by row: no shuffle."""
    prepare(documents.sparkSession)
    kind = dict(documents.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in nonempty(batches):
            ids = [np.frombuffer(x, "<u4").astype("i4") for x in model(path).encode(texts_of(b, "text"))]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets), pa.int64()), lists], names=["doc_id", "n_tokens", "ids"])

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) of every row of ids. Null ids give ''."""
    prepare(encoded.sparkSession)
    kind = dict(encoded.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in nonempty(batches):
            texts = [model(path).decode(np.array(x.as_py() or [], "i8")) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def digest(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, text_crc32, round_trip) of every row: its ids encoded, and decoded again in the same task.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers, text_crc32 over the decoded text.
    """
    prepare(documents.sparkSession)
    kind = dict(documents.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in nonempty(batches):
            m, texts = model(path), texts_of(b, "text")
            ids = m.encode(texts)
            back = [m.decode(np.frombuffer(x, "<u4")) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(zlib.crc32, ids), pa.int64()), pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()), pa.array([t.replace(MARK, " ") == u for t, u in zip(texts, back, strict=True)])],
                names=["doc_id", "n_tokens", "ids_crc32", "text_crc32", "round_trip"])

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_crc32 long, text_crc32 long, round_trip boolean")
