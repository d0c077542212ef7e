"""Operator 3: token ids in files of independent zstandard frames with a trailing seek table.

File layout. Every document is one zstandard frame (content size and XXH64 checksum in the frame) that holds
its ids as little-endian unsigned 32-bit integers. The last frame is a skippable one with the seek table. Each
frame, the table's too, is followed by ``PAD``, an empty skippable frame. So a file is a plain sequence of
zstandard frames: any decoder reads all of it, and ``FrameReader`` reads the table from the end and then only
the frames of the documents asked for.

``PAD`` is pure ASCII. That lets Spark's text sink write the files, with ``PAD`` as its line separator: files
go to any file system that Spark writes to and are committed by Spark's own protocol, so lost executors and
repeated attempts leave no partial or doubled file.

Defined results: a null text is the empty text, whose ids are just the end id. A null doc_id sorts first and is
kept as null. Rows with equal doc_id follow one another, ordered by text. An empty table gives files without
documents. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import new_path, nonempty, prepare, texts_of, written

PAD = struct.pack("<II", 0x184D2A50, 0)
TABLE_MAGIC = 0x184D2A5E
FOOTER_MAGIC = b"KLSEEK01"
#: doc_id, offset, frame length, number of ids, low half of the XXH64 of the ids, flags (1: the id is null).
ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("n_tokens", "<u8"), ("checksum", "<u4"), ("flags", "<u4")])
FOOTER = struct.Struct("<Q8s")
#: Bytes of text that go to one file, about.
FILE_TEXT_BYTES = 16 << 20
#: Words that a worker remembers the ids of; beyond it starts anew. Longer words are not remembered.
MEMO_WORDS, MEMO_CHARS = 500_000, 48

#: ASCII punctuation but the apostrophe, with which contractions begin.
PUNCTUATION = rb""" !"#$%&()*+,-./:;<=>?@[\]^_`{|}~""".strip()

#: Texts on which encoding by words must equal encoding whole: case, white space, marks, contractions, digits, special tokens.
PROBES = [a + sep + b for a in ("Hello", "WORLD,", "don't", "it's.", "x1y2", "3.14", "(a)", "né", "ÀB!", "漢字", "🙂", "a-b_c", "'S", "<|x", "<|endoftext|>", "<|ENDOFTEXT|>") for b in ("the end", "ll", "'ll", "...", "?!", "ß", "É,") for sep in (" ", "\n", "\t ", "  \n\n ", "\u00a0")]

_encoders: dict[tuple[str, int], WordEncoder] = {}


class WordEncoder:
    """Ids of texts as bytes, by the tokenizers library.

    If the tokenizer drops white space, none of its tokens spans any, and it lowers letters first, a text's ids
    are those of its lower-case parts between spaces and line feeds, one after another, and each distinct part is
    encoded once. A part that ends in punctuation after a letter is two such parts. New parts of letters alone
    are encoded as one text; each ends with its first id that has the mark of a word's end. Parts with ``<|``
    may hold special tokens, which are told apart by case, so their texts are left as they are. Whether a tokenizer is of
    this kind is read from its description and tried on ``PROBES``; texts are given to any other whole.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), np.array([end_id], "<u4").tobytes()
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.memo: dict[bytes, bytes] = {b"": b""}
        self.by_words = self._is_of_words()

    def _is_of_words(self) -> bool:
        """Whether words can be encoded each on its own."""
        described = json.loads(self.tokenizer.to_str())
        if described["model"].get("end_of_word_suffix") != "</w>" or any(not x["content"].startswith("<|") for x in described.get("added_tokens") or []):
            return False
        whole = self._one_by_one(PROBES)
        return self._by_words(PROBES) == whole and self._by_words(PROBES[::-1]) == whole[::-1]

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encode_new(self, parts: set[bytes], memo: dict[bytes, bytes]) -> None:
        split: dict[bytes, tuple[bytes, bytes]] = {}
        for part in parts:
            core = part.rstrip(PUNCTUATION)
            if core and len(core) < len(part) and b"<|" not in part and 97 <= core[-1] <= 122:
                split[part] = core, part[len(core) :]
        wanted = (parts - split.keys()).union(*split.values()).difference(memo) if split else parts
        plain, rest = [], []
        for part in wanted:
            word = part.decode()
            (plain if word.isalpha() else rest).append((part, word))
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([w for _, w in plain])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(plain) and (not len(ends) or ends[-1] == len(ids)):
                raw, at = ids.tobytes(), 0
                for (part, _), end in zip(plain, (ends * 4).tolist(), strict=True):
                    memo[part] = raw[at:end]
                    at = end
            else:
                rest += plain
        for (part, _), ids in zip(rest, self._one_by_one([w for _, w in rest]), strict=True):
            memo[part] = ids
        for part, (core, tail) in split.items():
            memo[part] = memo[core] + memo[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [ids + self.end for ids in (self._by_words(texts) if self.by_words else self._one_by_one(texts))]

    def _by_words(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > MEMO_WORDS:
            self.memo = {b"": b""}
        split = [(t.encode() if "<|" in t else t.encode().lower()).replace(b"\n", b" ").split(b" ") for t in texts]
        found = [list(map(self.memo.get, words)) for words in split]
        late = [(words, ids, _places_of_none(ids)) for words, ids in zip(split, found, strict=True) if None in ids]
        if late:
            new = {words[i] for words, _, places in late for i in places}
            self._encode_new(new, self.memo)
            for words, ids, places in late:
                for i in places:
                    ids[i] = self.memo[words[i]]
            for word in new:
                if len(word) > MEMO_CHARS:
                    del self.memo[word]
        return list(map(b"".join, found))


def _places_of_none(values: list) -> list[int]:
    """Where a list holds None; found by the list's own search, as most places hold something."""
    places, at = [], -1
    for _ in range(values.count(None)):
        at = values.index(None, at + 1)
        places.append(at)
    return places


def encoder(path: str, end_id: int) -> WordEncoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordEncoder(path, end_id)
    return _encoders[path, end_id]


def seek_table(entries: list[tuple]) -> bytes:
    body = np.array(entries, ENTRY).tobytes() + FOOTER.pack(len(entries), FOOTER_MAGIC)
    return struct.pack("<II", TABLE_MAGIC, len(body)) + body


class FrameReader:
    """Reads single documents of one file, given as bytes or as an open file that can seek."""

    def __init__(self, source):
        self.source = source
        size = len(source) if isinstance(source, (bytes, memoryview)) else source.seek(0, os.SEEK_END)
        count, magic = FOOTER.unpack(self._read(size - len(PAD) - FOOTER.size, FOOTER.size))
        if magic != FOOTER_MAGIC or self._read(size - len(PAD), len(PAD)) != PAD:
            raise ValueError("not a file of token frames, or cut short")
        self.entries = np.frombuffer(self._read(size - len(PAD) - FOOTER.size - count * ENTRY.itemsize, count * ENTRY.itemsize), ENTRY)
        self.decoder = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        if at < 0:
            raise ValueError("not a file of token frames, or cut short")
        if isinstance(self.source, (bytes, memoryview)):
            return bytes(self.source[at : at + n])
        self.source.seek(at)
        return self.source.read(n)

    def __len__(self) -> int:
        return len(self.entries)

    def raw(self, k: int) -> bytes:
        """Bytes of the ids of the file's k-th document; its checksums are held against them."""
        e = self.entries[k]
        out = self.decoder.decompress(self._read(int(e["offset"]), int(e["length"])))
        if len(out) != 4 * int(e["n_tokens"]) or xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != int(e["checksum"]):
            raise ValueError(f"document {k} is damaged")
        return out

    def ids(self, k: int) -> np.ndarray:
        return np.frombuffer(self.raw(k), "<u4")

    def find(self, doc_id: int) -> list[int]:
        """Places in this file of the documents with an id."""
        return np.flatnonzero((self.entries["doc_id"] == doc_id) & (self.entries["flags"] == 0)).tolist()


def write_frames(documents: DataFrame, path: str, tokenizer: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", level: int = 3, file_bytes: int = FILE_TEXT_BYTES) -> None:
    """Encode documents in ascending doc_id order into the folder ``path``, file after file in name order, about ``file_bytes`` of text to each.

    One shuffle, by ranges of doc_id; the ids never leave the task that made them but into the file.
    """
    spark = documents.sparkSession
    prepare(spark)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // file_bytes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer, entries, offset = encoder(tokenizer, end_id), zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True), [], 0
        for b in nonempty(batches):
            frames = []
            for key, ids in zip(b.column(0).to_pylist(), words.encode(texts_of(b, "text")), strict=True):
                frames.append(frame := packer.compress(ids))
                entries.append((key or 0, offset, len(frame), len(ids) // 4, xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF, int(key is None)))
                offset += len(frame) + len(PAD)
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])
        yield pa.RecordBatch.from_arrays([pa.array([seek_table(entries)], pa.binary())], names=["frame"])

    sorted_docs = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    sorted_docs.mapInArrow(run, "frame binary").select(F.col("frame").cast("string")).write.option("lineSep", PAD.decode("ascii")).text(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(part, ord, doc_id, local_start, n_tokens, ids binary) of every document in the files of a folder."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "ord", "doc_id", "local_start", "n_tokens", "ids"]
        for b in nonempty(batches):
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part, reader = int(re.search(r"part-(\d+)", name)[1]), FrameReader(memoryview(content.as_buffer()))
                e = reader.entries
                starts = np.cumsum(e["n_tokens"].astype("i8")) - e["n_tokens"].astype("i8")
                for k in range(0, len(e), 512):
                    rows = e[k : k + 512]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), part, "i8")), pa.array(np.arange(k, k + len(rows), dtype="i8")), pa.array(rows["doc_id"], mask=rows["flags"] == 1), pa.array(starts[k : k + 512]), pa.array(rows["n_tokens"].astype("i8")), pa.array([reader.raw(i) for i in range(k, k + len(rows))], pa.binary())], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, "part long, ord long, doc_id long, local_start long, n_tokens long, ids binary")


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    rows = written(read_frames(spark, path).select("part", "doc_id", "local_start", "n_tokens", F.crc32("ids").alias("ids_crc32")), "digest")
    # One row a file: the running total needs no more than the number of files.
    before = rows.groupBy("part").agg(F.sum("n_tokens").alias("total")).select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    return rows.join(before, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def encode_to_files(documents: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write the documents' token files and return the digest of what was read back from them."""
    spark = documents.sparkSession
    path = path or new_path(spark, "tokens")
    write_frames(documents, path, tokenizer, end_id)
    return file_digest(spark, path)


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
