"""Operator 11 against the two libraries on whole texts and a plain walk over bytes."""

import base64
import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import pytest
from kmerloom.llm import alignment, base
from kmerloom.llm import queries as llm

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row_ int, n_a string, pairs int, pair int, groups int, best int"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    # the same vocabulary as bytes, from its other form
    ranks = {int(i): base64.b64decode(t) for t, i in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    special = {x["id"]: x["content"].encode() for x in json.loads(a.to_str())["added_tokens"]}
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    pieces = [b.id_to_piece(i) for i in range(b.vocab_size())]
    return a, ranks | special, b, [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


def brute(docs, libraries):
    a, a_bytes, b, b_bytes = libraries
    per, counts = [], Counter()
    for doc_id, text in docs:
        if not text:
            per.append((doc_id, 0, 0, 0, Counter(), ""))
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw = (" " + text).encode()
        if b"".join(a_bytes[i] for i in ids_a) != raw or b"".join(b_bytes[i] for i in ids_b) != raw:
            per.append((doc_id, 0, 0, 0, Counter(), ""))
            continue
        spans = []
        for ids, table in ((ids_a, a_bytes), (ids_b, b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(own)
        links, x, y = Counter(), 0, 0
        while x < len(ids_a) and y < len(ids_b):
            links[spans[0][x][2], spans[1][y][2]] += 1
            ea, eb = spans[0][x][1], spans[1][y][1]
            x, y = x + (ea <= eb), y + (eb <= ea)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, before = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for s, t, i in own if before <= s and t <= e) for own in spans) if len(raw) < 3000 else None)
            before = e
        per.append((doc_id, len(ids_a), len(ids_b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if None not in groups else None))
        counts += links
    highest = {}
    for (_, y), c in counts.items():
        highest[y] = max(highest.get(y, 0), c)
    return [(d, x, y, g, sum(k.values()), sum(n for p, n in k.items() if counts[p] == highest[p[1]]), sum(n * counts[p] for p, n in k.items()), h) for d, x, y, g, k, h in per]


def same(df, want):
    rows = sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)
    want = sorted(want, key=str)
    assert [r[:7] for r in rows] == [w[:7] for w in want]
    assert all(w[7] is None or r[7] == w[7] for r, w in zip(rows, want, strict=True))


def test_whole_table(spark, data, libraries):
    docs = [tuple(r) for r in base.table(spark, data, "documents").select("doc_id", "text").collect()]
    same(llm.op11_token_alignment(spark, data), brute(docs, libraries))


ODD = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a   b  ", "a \nb", "a\n b", "a\n  b", "a\n \n  b\n", "\ta\t b", "don't I'll 'S 's", "x1 y22 3.14", "<|endoftext|> <s> </s> <unk>", "<0x41>", "a▁b", "▁", "é漢字 🙂🙂", " a 　b", "\x00", "a\x1cb \x1c c", "a b   c", "İ​ ﻿", "ﬁ Ⅷ ½", "x" * 5000, "word " * 3000, "same", "same"]


def test_odd_texts(spark, libraries):
    rng = random.Random(4)
    pool = ["a", "b", "The", " ", " ", " ", "\n", "\t", "'s", "1", "é", "漢", "🙂", ".", "<", "|", "▁", " ", "\x1f", "\x85", "ing", "hello", "\r\n"]
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "again"), (3, "again")] + [(100 + i, "".join(rng.choice(pool) for _ in range(rng.randint(1, 30)))) for i in range(1500)]
    df = spark.createDataFrame([(*d, 1, "x", 1, 1, 1, 1) for d in docs], SCHEMA).repartition(4)
    same(alignment.link_statistics(df, A, B), brute(docs, libraries))


def test_shuffled_counts(spark, libraries, monkeypatch):
    """The way beyond the broadcast, and a worker that forgets."""
    docs = [(i, f"the same words {i % 7} and others{i}") for i in range(200)]
    monkeypatch.setattr(alignment, "checked_broadcast", lambda df: df)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    same(alignment.link_statistics(df, A, B), brute(docs, libraries))
    own = alignment.Aligner(A, B)
    whole = list(own.align([t for _, t in docs]))
    monkeypatch.setattr(alignment, "MEMO_PARTS", 3)
    again = [next(own.align([t])) for _, t in docs]
    assert [(x[0].tolist(), *x[1:]) for x in whole] == [(x[0].tolist(), *x[1:]) for x in again]


def test_groups_and_empty_table(spark):
    df = spark.createDataFrame([(1, "hello worldly")], "doc_id long, text string")
    row = alignment.aligned(df, A, B).first()
    assert row["groups"].count("|") == row["n_groups"] and sum(row["times"]) >= max(row["n_a"], row["n_b"])
    assert alignment.link_statistics(spark.createDataFrame([], SCHEMA), A, B).count() == 0
