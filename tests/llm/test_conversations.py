"""Operator 13 against a plain search over all edits, in one piece and in many."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from kmerloom.llm import base, conversations
from kmerloom.llm import queries as llm
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, part_ int, audit string, hash_ int, lost string, group_ int, gaps int"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        some = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        what = zlib.crc32(f"{some[0]}:{some[1]}".encode()) % 20
        role, text = some[2], some[3]
        if what == 1:
            text = ""
        elif what == 2:
            text = re.sub(r"[.!?]", "", text)
        elif what == 4:
            role = "user"
        out += [] if what == 0 else [(conv, turn, role, text)] * (2 if what == 3 else 1)
    return out


def best(rows):
    """(cost, edits, repaired) by trying every edit; rows are (role, text, fault)."""

    @functools.cache
    def go(i, so_far, inserts):
        found = []
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", so_far):
            found.append((0, "", ()))
        if inserts < 2:
            for role in ("user", "assistant"):
                if viable(so_far + role[0]):
                    c, e, r = go(i, shorter(so_far + role[0]), inserts + 1)
                    found.append((c + 3, "I" + e, ((role, ""), *r)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, e, r = go(i + 1, so_far, 0)
            found.append((c + 4, "D" + e, r))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                for letter, name, cost in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if name[:1] in ("s", "u", "a") and viable(so_far + name[:1]):
                        c, e, r = go(i + 1, shorter(so_far + name[:1]), 0)
                        found.append((c + cost + more, letter + e, ((name, text), *r)))
        return min(found, key=lambda x: x[:2]) if found else (1 << 40, "~", ())

    def viable(initials):
        return re.fullmatch(r"s?(ua)*u?", initials) is not None

    def shorter(initials):
        return re.sub(r"(ua)(ua)+", r"\1", initials)

    return go(0, "", 0)


def brute(rows, tie=lambda r: (r[1] is not None, r[1] or 0)):
    """Per conversation what the query returns, from rows before damage."""
    by = {conv: [] for conv, *_ in rows}
    for r in damaged(rows):
        by[r[0]].append(r)
    out = {}
    for conv, own in by.items():
        own.sort(key=tie)
        turns = [t for _, t, _, _ in own if t is not None]
        seen, marked = set(), []
        for _, _, role, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit, repaired = best(tuple(marked))
        faults = [f for *_, f in marked]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())
    return out


def result(df):
    rows = df.collect()
    assert len(rows) == len({r["conv_id"] for r in rows})
    return {r["conv_id"]: tuple(r[c] for c in (*conversations.COUNTS, "audit", "repaired_sha256")) for r in rows}


def test_whole_table(spark, data):
    rows = [tuple(r) for r in base.table(spark, data, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert result(llm.op13_conversation_repair(spark, data)) == brute(rows)


def generated(n, seed):
    rng = random.Random(seed)
    words = ["Yes.", "No!", "Well", "", " ", "\n", "Is it?", "a b ", "é.", None]
    rows = []
    for conv in range(n):
        turns = sorted(rng.sample(range(30), rng.randint(0, 9)))
        rows += [(conv, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(words)) for t in turns]
    return rows


@pytest.mark.parametrize("size", [4096, 2])
def test_generated(spark, monkeypatch, size):
    rows = generated(200, size) + [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (7_000, None, None, None)]
    monkeypatch.setattr(conversations, "PIECE_ROWS", size)
    df = spark.createDataFrame([(*r, 1, "a", 1, "l", 1, 1) for r in rows], SCHEMA).repartition(5)
    assert result(conversations.repair(conversations.damage(df))) == brute(rows)


def test_one_long_conversation(spark, monkeypatch):
    """A third of all rows in one conversation, over many pieces and tasks, with texts that come again and again."""
    rng = random.Random(1)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"line {rng.randrange(900)}" + rng.choice([".", ""])) for t in range(400)] + [(c, t, "user" if t % 2 == 0 else "assistant", f"text {t}.") for c in range(2, 130) for t in range(6)]
    monkeypatch.setattr(conversations, "PIECE_ROWS", 16)
    df = spark.createDataFrame([(*r, 1, "a", 1, "l", 1, 1) for r in rows], SCHEMA).repartition(7)
    import sys

    sys.setrecursionlimit(10_000)
    want = brute(rows)
    assert result(conversations.repair(conversations.damage(df))) == want
    # the turns themselves give the same digest
    turns = conversations.repaired_turns(conversations.damage(df)).where("conv_id = 1 and edit <> 'D'").orderBy("part", "at").collect()
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in turns).encode()).hexdigest() == want[1][-1]
    edits = conversations.repaired_turns(conversations.damage(df)).where("conv_id = 5").orderBy("part", "at").collect()
    assert "".join(r["edit"] for r in edits) == want[5][-2]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(conversations.damage(empty)).count() == 0
    assert conversations.repaired_turns(conversations.as_rows(empty)).count() == 0
    rows = [(1, 0, "user", "x" * 300_000 + "."), (1, 1, "assistant", "ok."), (2, 0, "user", "Hi."), (2, 0, "user", "Hi."), (2, 0, "user", "Hi.")]
    got = result(conversations.repair(conversations.as_rows(spark.createDataFrame([(*r, 1, "a", 1, "l", 1, 1) for r in rows], SCHEMA))))
    assert got[1][5:7] == (0, "KK") and got[2][2] == 2 and got[2][5:7] == (11, "KDDI")


def test_dropped_conversation(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert result(conversations.repair(conversations.damage(df)))[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert df.select(F.col("conv_id")).count() == 1
