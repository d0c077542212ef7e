"""Operator 13: repair of conversation structure by a backward cost-to-go programme and a greedy forward walk.

A conversation is sound if the initials of its roles are ``(s?(ua)+)?``. A grammar state says what may come next, and
from every state one role only can be put in: user at the start, after system and after assistant, assistant after
user. Rows are kept (K, 0), given that role (R, 3) or deleted (D, 4), and turns of that role without text are
inserted (I, 3). Blank rows and repeated ones must be deleted, and a truncated row that stays costs 3 more. Backward
over the turns the programme finds the cheapest cost from each state; forward the walk takes, of the edits that the
costs allow, the one that is first in ASCII. An edit and a state have one successor, so the walk's text of edits is the
first in ASCII of all cheapest ones.

Rows are range-partitioned by conversation and turn, so a conversation of any length is spread over tasks. A task
streams its rows; conversations that begin and end inside it are finished there. What may reach over its edges, and
long conversations, becomes pieces of bounded size. Pieces meet as rows of their own: texts seen in earlier pieces by a
join of digests, costs as (min, +) matrices of four states, combined backwards, and the last stream through the pieces
in order, since a digest of the whole text is one sequence by definition. It holds one piece at a time.

Defined results: null roles and texts are one space, so such a text is blank; null turns come first; a null conv_id is
a conversation of its own. Rows of one turn are taken by role, then by the hash of their text. Repeated rows are
duplicates. Roles other than those with initial s, u or a have no place in the grammar and are deleted or rewritten. A
conversation of no rows has zeros, no edits and the digest of the empty text. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import nonempty, prepare, written

#: Rows and characters of a piece, whichever is reached first.
PIECE_ROWS, PIECE_CHARS = 4096, 8 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAR = 1 << 60

SPACE = " \t\n\x0b\x0c\r"
#: The state after the one role that can be put in, and that role: 0 start, 1 after system, 2 after user, 3 after assistant.
AFTER_PUT, PUT = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: The state after a row is kept, by its role's initial; -1: it cannot be kept.
AFTER_KEPT = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
END = (0, 2 * INSERT, INSERT, 0)
UNITS = tuple(tuple(0 if i == j else FAR for i in range(4)) for j in range(4))
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, lost, id_, copy_): rows damaged by crc32 of ``conv_id:turn`` modulo 20, for trials of the repair.

    0 drops the row (``lost``: it only names its conversation), 1 empties its text, 2 takes its sentence ends away, 3
    repeats it, 4 makes its role user.
    """
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(some(conv_id), F.lit(":"), some(turn)).cast("binary")) % 20
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), some(role).alias("role"), some(text).alias("text"), what.alias("what_"), F.monotonically_increasing_id().alias("id_"))
    text_ = F.when(F.col("what_") == 1, "").when(F.col("what_") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("what_") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("what_") == 4, "user").otherwise(F.col("role")).alias("role"), text_.alias("text"), (F.col("what_") == 0).alias("lost"), "id_", copies.alias("copy_"))


def as_rows(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations as they are, in the columns that ``repair`` and ``repaired_turns`` take."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), some(role).alias("role"), some(text).alias("text"), F.lit(False).alias("lost"), F.monotonically_increasing_id().alias("id_"), F.lit(0).alias("copy_"))


# --- the programme: rows are letters, s u a x by the role's initial, upper case if truncated, d if they must go -----------


def _step(code: str, then: tuple[int, ...]) -> tuple[int, int, int, int]:
    """Costs from each state before a row, inserts included, from those after it."""
    if code == "d":
        best = [DELETE + c for c in then]
    else:
        low = code.lower()
        extra, kept = (TRUNCATED if code != low else 0), AFTER_KEPT.get(low)
        best = []
        for q in range(4):
            cost = min(DELETE + then[q], REROLE + extra + then[AFTER_PUT[q]])
            if kept is not None and kept[q] >= 0:
                cost = min(cost, KEEP + extra + then[kept[q]])
            best.append(cost)
    two, three = min(best[2], INSERT + best[3]), min(best[3], INSERT + best[2])
    return min(best[0], INSERT + two), min(best[1], INSERT + two), two, three


def costs(codes: str, end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Cost to go before each row and after the last, by state."""
    out = [end]
    for code in reversed(codes):
        out.append(_step(code, out[-1]))
    out.reverse()
    return out


def walk(codes: str, to_go: list[tuple[int, ...]], state: int, last: bool) -> tuple[str, int]:
    """The edits from ``state`` on, and the state reached; after the last rows of all, inserts that finish the pair."""
    edits, i, n = [], 0, len(codes)
    while i < n or (last and to_go[i][state]):
        need = to_go[i][state]
        put = AFTER_PUT[state]
        if i < n:
            code = codes[i]
            if need == DELETE + to_go[i + 1][state]:
                edits.append("D")
                i += 1
                continue
        if need == INSERT + to_go[i][put]:
            edits.append("I")
            state = put
            continue
        low = code.lower()
        extra, kept = (TRUNCATED if code != low else 0), AFTER_KEPT.get(low)
        if kept is not None and kept[state] >= 0 and need == KEEP + extra + to_go[i + 1][kept[state]]:
            edits.append("K")
            state = kept[state]
        else:
            edits.append("R")
            state = put
        i += 1
    return "".join(edits), state


@lru_cache(maxsize=1 << 16)
def solved(codes: str) -> tuple[int, str]:
    """Cost and edits of a whole conversation; short ones repeat, so they are remembered."""
    to_go = costs(codes, END)
    return to_go[0][0], walk(codes, to_go, 0, True)[0]


def applied(edits: str, state: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each edit."""
    i = 0
    for e in edits:
        if e == "I":
            yield e, PUT[state], ""
            state = AFTER_PUT[state]
            continue
        if e == "K":
            state = AFTER_KEPT[roles[i][:1]][state]
            yield e, roles[i], texts[i]
        elif e == "R":
            yield e, PUT[state], texts[i]
            state = AFTER_PUT[state]
        else:
            yield e, roles[i], texts[i]
        i += 1


def _key(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


class Conversation:
    """Counts, edits and digest of a conversation that comes piece by piece, in order."""

    def __init__(self):
        self.lowest = self.highest = self.turn_before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.rows = 0
        self.cost, self.state, self.role_before, self.begun = None, 0, None, False
        self.edits: list[str] = []
        self.digest = hashlib.sha256()

    def read(self, turns: list, roles: list[str], texts: list[str], seen: set[bytes]) -> str:
        """Count a piece's faults and return its rows as letters. ``seen`` are rows of earlier pieces."""
        codes, here = [], set()
        before = self.role_before
        for turn, role, text in zip(turns, roles, texts, strict=True):
            if turn is not None:
                if self.lowest is None:
                    self.lowest = turn
                self.turns += turn != self.turn_before
                self.highest = self.turn_before = turn
            initial = role[:1]
            if before is not None:
                self.illegal += before + initial not in ("su", "ua", "au")
            before = initial
            kept = text.rstrip(SPACE)
            if not kept:
                self.blank += 1
                codes.append("d")
                continue
            key = (role, text)
            if key in here or (seen and _key(role, text) in seen):
                self.duplicate += 1
                codes.append("d")
                continue
            here.add(key)
            code = initial if initial in ("s", "u", "a") else "x"
            if kept[-1] not in ".!?":
                self.truncated += 1
                code = code.upper()
            codes.append(code)
        self.role_before = before
        self.rows += len(codes)
        return "".join(codes)

    def edit(self, edits: str, roles: list[str], texts: list[str]) -> list[tuple[str, str, str]]:
        out = list(applied(edits, self.state, roles, texts))
        self.edits.append(edits)
        stay = "\n".join([f"{role}:{text}" for e, role, text in out if e != "D"])
        if any(e != "D" for e in edits):
            self.digest.update((("\n" if self.begun else "") + stay).encode("utf-8", "surrogatepass"))
            self.begun = True
        return out

    def whole(self, turns: list, roles: list[str], texts: list[str]) -> list[tuple[str, str, str]]:
        self.cost, edits = solved(self.read(turns, roles, texts, set()))
        return self.edit(edits, roles, texts)

    def piece(self, turns: list, roles: list[str], texts: list[str], seen: set[bytes], end: tuple[int, ...], last: bool) -> list[tuple[str, str, str]]:
        codes = self.read(turns, roles, texts, seen)
        to_go = costs(codes, end)
        if self.cost is None:
            self.cost = to_go[0][0]
        edits, state = walk(codes, to_go, self.state, last)
        out = self.edit(edits, roles, texts)
        self.state = state
        return out

    def result(self) -> list:
        """In the order of COUNTS, then the edits and the digest."""
        gaps = 0 if self.lowest is None else self.highest - self.lowest + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost or 0, "".join(self.edits), self.digest.hexdigest()]


# --- tasks ---------------------------------------------------------------------------------------------------------------


class _Out:
    """Rows gathered into Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.chars = schema, [], 0

    def add(self, row: list, chars: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.chars += chars
        if len(self.rows) >= 4096 or self.chars >= PIECE_CHARS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)], schema=self.schema)
        self.rows, self.chars = [], 0


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows dealt to tasks by ranges of conversation and turn, sorted; equal ones are told apart, so that they can be split, too."""
    keys = ["conv_id", "turn", "role", "hash_", "id_", "copy_"]
    return rows.withColumn("hash_", F.xxhash64("text")).repartitionByRange(*keys).sortWithinPartitions(*keys)


def _pieces(rows: DataFrame, kind: str, turns_too: bool) -> DataFrame:
    """One stream through each task: results of conversations inside it, and pieces of what may reach over its edges."""
    done = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    edited = "edits array<string>, new_roles array<string>, new_texts array<string>"
    schema = f"conv_id {kind}, {done}, {edited}, part_ int, seq_ int, turns array<long>, roles array<string>, texts array<string>"
    conv = rows.select("conv_id").schema
    rows = _in_order(rows).select("conv_id", "turn", "role", "text", "lost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        strings, longs = pa.list_(pa.string()), pa.int64()
        out = _Out(pa.schema([("conv_id", to_arrow_type(conv[0].dataType)), *((c, longs) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("edits", strings), ("new_roles", strings), ("new_texts", strings), ("part_", pa.int32()), ("seq_", pa.int32()), ("turns", pa.list_(longs)), ("roles", strings), ("texts", strings)]))
        part, seq, first = TaskContext.get().partitionId(), 0, True
        now, turns, roles, texts, chars, cut, begun = None, [], [], [], 0, False, False

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal turns, roles, texts, chars, seq
            if whole:
                c = Conversation()
                edits = c.whole(turns, roles, texts)
                lists = [list(x) for x in zip(*edits, strict=True)] or [[], [], []] if turns_too else [None] * 3
                yield from out.add([now, *c.result(), *lists, None, None, None, None, None], chars)
            else:
                yield from out.add([now, *[None] * 11, part, seq, turns, roles, texts], chars)
                seq += 1
            turns, roles, texts, chars = [], [], [], 0

        for b in nonempty(batches):
            for conv_, turn, role, text, lost in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if not begun:
                    now, begun = conv_, True
                elif conv_ != now:
                    yield from flush(not first and not cut)
                    now, first, cut = conv_, False, False
                if not lost:
                    if len(roles) >= PIECE_ROWS or chars >= PIECE_CHARS:
                        yield from flush(False)
                        cut = True
                    turns.append(turn)
                    roles.append(role)
                    texts.append(text)
                    chars += len(text) + len(role)
        if begun:
            yield from flush(False)
        yield from out.flush()

    return rows.mapInArrow(run, schema)


def _joined(pieces: DataFrame, kind: str, turns_too: bool) -> DataFrame:
    """The results of conversations in pieces, in the columns of ``_pieces`` (edits of each piece of their own, if asked for)."""
    pieces = pieces.select("conv_id", F.to_json(F.struct("conv_id")).alias("group_"), "part_", "seq_", "turns", "roles", "texts")
    place = ["group_", "part_", "seq_"]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in nonempty(batches):
            g, p, s, roles, texts = (b.column(k).to_pylist() for k in range(5))
            for k in range(b.num_rows):
                own = list({_key(r, t) for r, t in zip(roles[k], texts[k], strict=True)})
                yield pa.RecordBatch.from_arrays([pa.array([g[k]] * len(own), pa.string()), pa.array([p[k]] * len(own), pa.int32()), pa.array([s[k]] * len(own), pa.int32()), pa.array(own, pa.binary())], names=["group_", "part_", "seq_", "key_"])

    held = written(pieces.select(*place, "roles", "texts").mapInArrow(keys, "group_ string, part_ int, seq_ int, key_ binary"), "turn-keys")
    firsts = held.groupBy("group_", "key_").agg(F.min(F.struct("part_", "seq_")).alias("first_"), F.count("*").alias("n_")).where("n_ > 1").drop("n_")
    late = held.join(firsts, ["group_", "key_"]).where(F.struct("part_", "seq_") > F.col("first_"))
    seen = late.groupBy(*place).agg(F.collect_list("key_").alias("seen_"))
    pieces = written(pieces.join(seen, place, "left"), "pieces")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in nonempty(batches):
            out = []
            for turns, roles, texts, seen in zip(*(b.column(k).to_pylist() for k in range(3, 7)), strict=True):
                codes = Conversation().read(turns, roles, texts, set(seen or ()))
                ends = [costs(codes, unit)[0] for unit in UNITS]
                out.append([min(ends[j][i], FAR) for i in range(4) for j in range(4)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.list_(pa.int64()))], names=["group_", "part_", "seq_", "matrix_"])

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, end = None, END
        for b in nonempty(batches):
            out, last = [], []
            for g, m in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                last.append(g != now)
                if g != now:
                    now, end = g, END
                out.append(list(end))
                end = tuple(min(m[4 * i + j] + end[j] for j in range(4)) for i in range(4))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.list_(pa.int64())), pa.array(last)], names=["group_", "part_", "seq_", "end_", "last_"])

    small = pieces.select(*place, "turns", "roles", "texts", "seen_").mapInArrow(matrices, "group_ string, part_ int, seq_ int, matrix_ array<long>")
    ends = small.repartition("group_").sortWithinPartitions("group_", F.desc("part_"), F.desc("seq_")).mapInArrow(backward, "group_ string, part_ int, seq_ int, end_ array<long>, last_ boolean")
    ends = written(ends, "piece-ends")
    conv = pieces.select("conv_id").schema
    done = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        strings, longs = pa.list_(pa.string()), pa.int64()
        out = _Out(pa.schema([("conv_id", to_arrow_type(conv[0].dataType)), *((c, longs) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("edits", strings), ("new_roles", strings), ("new_texts", strings), ("part_", pa.int32()), ("seq_", pa.int32())]))
        c = Conversation()
        for b in nonempty(batches):
            for conv_, p, s, turns, roles, texts, seen, end, last in zip(*(b.column(k).to_pylist() for k in range(1, 10)), strict=True):
                edits = c.piece(turns, roles, texts, set(seen or ()), tuple(end), last)
                lists = [list(x) for x in zip(*edits, strict=True)] or [[], [], []] if turns_too else [None] * 3
                if last or turns_too:
                    result = c.result() if last else [None] * 8
                    yield from out.add([conv_, *result, *lists, p, s], sum(map(len, texts)) if turns_too else 0)
                if last:
                    c = Conversation()
        yield from out.flush()

    full = pieces.join(ends, place).select("group_", "conv_id", "part_", "seq_", "turns", "roles", "texts", "seen_", "end_", "last_")
    return full.repartition("group_").sortWithinPartitions(*place).mapInArrow(forward, f"conv_id {kind}, {done}, edits array<string>, new_roles array<string>, new_texts array<string>, part_ int, seq_ int")


def _solved(rows: DataFrame, turns_too: bool) -> DataFrame:
    prepare(rows.sparkSession)
    kind = dict(rows.dtypes)["conv_id"]
    found = written(_pieces(rows, kind, turns_too), "conversations")
    columns = ["conv_id", *COUNTS, "audit", "repaired_sha256", "edits", "new_roles", "new_texts", "part_", "seq_"]
    return found.where("part_ is null").select(*columns).unionByName(_joined(found.where("part_ is not null"), kind, turns_too).select(*columns))


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of ``damage`` or ``as_rows``.

    gaps: turns missing between the smallest and the largest; blank, duplicate, truncated: rows by their first fault;
    illegal: neighbours whose roles may not follow each other; audit: the cheapest edits' initials; repaired_sha256:
    of the repaired ``role:text`` rows, joined by line feeds.
    """
    return _solved(rows, False).where(F.col("audit").isNotNull()).select("conv_id", *COUNTS, "audit", "repaired_sha256")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, part, at, edit, role, text): every edit of every conversation in order of part and at; a deleted row with what it held."""
    edits = _solved(rows, True).select("conv_id", F.coalesce(F.col("part_").cast("long") * (1 << 31) + F.col("seq_"), F.lit(0).cast("long")).alias("part"), F.posexplode(F.arrays_zip("edits", "new_roles", "new_texts")).alias("at", "e_"))
    return edits.select("conv_id", "part", F.col("at").cast("long").alias("at"), F.col("e_.edits").alias("edit"), F.col("e_.new_roles").alias("role"), F.col("e_.new_texts").alias("text"))
