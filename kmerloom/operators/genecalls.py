"""Gene calling with a model trained on the contigs themselves.

Contigs are cut into pieces with margins; every step works on pieces, so a long contig is many tasks. A piece's candidate genes are all frames
from a start codon to the next stop in both strands. What makes them genes is learned in rounds, first from long frames, then from the genes
called: log-odds of hexamers in frame against those of the contigs as a whole, of start codons, and of the motif in front of a start, all counted by task
and summed by Spark (some 8,000 numbers reach the driver). A dynamic programme then picks, in each piece, the chain of genes with the largest sum of
scores; neighbours may overlap by a few letters, which costs. A piece gives the genes that begin in its core. Contigs that fit into one piece
get the best chain there is; in longer ones the margins keep a piece's edges away from what it gives.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codons
from ..plans.tables import written
from .genes import MIN_CONTIG

#: Letters of a piece's core and of each margin; genes longer than a margin are found only where a piece holds them whole.
CORE, MARGIN = 200_000, 30_000
LEAST, LEAST_PARTIAL, LONG, N_RUN = 90, 60, 300, 50
OVERLAP, OVERLAP_COST, HEXAMERS = 60, 0.15, 4096
#: Start codons that genes are called with, where the table has them, and the motif that marks a start: its whole or three to five letters of it, five to ten letters ahead.
START_CODONS, MOTIF, NEAREST, FARTHEST = ("ATG", "GTG", "TTG"), "AGGAGG", 5, 10


@dataclass(frozen=True)
class Settings:
    """table: number of the translation table; closed_ends: no genes run off a contig; mask_n_runs: none runs over 50 N or more; motif: starts are scored by it."""

    table: int = codons.DEFAULT
    closed_ends: bool = False
    mask_n_runs: bool = False
    motif: bool = True
    least: int = LEAST


@dataclass(frozen=True)
class Model:
    hexamers: np.ndarray  # log-odds of a hexamer in frame
    starts: np.ndarray  # of START_CODONS
    motifs: np.ndarray  # of the longest part of the motif: none, 3, 4, 5, 6 letters


@dataclass
class Gene:
    """Places from 0, end behind the last letter, on the given strand's text turned to the forward strand."""

    start: int
    end: int
    strand: str
    score: float
    codon: int  # -1: the frame begins at the contig's edge
    motif: int
    no_stop: bool

    @property
    def partial(self) -> bool:
        return self.codon < 0 or self.no_stop


def pieces(contigs: DataFrame, contig: str, seq: str, core: int = CORE, margin: int = MARGIN) -> DataFrame:
    """(contig, n, at, first, last, text): pieces of contigs of enough letters; at: where the text begins; first, last: the core."""
    n = F.length(seq)
    cut = lambda i: F.struct(F.greatest(i * core - margin, F.lit(0)).alias("at"), (i * core).alias("first"), F.least((i + 1) * core, n).alias("last"), F.substring(F.col(seq), F.greatest(i * core - margin, F.lit(0)) + 1, F.lit(core + margin) + F.least(i * core, F.lit(margin))).alias("text"))
    cuts = F.explode(F.transform(F.sequence(F.lit(0), ((n - 1) / core).cast("int")), cut))
    return contigs.where(n >= MIN_CONTIG).select(F.col(contig).alias("contig"), n.alias("n"), cuts.alias("p_")).select("contig", "n", "p_.*")


_CODE = np.full(256, 4, "u1")
for _i, _letters in enumerate((b"Aa", b"Cc", b"Gg", b"TtUu")):
    _CODE[list(_letters)] = _i


def _number(letters: str) -> int:
    out = 0
    for c in letters:
        out = out * 4 + "ACGT".index(c)
    return out


def _table(k: int, values: dict[str, int], otherwise: int = 0) -> np.ndarray:
    """A value for each window of k letters, and for windows that hold other letters at the end."""
    out = np.full(4**k + 1, otherwise, "i1")
    for letters, v in values.items():
        out[_number(letters)] = v
    return out


#: Letters of other code behind each piece, so many that no window and no look in front of a start reaches the piece before; letters of pieces that are looked at together.
GAP, TOGETHER = FARTHEST + len(MOTIF), 1 << 20
_MOTIFS = {k: _table(k, {MOTIF[i : i + k]: k - 2 for i in range(len(MOTIF) - k + 1)}) for k in range(3, len(MOTIF) + 1)}


@dataclass
class Found:
    """Candidates of a strand of several pieces, in order of frame and place: arrays of equal length."""

    piece: np.ndarray
    start: np.ndarray  # on the strand's own text, from 0
    end: np.ndarray
    score: np.ndarray
    codon: np.ndarray
    motif: np.ndarray
    no_stop: np.ndarray

    def take(self, which: np.ndarray) -> Found:
        return Found(*(v[which] for v in vars(self).values()))


class Strand:
    """One strand of pieces that lie one behind the other at places that three divides: codons, hexamers, starts, stops and motifs by place."""

    def __init__(self, s: np.ndarray, begins: np.ndarray, lengths: np.ndarray, settings: Settings):
        self.begins, self.lengths, self.settings = begins, lengths, settings
        n = len(s)
        window, bad = np.zeros(n, "i2"), np.zeros(n, bool)
        ahead = np.concatenate((s, np.full(len(MOTIF), 5, "u1")))
        ends_in = np.zeros(n + len(MOTIF), "i1")  # by the place behind it: the longest part of the motif
        for k in range(1, 7):
            part = ahead[k - 1 : k - 1 + n]
            window, bad = window * 4 + (part & 3), bad | (part > 3)
            known = np.where(bad, 4**k, window)
            if k == 3:
                starts = {c: i for i, c in enumerate(START_CODONS) if c in codons.starts(settings.table)}
                self.start = _table(3, starts, -1)[known]
                self.stop = _table(3, dict.fromkeys(codons.stops(settings.table), 1))[known].view(bool)
            if k in _MOTIFS:
                behind = ends_in[k : k + n]
                np.maximum(behind, _MOTIFS[k][known], out=behind)
        self.ends_in = ends_in
        self.hexamer = np.where(bad, -1, window)
        self.ends = self.stop
        if settings.mask_n_runs:
            edges = np.flatnonzero(np.diff(np.concatenate(([0], (s == 4).view("i1"), [0])))).reshape(-1, 2)
            self.ends = self.stop.copy()
            for lo, hi in edges[edges[:, 1] - edges[:, 0] >= N_RUN].tolist():
                self.ends[max(lo - 2, 0) : hi] = True

    def motifs(self, at: np.ndarray) -> np.ndarray:
        """Of starts the longest part of the motif that ends five to ten letters before them, in letters less two."""
        out = np.zeros(len(at), "i1")
        for ahead in range(NEAREST, FARTHEST + 1):
            np.maximum(out, np.where(at >= ahead, self.ends_in[np.maximum(at - ahead, 0)], 0), out=out)
        return out

    def sums(self, model: Model) -> np.ndarray:
        """Of each place the sum of the hexamers before it in its frame, from its piece's begin."""
        odds = np.append(model.hexamers, 0.0)[self.hexamer]
        out = np.zeros(len(odds))
        for lo, hi in zip(self.begins.tolist(), [*self.begins[1:].tolist(), len(odds)], strict=True):
            np.cumsum(odds[lo : hi - 3].reshape(-1, 3), 0, out=out[lo + 3 : hi].reshape(-1, 3))
        return out

    def genes(self, model: Model | None, at_left: np.ndarray, at_right: np.ndarray) -> Found:
        """Every candidate. ``at_left`` and ``at_right``: whether pieces begin and end with their contigs. Without a model the score is the length."""
        partial, sums = not self.settings.closed_ends, None if model is None else self.sums(model)
        found = []
        for f in range(3):
            # places of codons in this frame, and the place behind each piece's last
            last = self.begins + f + (self.lengths - f).clip(0) // 3 * 3
            own = np.zeros(len(self.ends[f::3]), bool)
            first_of, last_of = self.begins // 3, last // 3
            for lo, hi in zip(first_of.tolist(), last_of.tolist(), strict=True):
                own[lo:hi] = True
            closed = self.ends[f::3] & own
            marks = closed.copy()
            marks[last_of] = True
            ends = np.flatnonzero(marks)
            at = np.flatnonzero(own & ~closed & (self.start[f::3] >= 0))
            piece, edge = np.searchsorted(first_of, at, "right") - 1, np.zeros(len(at), bool)
            if partial:
                # frames that are open in front: their first codon counts, whatever it is
                front = np.flatnonzero(at_left & (last_of > first_of))
                front = front[~closed[first_of[front]]]
                inner = ~np.isin(at, first_of[front])
                at, piece = np.concatenate((at[inner], first_of[front])), np.concatenate((piece[inner], front))
                edge = np.arange(len(at)) >= inner.sum()
                order = np.argsort(at, kind="stable")
                at, piece, edge = at[order], piece[order], edge[order]
            stop = ends[np.searchsorted(ends, at)]
            behind = stop == last_of[piece]
            kept = np.where(behind, at_right[piece] if partial else False, self.stop[f::3][stop])
            at, stop = at * 3 + f, stop * 3 + f
            end = np.where(behind, stop, stop + 3)
            kept &= end - at >= np.where(edge | behind, LEAST_PARTIAL, self.settings.least)
            at, stop, end, piece, edge, behind = (v[kept] for v in (at, stop, end, piece, edge, behind))
            codon = np.where(edge, -1, self.start[at])
            motif = np.where(edge, 0, self.motifs(at))
            if model is None:
                score = (end - at).astype("f8")
            else:
                # hexamers of two codons before the stop
                inside = sums[np.maximum(stop - 3, at)] - sums[at]
                score = inside + np.where(edge, 0.0, model.starts[codon]) + (np.where(edge, 0.0, model.motifs[motif]) if self.settings.motif else 0.0)
            found.append(Found(piece, at - self.begins[piece], end - self.begins[piece], score, codon, motif, behind))
        return Found(*(np.concatenate([getattr(x, name) for x in found]) for name in vars(found[0])))


class Pieces:
    """Texts that are looked at together. ``at_left`` and ``at_right``: whether each begins and ends with its contig."""

    def __init__(self, texts: list[str], at_left: list[bool], at_right: list[bool], settings: Settings):
        self.settings, self.at_left, self.at_right = settings, np.array(at_left, bool), np.array(at_right, bool)
        self.lengths = np.array([len(t) for t in texts], "i8")
        room = (self.lengths + GAP + 2) // 3 * 3
        self.begins = np.cumsum(room) - room
        within = np.arange(self.lengths.sum()) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        first = np.repeat(self.begins, self.lengths)
        s, mirror = np.full(int(room.sum()), 5, "u1"), np.full(int(room.sum()), 5, "u1")
        own = _CODE[np.frombuffer("".join(texts).encode("latin-1", "replace"), "u1")]
        s[first + within] = own
        mirror[first + np.repeat(self.lengths, self.lengths) - 1 - within] = np.where(own < 4, 3 - own, 4)
        self.strands = {"+": Strand(s, self.begins, self.lengths, settings), "-": Strand(mirror, self.begins, self.lengths, settings)}

    def found(self, model: Model | None) -> dict[str, Found]:
        return {"+": self.strands["+"].genes(model, self.at_left, self.at_right), "-": self.strands["-"].genes(model, self.at_right, self.at_left)}

    def genes(self, found: dict[str, Found]) -> list[list[Gene]]:
        """The candidates of each piece."""
        out: list[list[Gene]] = [[] for _ in self.lengths]
        for strand, x in found.items():
            n = self.lengths[x.piece]
            start, end = (x.start, x.end) if strand == "+" else (n - x.end, n - x.start)
            for p, *values, codon, motif, open_ in zip(*(v.tolist() for v in (x.piece, start, end, x.score, x.codon, x.motif, x.no_stop)), strict=True):
                out[p].append(Gene(values[0], values[1], strand, values[2], codon, motif, open_))
        return out

    def chains(self, model: Model) -> list[list[Gene]]:
        """Each piece's best chain; what scores 0 or less is in none."""
        return [best_chain(own) for own in self.genes({k: x.take(x.score > 0) for k, x in self.found(model).items()})]


def together(rows: Iterator[tuple], settings: Settings) -> Iterator[tuple[Pieces, list[tuple]]]:
    """Pieces (n, at, first, last, text, ...) some at a time."""

    def made(held: list[tuple]) -> tuple[Pieces, list[tuple]]:
        return Pieces([r[4] for r in held], [r[1] == 0 for r in held], [r[1] + len(r[4]) == r[0] for r in held], settings), held

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4])
        if size >= TOGETHER:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def candidates(text: str, model: Model | None, settings: Settings, at_left: bool, at_right: bool) -> list[Gene]:
    """All candidate genes of a piece's text. ``at_left`` and ``at_right``: whether it begins and ends with the contig."""
    own = Pieces([text], [at_left], [at_right], settings)
    return own.genes(own.found(model))[0]


def best_chain(genes: list[Gene]) -> list[Gene]:
    """The chain with the largest sum of scores: each gene begins and ends behind the one before, and overlaps it by less than OVERLAP letters, each of which costs."""
    genes = sorted((g for g in genes if g.score > 0), key=lambda g: (g.end, g.start, g.strand))
    ends = [g.end for g in genes]
    # best so far among the first i genes: (sum, which)
    best_sum, best_at = [0.0], [-1]
    total, back = [0.0] * len(genes), [-1] * len(genes)
    for i, g in enumerate(genes):
        free = bisect_left(ends, g.start + 1, 0, i)
        top, which = best_sum[free], best_at[free]
        for j in range(free, bisect_left(ends, min(g.start + OVERLAP, g.end), 0, i)):
            h = genes[j]
            if h.start < g.start:
                x = total[j] - OVERLAP_COST * (h.end - g.start)
                if x > top:
                    top, which = x, j
        total[i], back[i] = top + g.score, which
        better = total[i] > best_sum[-1]
        best_sum.append(total[i] if better else best_sum[-1])
        best_at.append(i if better else best_at[-1])
    out, at = [], best_at[-1]
    while at >= 0:
        out.append(genes[at])
        at = back[at]
    return out[::-1]


def _longest_first(frames: list[Gene]) -> list[Gene]:
    """The longest first, as long as they overlap none that was taken."""
    taken, starts, ends = [], [], []
    for g in sorted(frames, key=lambda g: (-g.score, g.start, g.strand)):
        k = bisect_left(starts, g.start)
        if (k == 0 or ends[k - 1] <= g.start) and (k == len(starts) or starts[k] >= g.end):
            starts.insert(k, g.start)
            ends.insert(k, g.end)
            taken.append(g)
    return taken


def _long_frames(pieces_: Pieces) -> list[list[Gene]]:
    """Frames to learn from in each piece: of those with one stop the longest."""
    own = replace(pieces_.settings, closed_ends=True, least=LONG)
    longest = {}
    for strand, s in pieces_.strands.items():
        s.settings, none = own, np.zeros(len(s.lengths), bool)
        x = s.genes(None, none, none)
        s.settings = pieces_.settings
        # in order of place, so the first of equal stops is the longest
        longest[strand] = x.take(np.sort(np.unique(np.stack((x.piece, x.end)), axis=1, return_index=True)[1]))
    return [_longest_first(frames) for frames in pieces_.genes(longest)]


_SIZE = 2 * HEXAMERS + 2 * len(START_CODONS) + 2 * (len(MOTIF) - 1)


def _evidence(pieces_: Pieces, first: np.ndarray, last: np.ndarray, model: Model | None) -> np.ndarray:
    """What the pieces' cores tell: hexamers in the frames of genes and of the cores as a whole, start codons and motifs of genes and of all candidates."""
    inside, outside = np.zeros(HEXAMERS), np.zeros(HEXAMERS)
    starts, motifs = np.zeros((2, len(START_CODONS))), np.zeros((2, len(MOTIF) - 1))
    read: dict[str, list[np.ndarray]] = {"+": [], "-": []}
    for p, genes in enumerate(_long_frames(pieces_) if model is None else pieces_.chains(model)):
        n, begin = int(pieces_.lengths[p]), int(pieces_.begins[p])
        for g in genes:
            if not first[p] <= g.start < last[p]:
                continue
            lo, hi = (g.start, g.end) if g.strand == "+" else (n - g.end, n - g.start)
            read[g.strand].append(pieces_.strands[g.strand].hexamer[begin + lo : begin + hi - (3 if g.no_stop else 6) : 3])
            if g.codon >= 0:
                starts[0, g.codon] += 1
                motifs[0, g.motif] += 1
    for name, strand in pieces_.strands.items():
        own = np.concatenate([*read[name], np.zeros(0, "i2")])
        inside += np.bincount(own[own >= 0], minlength=HEXAMERS)
        los, his = (first, last) if name == "+" else (pieces_.lengths - last, pieces_.lengths - first)
        core = np.zeros(len(strand.hexamer), bool)
        for lo, hi in zip((strand.begins + los).tolist(), (strand.begins + his).tolist(), strict=True):
            core[lo:hi] = True
        own = strand.hexamer[core]
        outside += np.bincount(own[own >= 0], minlength=HEXAMERS)
        at = np.flatnonzero(core & (strand.start >= 0))
        starts[1] += np.bincount(strand.start[at], minlength=len(START_CODONS))
        motifs[1] += np.bincount(strand.motifs(at), minlength=len(MOTIF) - 1)
    return np.concatenate([inside, outside, starts.ravel(), motifs.ravel()])


def model_of(sums: np.ndarray) -> Model:
    """Log-odds from summed evidence, with one more count everywhere."""

    def odds(own: np.ndarray, all_: np.ndarray) -> np.ndarray:
        return np.log((own + 1) / (own.sum() + len(own))) - np.log((all_ + 1) / (all_.sum() + len(all_)))

    inside, outside, rest = sums[:HEXAMERS], sums[HEXAMERS : 2 * HEXAMERS], sums[2 * HEXAMERS :]
    starts, motifs = rest[: 2 * len(START_CODONS)].reshape(2, -1), rest[2 * len(START_CODONS) :].reshape(2, -1)
    return Model(odds(inside, outside), odds(*starts), odds(*motifs))


def train(cut: DataFrame, settings: Settings = Settings(), rounds: int = 2) -> Model:
    """A model of the pieces' genes: from long frames first, then, round by round, from the genes that the model before calls."""
    model = None
    for _ in range(rounds):
        now = model

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(_SIZE)
            for own, rows in together((r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True)), settings):
                at, first, last = (np.array([r[i] for r in rows], "i8") for i in (1, 2, 3))
                total += _evidence(own, first - at, last - at, now)
            if total.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(_SIZE)), pa.array(total)], names=["k", "v"])

        sums = np.zeros(_SIZE)
        for k, v in cut.select("n", "at", "first", "last", "text").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            sums[k] = v
        model = model_of(sums)
    return model


def call_genes(contigs: DataFrame, contig: str = "contig", seq: str = "seq", settings: Settings = Settings(), model: Model | None = None, rounds: int = 2, core: int = CORE, margin: int = MARGIN) -> DataFrame:
    """(contig, start, end, strand, partial, start_codon, motif, score) of the genes of all contigs of 96 letters or more.

    Places are 1-based and inclusive on the forward strand. partial has two digits: 1 where the gene runs off the contig on the left, on the right.
    start_codon is null for a gene that runs off in front. ``model`` is trained on the contigs themselves if none is given. Null and shorter contigs have no
    genes. Contigs of equal name are called each.
    """
    if settings.table:
        codons.table(settings.table)
    kind = dict(contigs.dtypes)[contig]
    cut = pieces(contigs, contig, seq, core, margin)
    cut = written(cut.repartition(max(cut.sparkSession.sparkContext.defaultParallelism, int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "contig-pieces")
    model = model or train(cut, settings, rounds)
    schema = f"contig {kind}, start long, end long, strand string, partial string, start_codon string, motif int, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, rows = [], []
            for own, held in together(((*r, k) for k, r in enumerate(zip(*(b.column(j).to_pylist() for j in range(1, 6)), strict=True))), settings):
                for (_, at, first, last, _, k), genes in zip(held, own.chains(model), strict=True):
                    for g in genes:
                        if first <= g.start + at < last:
                            edges = (g.codon < 0, g.no_stop) if g.strand == "+" else (g.no_stop, g.codon < 0)
                            which.append(k)
                            rows.append((g.start + at + 1, g.end + at, g.strand, "".join("01"[e] for e in edges), START_CODONS[g.codon] if g.codon >= 0 else None, g.motif + 2 if g.motif else 0, g.score))
            if rows:
                start, end, strand, partial, codon, motif, score = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(which)), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(strand), pa.array(partial), pa.array(codon, pa.string()), pa.array(motif, pa.int32()), pa.array(score)],
                    names=["contig", "start", "end", "strand", "partial", "start_codon", "motif", "score"])

    return cut.mapInArrow(run, schema)


def gff_lines(genes: DataFrame, source: str = "kmerloom") -> DataFrame:
    """(contig, start, value): a GFF line for each gene, its ID the contig's name and its number there."""
    number = F.row_number().over(Window.partitionBy("contig").orderBy("start", "end", "strand"))
    attributes = F.concat(F.lit("ID="), F.col("contig").cast("string"), F.lit("_"), number.cast("string"), F.lit(";partial="), F.col("partial"), F.lit(";start_type="), F.coalesce("start_codon", F.lit("Edge")))
    value = F.concat_ws("\t", F.col("contig").cast("string"), F.lit(source), F.lit("CDS"), F.col("start").cast("string"), F.col("end").cast("string"), F.format_string("%.1f", "score"), "strand", F.lit("0"), attributes)
    return genes.select("contig", "start", value.alias("value"))
