"""Genes: open reading frames on both strands, coding sequences, the minimum contig length."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequence import coding_sequence, reverse_complement
from ..plans.tables import importable, spread

MIN_CONTIG = 96
#: Translation tables that exist.
TABLES = frozenset(range(26)) - {7, 8, 17, 18, 19, 20}


def check_table(number: int) -> int:
    if number not in TABLES:
        raise ValueError(f"there is no translation table {number}")
    return number


def long_contigs(contigs: DataFrame, seq: str = "seq", least: int = MIN_CONTIG) -> DataFrame:
    return contigs.where(F.length(seq) >= least)


#: Codons of open reading frames, and letters of strands that are looked at together.
_STARTS, _STOPS, TOGETHER = ("ATG", "GTG", "TTG"), ("TAA", "TAG", "TGA"), 1 << 20
_CODE = np.full(256, 4, "u1")
_CODE[list(b"ACGT")] = range(4)


def _is(codon: np.ndarray, which: tuple[str, ...]) -> np.ndarray:
    held = np.zeros(5**3, bool)
    held[[sum("ACGT".index(c) * 5 ** (2 - i) for i, c in enumerate(x)) for x in which]] = True
    return held[codon]


def _frames(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which text, first letter from 0, letters) of the open reading frames of all texts."""
    lengths = np.array([len(t) for t in texts], "i8")
    # each text begins at a place that three divides, and three letters at least that are in no codon follow it
    room = (lengths + 5) // 3 * 3
    begins = np.cumsum(room) - room
    s = np.full(int(room.sum()) + 2, 4, "u1")
    own = np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    s[own] = _CODE[np.frombuffer("".join(texts).encode("latin-1", "replace"), "u1")]
    codon = s[:-2] * np.uint8(25) + s[1:-1] * np.uint8(5) + s[2:]
    starts, stops = _is(codon, _STARTS), _is(codon, _STOPS)
    found = []
    for f in range(3):
        at, ends = np.flatnonzero(starts[f::3]), np.flatnonzero(stops[f::3])
        text = np.searchsorted(begins // 3, at, "right") - 1
        nth = np.searchsorted(ends, at)
        inside = nth < len(ends)
        at, text, nth = at[inside], text[inside], nth[inside]
        end = ends[nth]
        # of the starts before a stop the text's first one counts
        keep = end < (begins + room)[text] // 3
        keep[1:] &= (end[1:] != end[:-1]) | (text[1:] != text[:-1])
        keep &= (end - at + 1) * 3 >= least
        found.append((text[keep], at[keep] * 3 + f - begins[text[keep]], (end - at + 1)[keep] * 3))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def open_reading_frames(contigs: DataFrame, contig: str = "contig", seq: str = "seq", least: int = 90) -> DataFrame:
    """(contig, start, end, strand): from each start codon that no earlier start of its frame covers to the next stop, at least ``least`` letters.

    Coordinates are 1-based inclusive on the forward strand. This is the part of gene calling that needs no trained
    model; frames that run off the contig's end are left out. Strands are looked at many together, in arrays.
    """
    importable(contigs.sparkSession)
    strands = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.upper(seq).alias("s")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.col(seq)).alias("s"))))
    rows = spread(contigs).select(contig, F.length(seq).alias("n"), strands.alias("x")).where("x.s is not null").select(contig, "n", "x.strand", "x.s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.cumsum(pc.utf8_length(b.column(3)).to_numpy(zero_copy_only=False)) // TOGETHER
            for lo, hi in itertools.pairwise([*np.flatnonzero(np.diff(sizes, prepend=-1)).tolist(), b.num_rows]):
                text, at, size = _frames(b.column(3).slice(lo, hi - lo).to_pylist(), least)
                which = pa.array(text + lo)
                n, strand = b.column(1).to_numpy()[text + lo], b.column(2).take(which)
                start = np.where(pc.equal(strand, "+").to_numpy(zero_copy_only=False), at + 1, n - at - size + 1)
                yield pa.RecordBatch.from_arrays([b.column(0).take(which), pa.array(start, pa.int64()), pa.array(start + size - 1, pa.int64()), strand], names=[contig, "start", "end", "strand"])

    return rows.mapInArrow(run, T.StructType([contigs.schema[contig], T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("strand", T.StringType())]))


def coding_sequences(genes: DataFrame, contigs: DataFrame, contig: str = "contig", seq: str = "seq") -> DataFrame:
    """``genes`` (contig, start, end, strand, ...) with ``cds``, clipped to the contig; genes without letters are left out."""
    return genes.join(contigs.select(contig, seq), contig).withColumn("cds", coding_sequence(F.col(seq), F.col("start"), F.col("end"), F.col("strand"))).where("cds is not null").drop(seq)


def skipped_contigs(contigs: DataFrame, contig: str = "contig", seq: str = "seq", least: int = MIN_CONTIG) -> DataFrame:
    """(contig, n, warning) of the contigs that are too short to be analysed."""
    n = F.coalesce(F.length(seq), F.lit(0)).cast("long")
    return contigs.where(n < least).select(contig, n.alias("n"), F.concat(F.lit("skipped: "), n.cast("string"), F.lit(f" of at least {least} letters")).alias("warning"))
