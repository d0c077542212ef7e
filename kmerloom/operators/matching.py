"""k-mers that an index may have: windows are hashed in arrays, and only those whose hash a k-mer of the index has become rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.letters import codes_of, complete, groups, mixed, window_hashes
from ..plans.tables import importable, spread

#: Places of a table that is asked before the sorted hashes.
TABLE_BITS = 20


def _hashes(codes: np.ndarray, k: int, flank: int | None) -> np.ndarray:
    """Of each window of ``k`` letters, or of its first and last ``flank`` letters."""
    if flank is None:
        return window_hashes(codes, k)
    sides = window_hashes(codes, flank)
    n = max(len(codes) - k + 1, 0)
    return mixed(sides[:n] * np.uint64(0x9E3779B97F4A7C15) + sides[k - flank : k - flank + n])


def matching(seqs: DataFrame, seq: str, k: int, known: list[str], flank: int | None = None) -> DataFrame:
    """The other columns with ``pos`` and ``kmer`` of each k-mer whose hash, or that of its flanks, is one of ``known`` (k-mers, or both flanks as one text). A join must follow."""
    importable(seqs.sparkSession)
    others = [c for c in seqs.columns if c != seq]
    # of flanks the middle counts for nothing, so any letters do
    whole = known if flank is None else [x[:flank] + "-" * (k - 2 * flank) + x[flank:] for x in known]
    own = np.unique(_hashes(codes_of("".join(whole)), k, flank)[::k]) if whole else np.zeros(0, "u8")
    shared = seqs.sparkSession.sparkContext.broadcast(own.tobytes())
    rows = spread(seqs).select(F.col(seq), *others)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, table, shift = np.frombuffer(shared.value, "u8"), np.zeros(1 << TABLE_BITS, bool), np.uint64(64 - TABLE_BITS)
        table[held >> shift] = True
        for b in batches:
            kept = b.select(others) if others else None
            for at_row, firsts, pieces in groups(b.column(0).to_pylist() if len(held) else [], k - 1):
                text, lengths = "".join(pieces), np.array([len(p) for p in pieces])
                h = _hashes(codes_of(text), k, flank)
                near = np.flatnonzero(table[h >> shift])
                near = near[complete(lengths, k)[near]]
                at = near[held[np.minimum(np.searchsorted(held, h[near]), len(held) - 1)] == h[near]]
                if len(at):
                    piece = np.repeat(np.arange(len(pieces)), lengths)[at]
                    pos = at - (np.cumsum(lengths) - lengths)[piece] + np.array(firsts)[piece]
                    columns = kept.take(pa.array(np.array(at_row)[piece])).columns if others else []
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(pos, pa.int64()), pa.array([text[i : i + k] for i in at.tolist()], pa.string())], names=[*others, "pos", "kmer"])

    return rows.mapInArrow(find, T.StructType([*seqs.select(*others).schema.fields, T.StructField("pos", T.LongType()), T.StructField("kmer", T.StringType())]))
