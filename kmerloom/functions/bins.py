"""Hierarchical interval bins: level 0 is the whole sequence, each level below splits a bin in eight, the finest is 2^14 wide."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_SHIFT, LEVELS = 14, 8


def bin_first(level: int) -> int:
    """The first bin of a level."""
    return ((1 << 3 * level) - 1) // 7


def bin_parent(b: Column) -> Column:
    return F.shiftright(b - 1, 3)


def bin_level(b: Column) -> Column:
    out = F.lit(0)
    for level in range(1, LEVELS + 1):
        out = F.when(b >= bin_first(level), F.lit(level)).otherwise(out)
    return out


def bin_of(beg: Column, end: Column) -> Column:
    """The smallest bin that holds the 0-based half-open interval."""
    last, out = F.greatest(end - 1, F.lit(0)), F.lit(0).cast("long")
    for level in range(1, LEVELS + 1):
        shift = MIN_SHIFT + 3 * (LEVELS - level)
        out = F.when(F.shiftright(beg, shift) == F.shiftright(last, shift), F.shiftright(beg, shift) + bin_first(level)).otherwise(out)
    return out


def bins_touched(beg: Column, end: Column) -> Column:
    """All bins, on all levels, that may hold an interval which overlaps this one."""
    last = F.greatest(end - 1, beg)
    per_level = [F.sequence(F.shiftright(beg, s) + bin_first(level), F.shiftright(last, s) + bin_first(level)) for level in range(LEVELS + 1) for s in [MIN_SHIFT + 3 * (LEVELS - level)]]
    return F.concat(*per_level)


def virtual_offset(block: Column, within: Column) -> Column:
    return F.shiftleft(block.cast("long"), 16).bitwiseOR(within.cast("long"))
