"""Interval algebra as column expressions. Coordinates are closed: touching ends overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def overlaps(beg_a, end_a, beg_b, end_b) -> Column:
    return (_c(beg_a) <= _c(end_b)) & (_c(beg_b) <= _c(end_a))


def overlap_length(beg_a, end_a, beg_b, end_b) -> Column:
    """Shared positions, both ends counted; 0 if apart."""
    return F.greatest(F.least(_c(end_a), _c(end_b)) - F.greatest(_c(beg_a), _c(beg_b)) + 1, F.lit(0))


def overlap_extent(beg_a, end_a, beg_b, end_b) -> Column:
    """Length (ends not counted), begin and end of the shared part; null if apart."""
    beg, end = F.greatest(_c(beg_a), _c(beg_b)), F.least(_c(end_a), _c(end_b))
    return F.when(beg <= end, F.struct((end - beg).alias("len"), beg.alias("beg"), end.alias("end")))


def overlap_percent(beg_a, end_a, beg_b, end_b) -> Column:
    """Shared length without the last position, of A's positions, in percent."""
    length = F.least(_c(end_a), _c(end_b)) - F.greatest(_c(beg_a), _c(beg_b))
    return length / (_c(end_a) - _c(beg_a) + 1) * 100


def reciprocal(beg_a, end_a, beg_b, end_b, least_percent: float) -> Column:
    """Each of the two covers that percentage of the other at least."""
    n = overlap_length(beg_a, end_a, beg_b, end_b)
    of = lambda b, e: n / (_c(e) - _c(b) + 1) * 100
    return (n > 0) & (of(beg_a, end_a) >= least_percent) & (of(beg_b, end_b) >= least_percent)


def complementary(beg_a, end_a, beg_b, end_b, max_dist: int, max_percent: float) -> Column:
    """Side of A on which B continues it ('LEFT' or 'RIGHT'), null if it doesn't.

    B continues A if both, widened by max_dist, overlap and the shared part is at most
    max_percent of either.
    """
    near = (_c(beg_a) - max_dist <= _c(end_b) + max_dist) & (_c(beg_b) - max_dist <= _c(end_a) + max_dist)
    n = overlap_length(beg_a, end_a, beg_b, end_b)
    small = (n / (_c(end_a) - _c(beg_a) + 1) * 100 <= max_percent) & (n / (_c(end_b) - _c(beg_b) + 1) * 100 <= max_percent)
    return F.when(near & small, F.when(_c(beg_a) > _c(beg_b), "LEFT").otherwise("RIGHT"))


def tiles(length, width: int) -> Column:
    """[begin, end) tiles of a contig, the last one short, as an array of structs."""
    starts = F.sequence(F.lit(0).cast("long"), _c(length).cast("long") - 1, F.lit(width).cast("long"))
    return F.transform(starts, lambda b: F.struct(b.alias("beg"), F.least(b + width, _c(length).cast("long")).alias("end")))
