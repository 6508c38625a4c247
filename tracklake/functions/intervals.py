"""Predicates and arithmetic on half-open intervals, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def contained(start, end, lo, hi) -> Column:
    """[start, end) lies within [lo, hi)."""
    return (col(start) >= col(lo)) & (col(end) <= col(hi))


def intersects(start, end, lo, hi) -> Column:
    """[start, end) and [lo, hi) share a position."""
    return (col(start) < col(hi)) & (col(end) > col(lo))


def matches(start, end, lo, hi, overlaps: bool) -> Column:
    """The predicate of a range query in one of its two modes."""
    within = contained(start, end, lo, hi)
    return within | intersects(start, end, lo, hi) if overlaps else within


def strictly_within(start, end, lo, hi) -> Column:
    """The predicate of tile queries: the right bound is not met."""
    return (col(start) >= col(lo)) & (col(end) < col(hi))


def crosses(a: tuple, b: tuple) -> Column:
    """Intervals over (chromosome rank, position) pairs share a position; each is (left rank, left, right rank, right)."""
    at = lambda x, k: F.struct(col(x[k]).alias("rank"), col(x[k + 1]).alias("pos"))
    return (at(a, 0) < at(b, 2)) & (at(b, 0) < at(a, 2))


def intersection_length(start, end, lo, hi) -> Column:
    """Shared positions; negative by the gap if there are none."""
    return F.least(col(end), col(hi)) - F.greatest(col(start), col(lo))


def length(start="start", end="end") -> Column:
    return col(end) - col(start)


def ceil_div(a, b) -> Column:
    a, b = col(a).cast("long"), col(b).cast("long")
    return F.ceil(a / b).cast("long")


def half_up(x: Column) -> Column:
    """Rounding of .5 upwards, for negative numbers too."""
    return F.floor(x + 0.5)


def bin_start(lo, hi, n, i) -> Column:
    """First position of bin i of n over [lo, hi)."""
    lo, hi = col(lo), col(hi)
    return half_up(lo + col(i) * ((hi - lo).cast("double") / col(n)))


def bin_end(lo, hi, n, i) -> Column:
    return F.least(bin_start(lo, hi, n, col(i) + 1), col(hi).cast("long"))


def shown(start="start", end="end", score="score") -> Column:
    """score@[start; end)"""
    return F.concat(col(score).cast("string"), F.lit("@["), col(start).cast("string"), F.lit("; "), col(end).cast("string"), F.lit(")"))
