"""Range queries and point lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.functions import intervals as iv


#: Rows of a chromosome dictionary that are broadcast at most: some 40 MB.
SMALL = 1_000_000


def small(dictionary: DataFrame, most: int | None = None) -> DataFrame:
    """The dictionary, to be broadcast if it was counted and has few rows; else Spark joins it by a shuffle and splits what is skewed."""
    most = SMALL if most is None else most
    return F.broadcast(dictionary) if dictionary.limit(most + 1).count() <= most else dictionary


def sizes_of(rows: DataFrame) -> DataFrame:
    """chrom, size: the largest end of each chromosome."""
    return rows.groupBy("chrom").agg(F.max("end").alias("size"))


def range_query(rows: DataFrame, chrom: str, start: int = 0, end: int = 0, overlaps: bool = False) -> DataFrame:
    """Rows of one chromosome within [start, end), or overlapping it; end 0 means no bound on the right.

    An unknown chromosome gives no rows. The bounds are literals, so they reach the scan.
    """
    if end and start >= end:
        raise ValueError(f"start {start} must be below end {end}")
    here = rows.where(F.col("chrom") == chrom)
    if end:
        return here.where(iv.matches("start", "end", start, end, overlaps))
    return here.where(F.col("end") > start if overlaps else F.col("start") >= start)


def point_lookup(rows: DataFrame, chrom: str, start: int) -> DataFrame:
    return rows.where((F.col("chrom") == chrom) & (F.col("start") == start))


def track_range(rows: DataFrame, start: int, end: int, value: str = "score") -> DataFrame:
    """The tile format's filter: strict on the right, NaN dropped."""
    return rows.where(iv.strictly_within("start", "end", start, end) & ~F.isnan(value))


def present(value: str = "score"):
    """The value, null where it is NaN."""
    return F.when(~F.isnan(value), F.col(value))


def tiles_of(start: int, end: int, width: int, count: int) -> tuple[int, int]:
    """First and last tile of a query, both included; the last is read though the range may end before it."""
    return start // width, min(count - 1, -(-end // width))


def tile_query(tiles: DataFrame, start: int, end: int, width: int, count: int) -> DataFrame:
    """Rows of the tiles that a query touches: a filter on the tile column, which prunes partitions."""
    lo, hi = tiles_of(start, end, width, count)
    return tiles.where(F.col("tile").between(lo, hi))


def known_chromosomes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows whose chromosome has a size."""
    return rows.join(small(sizes.select("chrom")), "chrom", "left_semi")


def unknown_chromosomes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    return rows.join(small(sizes.select("chrom")), "chrom", "left_anti")
