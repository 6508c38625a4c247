"""Coverage sweeps without a task that holds a whole chromosome.

Breakpoints are summed by position, then dealt to tiles of TILE positions. Running values are
window sums within a tile; what a tile takes over from those before it is a prefix over the
tiles, of which a chromosome has 2^31 / TILE at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.operators import summary

TILE = 1 << 18


def breakpoints(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """chrom, tile, pos, begun, ended, before: depth left of each position where something begins or ends."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = F.array(F.struct(F.col("start").alias("pos"), one.alias("begun"), none.alias("ended")), F.struct(F.col("end").alias("pos"), none.alias("begun"), one.alias("ended")))
    at = rows.where("start < end").select("chrom", F.explode(ends).alias("e")).select("chrom", "e.*")
    at = at.groupBy("chrom", "pos").agg(F.sum("begun").alias("begun"), F.sum("ended").alias("ended")).withColumn("tile", F.floor(F.col("pos") / tile))
    return with_prefix(at, F.col("begun") - F.col("ended"), "before")


def with_prefix(at: DataFrame, value, name: str, how=F.sum, default=0) -> DataFrame:
    """name: the running sum (or max) of value over all earlier positions of the chromosome."""
    at = at.withColumn("_v", value)
    earlier = Window.partitionBy("chrom", "tile").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    tiles = at.groupBy("chrom", "tile").agg(how("_v").alias("_t"))
    carried = tiles.select("chrom", "tile", how("_t").over(Window.partitionBy("chrom").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
    both = at.withColumn("_r", how("_v").over(earlier)).join(carried, ["chrom", "tile"])
    total = F.coalesce("_r", F.lit(0)) + F.coalesce("_c", F.lit(0)) if how is F.sum else F.greatest("_r", "_c")
    return both.withColumn(name, F.coalesce(total, F.lit(default)) if default is not None else total).drop("_v", "_r", "_c")


def with_next(at: DataFrame, name: str = "next") -> DataFrame:
    """name: the next position of the chromosome, across tiles."""
    tiles = at.groupBy("chrom", "tile").agg(F.min("pos").alias("_first"))
    carried = tiles.select("chrom", "tile", F.lead("_first").over(Window.partitionBy("chrom").orderBy("tile")).alias("_c"))
    own = at.withColumn("_n", F.lead("pos").over(Window.partitionBy("chrom", "tile").orderBy("pos")))
    return own.join(carried, ["chrom", "tile"]).withColumn(name, F.coalesce("_n", "_c")).drop("_n", "_c")


def coverage(rows: DataFrame, mode: str = "exact", tile: int = TILE) -> DataFrame:
    """chrom, start, end, depth of covered runs.

    exact: maximal runs of one depth. end_events: runs as the sweep gives that looks up only when an item ends, so
    that a run reaches back to the last end, or to the start that met depth 0, with the depth at its end.
    """
    at = breakpoints(rows, tile)
    if mode == "exact":
        steps = with_next(at.where("begun <> ended").withColumn("depth", F.col("before") + F.col("begun") - F.col("ended")))
        return steps.where("depth > 0").select("chrom", F.col("pos").alias("start"), F.col("next").alias("end"), F.col("depth"))
    if mode != "end_events":
        raise ValueError(mode)
    mark = F.when((F.col("ended") > 0) | (F.col("before") == F.col("ended")), F.col("pos"))
    left = with_prefix(at, mark, "left", F.max, None)
    return left.where("ended > 0 AND pos > left").select("chrom", F.col("left").alias("start"), F.col("pos").alias("end"), F.col("before").alias("depth"))


def merge_intervals(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """chrom, start, end: the covered stretches, touching ones as one."""
    after = F.col("before") + F.col("begun") - F.col("ended")
    edges = breakpoints(rows, tile).withColumn("after", after).where("(before = 0) <> (after = 0)")
    return with_next(edges).where("before = 0").select("chrom", F.col("pos").alias("start"), F.col("next").alias("end"))


def depth_histogram(rows: DataFrame) -> DataFrame:
    """chrom, depth, positions."""
    return coverage(rows).groupBy("chrom", "depth").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("positions"))


def summarize_features(rows: DataFrame, num_bins: int, sizes: DataFrame | None = None) -> DataFrame:
    """Binned summaries of coverage depth, every chromosome: count is covered positions."""
    from tracklake.operators.ranges import sizes_of

    return summary.summarize_all(coverage(rows), num_bins, "depth", sizes_of(rows) if sizes is None else sizes)
