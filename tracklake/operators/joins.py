"""Interval joins as equi joins on tiles, and totals over such joins without their pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.functions import intervals as iv
from tracklake.operators import loci, ranks
from tracklake.operators.ranges import small


#: A level's tiles are so many times as long as those of the level below.
FAN = 16


def interval_join(left: DataFrame, right: DataFrame, mode: str = "overlaps", tile: int | None = None) -> DataFrame:
    """Pairs of one chromosome that overlap, or whose right side lies within the left (contains).

    Both sides go to the tiles they touch and meet on (chrom, level, tile), which deals even a single chromosome to many
    tasks; a pair counts in the tile where its intersection begins. Columns of the sides get the
    prefixes l_ and r_. One pass over both sides measures their lengths: the tiles of level 0 are about twice the usual
    length, unless `tile` gives theirs, and an interval longer than a tile belongs to the first level whose tiles hold it. A pair meets
    at the level of its longer side, so a side touches two tiles a level at most, however long it is; where
    no interval is longer than a tile there is one level.
    """
    if mode not in ("overlaps", "contains"):
        raise ValueError(mode)
    length = (F.col("end") - F.col("start")).cast("long").alias("n")
    found = left.select(length).union(right.select(length)).where("n > 0").agg(F.max("n").alias("most"), F.avg("n").alias("usual")).first()
    tile = tile or max(128, 1 << int(2 * (found.usual or 0)).bit_length())
    top = 0
    while tile * FAN**top < (found.most or 0):
        top += 1

    def side(d: DataFrame, p: str) -> DataFrame:
        named = d.where("start < end").select(*(F.col(c).alias(p + c) for c in d.columns))
        start, end = F.col(p + "start"), F.col(p + "end")
        if top:
            own = sum((F.when(end - start > tile * FAN**k, 1).otherwise(0) for k in range(top)), F.lit(0))
            named = named.withColumn(p + "_own", own).withColumn(p + "_level", F.explode(F.sequence(p + "_own", F.lit(top))))
        wide = width(p + "_level")
        return named.withColumn(p + "_tile", F.explode(F.sequence(F.floor(start / wide), F.floor((end - 1) / wide))))

    def width(level: str):
        return (tile * F.pow(F.lit(FAN), F.col(level))).cast("long") if top else F.lit(tile)

    a, b = side(left, "l_"), side(right, "r_")
    rule = iv.intersects("l_start", "l_end", "r_start", "r_end") if mode == "overlaps" else iv.contained("r_start", "r_end", "l_start", "l_end")
    met = (F.col("l_chrom") == F.col("r_chrom")) & (F.col("l__tile") == F.col("r__tile"))
    if top:
        met = met & (F.col("l__level") == F.col("r__level")) & (F.col("l__level") == F.greatest("l__own", "r__own"))
    met = met & (F.col("l__tile") == F.floor(F.greatest("l_start", "r_start") / width("l__level"))) & rule
    return a.join(b, met).drop(*(f"{p}__{c}" for p in "lr" for c in ("own", "level", "tile")))


def overlap_totals(rows: DataFrame, others: DataFrame) -> DataFrame:
    """rows with n and shared: how many of the others overlap each, and the positions shared with them in all; rows that meet none go.

    Pairs may grow with the square of the rows, so none is made. Ends are counted by position and summed along the chromosome:
    what overlaps [start, end) has begun before end and has not ended by start, and what is shared is the area under the depth
    between the two.
    """
    ends = lambda d, begun, ended: d.where("start < end").select("chrom", F.explode(F.array(*(F.struct(F.col(c).cast("long").alias("pos"), F.lit(b).cast("long").alias("begun"), F.lit(e).cast("long").alias("ended")) for c, b, e in (("start", begun, 0), ("end", 0, ended))))).alias("e"))
    at = ends(others, 1, 1).unionByName(ends(rows, 0, 0)).where("chrom IS NOT NULL").groupBy("chrom", "e.pos").agg(F.sum("e.begun").alias("begun"), F.sum("e.ended").alias("ended"))
    at = at.withColumns({"here": F.col("begun"), "moment": F.col("pos") * (F.col("begun") - F.col("ended"))})
    upto = ranks.running(at, ("chrom",), "pos", ("begun", "ended", "moment"))
    area = F.col("pos") * (F.col("begun") - F.col("ended")) - F.col("moment")
    met = rows.where("start < end")
    for c, count in (("start", F.col("ended")), ("end", F.col("begun") - F.col("here"))):
        there = upto.select(F.col("chrom").alias("_chrom"), F.col("pos").alias("_pos"), count.alias(f"_n_{c}"), area.alias(f"_area_{c}"))
        met = met.join(there, (F.col("chrom") == F.col("_chrom")) & (F.col(c).cast("long") == F.col("_pos"))).drop("_chrom", "_pos")
    n, shared = F.col("_n_end") - F.col("_n_start"), F.col("_area_end") - F.col("_area_start")
    return met.select(*rows.columns, n.alias("n"), shared.alias("shared")).where("n > 0")


def contained_totals(rows: DataFrame, others: DataFrame, value: str = "score") -> DataFrame:
    """rows with n and total: how many of the others lie within each, and the sum of their values; rows that hold none go.

    No pair is made. Equal intervals count as one; each belongs to the nodes of a tree over positions that hold its start, and a node sums its own by end.
    A row is covered by the fewest nodes, of which those within it have ended by its end. Sums are merged and not subtracted,
    so NaN and infinite values stay in the rows that hold them.
    """
    key = ("chrom", "level", "node")
    wanted = rows.where("start < end AND chrom IS NOT NULL").select("chrom", "start", "end").distinct()
    longest = wanted.agg(F.max(F.col("end").cast("long") - F.col("start"))).first()[0] or 1
    depth = next(k for k in range(40) if loci.FAN ** (k + 1) > longest)
    nodes = loci.cover(wanted.select("chrom", F.col("start").alias("id"), F.col("end").alias("bin"), F.col("start").cast("long").alias("lo"), F.col("end").cast("long").alias("hi")), 1, depth)
    nodes = nodes.select(*key, F.col("id").alias("start"), F.col("bin").alias("end"))
    held = others.where("start < end").where(F.col("end").cast("long") - F.col("start") <= longest)
    held = held.groupBy("chrom", "start", "end").agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double")).alias("total"))
    held = held.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("node", F.floor(F.col("start") / F.pow(F.lit(loci.FAN), F.col("level"))))
    asked = nodes.select(*key, "end", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("total"))
    at = held.select(*key, "end", "n", "total").unionByName(asked).groupBy(*key, "end").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    found = nodes.join(ranks.running(at, key, "end", ("n", "total")), [*key, "end"]).groupBy("chrom", "start", "end").agg(F.sum("n").alias("_n"), F.sum("total").alias("_total")).where("_n > 0")
    return rows.join(found, ["chrom", "start", "end"]).select(*rows.columns, F.col("_n").alias("n"), F.col("_total").alias("total"))


def with_sizes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows with their chromosome's size; others go."""
    return rows.join(small(sizes), "chrom")
