"""Binned summaries of many loci at once, at a cost that does not follow a locus's width.

An index of the signal is built once: pieces, which are the rows cut at tiles of about their usual length and summed where
they are alike, and nodes, which are summaries of one tile, of FAN tiles, of FAN^2 and so on. A bin of a locus is then the
pieces at its two edges and, for the whole tiles between, the fewest nodes that cover them: less than 2 * FAN a level, with levels
as the logarithm of the width. Bins meet pieces on (chrom, tile) and nodes on (chrom, level, node), so both are equi joins.
Nodes are merged, not subtracted as prefix sums would be: minimum and maximum have no inverse, and NaN and infinite
values stay in the bins that hold them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.functions import intervals as iv
from tracklake.operators import summary
from tracklake.operators.ranges import small
from tracklake.shared import shared_path

FAN = 4


@dataclass
class Index:
    """pieces: chrom, tile, s, e, n, least, most, total, squares; nodes: level, chrom, node and a summary; sizes: chrom, size."""

    pieces: DataFrame
    nodes: DataFrame
    sizes: DataFrame
    width: int
    depth: int


def index(rows: DataFrame, value: str = "score", width: int | None = None, path: str | None = None) -> Index:
    """The index of signal rows, written to path (or the shared folder). width: positions of a tile."""
    spark, path = rows.sparkSession, path or shared_path(rows.sparkSession, "loci")
    rows = rows.where("start < end")
    if width is None:
        usual = rows.agg(F.avg(F.col("end") - F.col("start"))).first()[0] or 1
        width = 1 << max(0, round(math.log2(usual)))
    v = F.col(value).cast("double")
    each = rows.select("chrom", "start", "end", v.alias("v"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("tile"))
    cut = each.select("chrom", "tile", F.greatest(F.col("start").cast("long"), F.col("tile") * width).alias("s"), F.least(F.col("end").cast("long"), (F.col("tile") + 1) * width).alias("e"), "v")
    pieces = cut.groupBy("chrom", "tile", "s", "e").agg(F.count("*").alias("n"), summary.nan_min(F.col("v")).alias("least"), F.max("v").alias("most"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares"))
    pieces.write.parquet(f"{path}/pieces")
    pieces = spark.read.schema(pieces.schema).parquet(f"{path}/pieces")
    pieces.groupBy("chrom").agg(F.max("e").cast("int").alias("size")).write.parquet(f"{path}/sizes")
    sizes = spark.read.schema("chrom string, size int").parquet(f"{path}/sizes")
    tiles = -(-(sizes.agg(F.max("size")).first()[0] or 1) // width)
    depth = next(k for k in range(40) if FAN ** (k + 1) >= tiles)
    weighted = pieces.withColumns({"tile": F.col("tile"), "overlap": F.col("e") - F.col("s")})
    level = weighted.groupBy("chrom", F.col("tile").alias("node")).agg(*merged(F.col("overlap")))
    for k in range(depth + 1):
        if k:
            level = level.withColumn("node", F.floor(F.col("node") / FAN)).groupBy("chrom", "node").agg(*summary.merged())
        level.write.parquet(f"{path}/nodes/level={k}")
        level = spark.read.schema(level.schema).parquet(f"{path}/nodes/level={k}")
    nodes = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in level.schema)}, level int").parquet(f"{path}/nodes")
    return Index(pieces, nodes, sizes, width, depth)


def merged(overlap: Column) -> list[Column]:
    """A summary of pieces, each counted over so many of its positions."""
    return [F.sum(F.col("n") * overlap).alias("count"), summary.nan_min(F.col("least")).alias("min"), F.max("most").alias("max"), F.sum(F.col("total") * overlap).alias("sum"), F.sum(F.col("squares") * overlap).alias("sum_squares")]


def bins_of(loci: DataFrame, sizes: DataFrame, num_bins) -> DataFrame:
    """id, bin, chrom, lo, hi of each locus (id, chrom, start, end); end 0 or null is the chromosome's end.

    The query fails at a chromosome without a size, at an empty locus and at more bins than positions.
    """
    n = iv.col(num_bins).cast("long")
    sized = loci.join(small(sizes.select("chrom", "size")), "chrom", "left")
    known = sized.withColumn("end", F.when(F.coalesce(F.col("end"), F.lit(0)) == 0, F.col("size")).otherwise(F.col("end"))).withColumn("n", n)
    shown = F.concat(F.lit("locus "), F.col("id").cast("string"), F.lit(": "))
    fault = F.when(F.col("size").isNull(), F.concat(shown, F.lit("unknown chromosome"))).when(F.col("start") >= F.col("end"), F.concat(shown, F.lit("start must be below end"))).when(F.col("n") > F.col("end") - F.col("start"), F.concat(shown, F.lit("more bins than positions")))
    sound = known.where(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(True))
    each = sound.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return each.select("id", "bin", "chrom", iv.bin_start("start", "end", "n", "bin").alias("lo"), iv.bin_end("start", "end", "n", "bin").alias("hi"))


def edge_parts(bins: DataFrame, width: int) -> DataFrame:
    """id, bin, chrom, tile, lo, hi: what of each bin lies in tiles that it does not hold whole."""
    first, last = F.ceil(F.col("lo") / width), F.floor(F.col("hi") / width)
    part = lambda lo, hi: F.struct(F.floor(lo / width).alias("tile"), lo.alias("lo"), hi.alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    # without a whole tile the bin lies in one tile, or in two that meet at last * width
    parts = F.when(first < last, F.array(part(lo, first * width), part(last * width, hi))).when(last * width > lo, F.array(part(lo, last * width), part(last * width, hi))).otherwise(F.array(part(lo, hi)))
    return bins.select("id", "bin", "chrom", F.explode(parts).alias("p")).select("id", "bin", "chrom", "p.tile", "p.lo", "p.hi").where("lo < hi")


def cover(bins: DataFrame, width: int, depth: int) -> DataFrame:
    """id, bin, chrom, level, node: the nodes that cover the whole tiles of each bin, each tile once."""
    levels = bins.withColumns({"first": F.ceil(F.col("lo") / width), "last": F.floor(F.col("hi") / width)}).where("first < last").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    size = F.pow(F.lit(FAN), F.col("level")).cast("long")
    a, b = F.ceil(F.col("first") / size), F.floor(F.col("last") / size)
    at = levels.withColumns({"a": a, "b": b}).where("a < b").withColumns({"pa": F.ceil(F.col("a") / FAN), "pb": F.floor(F.col("b") / FAN)})
    above = (F.col("pa") < F.col("pb")) & (F.col("level") < depth)
    run = lambda lo, hi: F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))
    nodes = F.when(above, F.concat(run(F.col("a"), F.col("pa") * FAN), run(F.col("pb") * FAN, F.col("b")))).otherwise(run(F.col("a"), F.col("b")))
    return at.select("id", "bin", "chrom", "level", F.explode(nodes).alias("node"))


def summarize_loci(source: Index, loci: DataFrame, num_bins=1) -> DataFrame:
    """id, bin and a summary of every bin of each locus (id, chrom, start, end), empty ones too; num_bins: a number or a column of loci."""
    bins = bins_of(loci, source.sizes, num_bins)
    edges = edge_parts(bins, source.width).join(source.pieces, ["chrom", "tile"]).withColumn("overlap", F.least("hi", "e") - F.greatest("lo", "s")).where("overlap > 0")
    whole = cover(bins, source.width, source.depth).join(source.nodes, ["chrom", "level", "node"])
    ov = F.col("overlap")
    one = edges.select("id", "bin", (F.col("n") * ov).alias("count"), F.col("least").alias("min"), F.col("most").alias("max"), (F.col("total") * ov).alias("sum"), (F.col("squares") * ov).alias("sum_squares"))
    empty = {"count": F.lit(0).cast("long"), "min": F.lit(summary.INF), "max": F.lit(-summary.INF), "sum": F.lit(0.0), "sum_squares": F.lit(0.0)}
    none = bins.select("id", "bin", *(v.alias(k) for k, v in empty.items()))
    return one.unionByName(whole.select("id", "bin", *summary.FIELDS)).unionByName(none).groupBy("id", "bin").agg(*summary.merged())
