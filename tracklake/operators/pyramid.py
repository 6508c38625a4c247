"""Zoom pyramid: summaries of aligned buckets at reductions that grow by four."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.functions import intervals as iv
from tracklake.operators import loci, summary

GROWTH, LEVELS, MOST = 4, 8, 2**31 - 1


def initial_reduction(rows: DataFrame) -> DataFrame:
    """reduction: ten times the mean length, rounded up."""
    mean = F.ceil(F.sum(iv.length().cast("long")) / F.count("*"))
    return rows.agg((F.greatest(mean, F.lit(1)) * 10).cast("long").alias("reduction"))


def first_level(rows: DataFrame, reduction: int, value: str = "score") -> DataFrame:
    """chrom, bucket and a summary; bucket k covers [k * reduction, (k + 1) * reduction)."""
    last = F.floor((F.col("end") - 1) / reduction)
    each = rows.where("start < end").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / reduction), last)))
    ov = iv.intersection_length(F.col("start").cast("long"), F.col("end").cast("long"), F.col("bucket") * reduction, (F.col("bucket") + 1) * reduction)
    return each.withColumn("overlap", ov).groupBy("chrom", "bucket").agg(*summary.aggregates(value, "overlap"))


def next_level(level: DataFrame, growth: int = GROWTH) -> DataFrame:
    """The level `growth` times coarser; aligned buckets nest, so the rows themselves aren't read again."""
    return level.withColumn("bucket", F.floor(F.col("bucket") / growth)).groupBy("chrom", "bucket").agg(*summary.merged())


def pyramid(rows: DataFrame, reduction: int, levels: int = LEVELS, value: str = "score", path: str | None = None) -> DataFrame:
    """All levels: reduction, chrom, start, end and a summary. With a path each is written before the next is built."""
    spark, out, level = rows.sparkSession, None, first_level(rows, reduction, value)
    for k in range(levels):
        r = reduction * GROWTH**k
        if r > MOST:
            break
        if k:
            level = next_level(level)
        if path is not None:
            level.write.parquet(f"{path}/reduction={r}")
            level = spark.read.schema(level.schema).parquet(f"{path}/reduction={r}")
        rows_k = level.select(F.lit(r).cast("long").alias("reduction"), "chrom", (F.col("bucket") * r).alias("start"), ((F.col("bucket") + 1) * r).alias("end"), *summary.FIELDS)
        out = rows_k if out is None else out.unionByName(rows_k)
    return out


def pick(reductions: list[int], desired: int) -> int | None:
    """The coarsest level that is no coarser than desired; none for desired <= 1."""
    if desired < 0:
        raise ValueError("desired must not be negative")
    fit = [r for r in reductions if r <= desired and desired - r < desired]
    return max(fit, default=None) if desired > 1 else None


def picked(reductions: list[int], desired: Column) -> Column:
    """pick() as a column expression."""
    fit = F.array_max(F.array(*(F.when(desired >= r, F.lit(r).cast("long")) for r in sorted(reductions)))) if reductions else F.lit(None).cast("long")
    return F.when(desired > 1, fit)


def pick_all(levels: DataFrame, desired: DataFrame) -> DataFrame:
    """desired, reduction: the level of each of a few desired reductions."""
    fit = (F.col("reduction") <= F.col("desired")) & (F.col("desired") > 1) & (F.col("reduction") > 0)
    return desired.join(levels, fit, "left").groupBy("desired").agg(F.max("reduction").alias("reduction"))


def zoom_summary(level: DataFrame, lo, hi, n) -> DataFrame:
    """Summaries of n bins of [lo, hi) from a level's rows, weighted by the share of a row in a bin."""
    each = summary.spread(level, lo, hi, n)
    w = F.col("overlap") / (F.col("end") - F.col("start"))
    return each.groupBy("chrom", "bin").agg(
        F.sum(iv.half_up(F.col("count") * w)).cast("long").alias("count"),
        summary.nan_min(F.col("min")).alias("min"),
        F.max("max").alias("max"),
        F.sum(F.col("sum") * w).alias("sum"),
        F.sum(F.col("sum_squares") * w).alias("sum_squares"),
    )


def summarize(rows: DataFrame, levels: DataFrame, reductions: list[int], lo: int, hi: int, n: int, value: str = "score") -> DataFrame:
    """Summaries of every chromosome from the level that fits two buckets to a bin, or from the rows."""
    r = pick(reductions, (hi - lo) // (2 * n))
    if r is None:
        return summary.spread(rows, lo, hi, n).groupBy("chrom", "bin").agg(*summary.aggregates(value, "overlap"))
    return zoom_summary(levels.where(F.col("reduction") == r), lo, hi, n)


def choose(ranges: DataFrame, reductions: list[int]) -> DataFrame:
    """ranges (start, end, n) with desired, the reduction that gives two buckets to a bin, and reduction, the level that fits it or null."""
    desired = F.floor((F.col("end") - F.col("start")) / (2 * F.col("n")))
    return ranges.withColumn("desired", desired).withColumn("reduction", picked(reductions, F.col("desired")))


def summarize_ranges(source: loci.Index, path: str, reductions: list[int], ranges: DataFrame) -> DataFrame:
    """id, bin, reduction and a summary for every bin of each range (id, chrom, start, end, n), each range from its own level.

    path: levels as pyramid() writes them, one Parquet partition a level; only those that some range takes are read.
    A range meets its level's buckets on (reduction, chrom, bucket), which are a few for each of its bins. Ranges that no level fits
    are answered from the raw rows, by the loci index. Buckets are weighted by their share in a bin.
    """
    spark, chosen = source.pieces.sparkSession, choose(ranges, reductions)
    used = [r.reduction for r in chosen.select("reduction").distinct().collect()]  # one row a level at most
    raw = loci.summarize_loci(source, chosen.where("reduction IS NULL").select("id", "chrom", "start", "end", "n"), "n").withColumn("reduction", F.lit(None).cast("long"))
    coarse = chosen.where("reduction IS NOT NULL").select("id", "chrom", F.col("start").cast("long").alias("lo"), F.col("end").cast("long").alias("hi"), "n", "reduction")
    level = spark.read.option("basePath", path).parquet(*(f"{path}/reduction={r}" for r in reductions)).where(F.col("reduction").isin([r for r in used if r is not None]))
    level = level.withColumn("reduction", F.col("reduction").cast("long"))
    asked = coarse.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / F.col("reduction")), F.floor((F.col("hi") - 1) / F.col("reduction")))))
    met = asked.join(level, ["reduction", "chrom", "bucket"])
    placed = met.withColumns({"start": F.col("bucket") * F.col("reduction"), "end": (F.col("bucket") + 1) * F.col("reduction")})
    each = summary.spread(placed, "lo", "hi", "n")
    w = F.col("overlap") / F.col("reduction")
    found = each.select("id", "bin", "reduction", iv.half_up(F.col("count") * w).cast("long").alias("count"), "min", "max", (F.col("sum") * w).alias("sum"), (F.col("sum_squares") * w).alias("sum_squares"))
    bins = coarse.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("bin"), "reduction")
    none = bins.select("*", F.lit(0).cast("long").alias("count"), F.lit(summary.INF).alias("min"), F.lit(-summary.INF).alias("max"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("sum_squares"))
    zoomed = found.unionByName(none).groupBy("id", "bin", "reduction").agg(*summary.merged())
    return zoomed.unionByName(raw)
