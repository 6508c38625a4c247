"""Binned summaries: overlap-weighted count, min, max, sum and sum of squares.

Items are dealt to the bins they touch by arithmetic, not by a range join; the five aggregates
merge, so Spark combines them before the shuffle, whose rows are one a bin and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.functions import intervals as iv
from tracklake.operators.ranges import sizes_of, small
from tracklake.shared import shared_path

NAN, INF = float("nan"), float("inf")
FIELDS = ("count", "min", "max", "sum", "sum_squares")


def nan_min(v: Column) -> Column:
    """min that is NaN if any value is; Spark's own takes NaN for the largest."""
    return F.when(F.max(F.isnan(v)), F.lit(NAN)).otherwise(F.min(v))


def aggregates(value, overlap) -> list[Column]:
    v, ov = iv.col(value).cast("double"), iv.col(overlap).cast("long")
    return [F.sum(ov).alias("count"), nan_min(v).alias("min"), F.max(v).alias("max"), F.sum(v * ov).alias("sum"), F.sum(v * v * ov).alias("sum_squares")]


def is_empty() -> Column:
    """Whether a summary holds no data."""
    return F.col("count") == 0


def merged() -> list[Column]:
    """Aggregates over summaries."""
    return [F.sum("count").alias("count"), nan_min(F.col("min")).alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"), F.sum("sum_squares").alias("sum_squares")]


def spread(rows: DataFrame, lo, hi, n) -> DataFrame:
    """Each row once for every bin of [lo, hi) that it overlaps: bin, overlap. lo, hi, n: columns or numbers."""
    lo, hi, n = iv.col(lo), iv.col(hi), iv.col(n)
    width = (hi - lo).cast("double") / n
    inside = rows.where(iv.intersects("start", "end", lo, hi) & (F.col("start") < F.col("end")))
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.greatest("start", lo) - lo) / width) - 1)
    last = F.least((n - 1).cast("long"), F.floor((F.least("end", hi) - lo) / width) + 1)
    each = inside.withColumn("bin", F.explode(F.sequence(first, last)))
    ov = F.least(F.col("end").cast("long"), iv.bin_end(lo, hi, n, "bin")) - F.greatest(F.col("start").cast("long"), iv.bin_start(lo, hi, n, "bin"))
    return each.withColumn("overlap", ov).where("overlap > 0")


def filled(bins: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """All bins, with the neutral summary where nothing was found."""
    out = bins.join(found, keys, "left")
    neutral = {"count": F.lit(0).cast("long"), "min": F.lit(INF), "max": F.lit(-INF), "sum": F.lit(0.0), "sum_squares": F.lit(0.0)}
    return out.select(*keys, *(F.coalesce(c, neutral[c]).alias(c) for c in FIELDS))


def dictionary(rows: DataFrame) -> DataFrame:
    """sizes_of(rows), written, so that rows are read once for it however often it is used."""
    sizes, path = sizes_of(rows), shared_path(rows.sparkSession, "sizes")
    sizes.write.parquet(path)
    return rows.sparkSession.read.schema(sizes.schema).parquet(path)


def summarize(rows: DataFrame, chrom: str, start: int = 0, end: int = 0, num_bins: int = 1, value: str = "score", sizes: DataFrame | None = None) -> DataFrame:
    """Exactly num_bins summaries of one chromosome's range: bin and FIELDS.

    end 0 means the chromosome's size. Unknown chromosomes and more bins than positions raise.
    """
    if not end:
        known = (sizes_of(rows.where(F.col("chrom") == chrom)) if sizes is None else sizes.where(F.col("chrom") == chrom)).first()
        if known is None:
            raise KeyError(chrom)
        end = known["size"]
    if start >= end:
        raise ValueError(f"start {start} must be below end {end}")
    if num_bins > end - start:
        raise ValueError("more bins than positions")
    found = spread(rows.where(F.col("chrom") == chrom), start, end, num_bins).groupBy("bin").agg(*aggregates(value, "overlap"))
    return filled(rows.sparkSession.range(num_bins).select(F.col("id").alias("bin")), found, ["bin"])


def summarize_all(rows: DataFrame, num_bins: int, value: str = "score", sizes: DataFrame | None = None) -> DataFrame:
    """Summaries of every chromosome in num_bins bins, empty ones too."""
    sizes = dictionary(rows) if sizes is None else sizes
    sized = rows.join(small(sizes.where(F.col("size") >= num_bins)), "chrom")
    found = spread(sized, 0, "size", num_bins).groupBy("chrom", "bin").agg(*aggregates(value, "overlap"))
    bins = sizes.where(F.col("size") >= num_bins).select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(num_bins - 1).cast("long"))).alias("bin"))
    return filled(bins, found, ["chrom", "bin"])


def totals(rows: DataFrame, by: list[str], value: str = "score") -> DataFrame:
    """Exact summaries without bins."""
    return rows.groupBy(*by).agg(*aggregates(value, iv.length()))


def moments(summaries: DataFrame) -> DataFrame:
    """mean and std of summaries."""
    mean = F.col("sum") / F.col("count")
    return summaries.withColumn("mean", mean).withColumn("std", F.sqrt(F.greatest(F.lit(0.0), F.col("sum_squares") / F.col("count") - mean * mean)))
