"""Streaming summaries: the same mergeable aggregates over a stream of signal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.operators import summary


def bucketed(stream: DataFrame, width: int, value: str = "score") -> DataFrame:
    """A running summary for each chromosome and bucket of `width` positions; use update or complete mode."""
    last = F.floor((F.col("end") - 1) / width)
    each = stream.where("start < end").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), last)))
    ov = F.least(F.col("end").cast("long"), (F.col("bucket") + 1) * width) - F.greatest(F.col("start").cast("long"), F.col("bucket") * width)
    return each.withColumn("overlap", ov).groupBy("chrom", "bucket").agg(*summary.aggregates(value, "overlap"))


def windowed(stream: DataFrame, time: str, late: str, every: str, width: int, value: str = "score") -> DataFrame:
    """Summaries by event-time window too; windows close when the watermark passes, so append mode and bounded state."""
    last = F.floor((F.col("end") - 1) / width)
    each = stream.withWatermark(time, late).where("start < end").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), last)))
    ov = F.least(F.col("end").cast("long"), (F.col("bucket") + 1) * width) - F.greatest(F.col("start").cast("long"), F.col("bucket") * width)
    return each.withColumn("overlap", ov).groupBy(F.window(time, every).alias("window"), "chrom", "bucket").agg(*summary.aggregates(value, "overlap"))
