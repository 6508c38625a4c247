"""Interval views over the relational test tables, in Spark and, as text, in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "1995-01-01"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days(c: str):
    return F.datediff(F.col(c).cast("date"), F.lit(EPOCH).cast("date"))


def signal(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """lineitem as scored intervals: chrom, start, end, score, and the columns asked for."""
    t = _table(spark, sf_dir, "lineitem")
    start = _days("l_shipdate")
    return t.select(F.col("l_returnflag").alias("chrom"), start.alias("start"), (start + F.col("l_linenumber")).cast("int").alias("end"), F.col("l_quantity").cast("float").alias("score"), *more)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as typed features of twelve fields with one extra."""
    t = _table(spark, sf_dir, "orders")
    start, key, n = _days("o_orderdate"), F.col("o_orderkey"), (F.col("o_orderkey") % 3).cast("int")
    end = (start + 1 + F.col("o_orderkey") % 30).cast("int")
    rgb = F.when(key % 7 == 0, F.lit(0)).otherwise((F.lit(-16777216) + (key % 256) * 65536 + (F.col("o_custkey") % 256) * 256 + key % 100).cast("int"))
    blocks = lambda f: F.when(n > 0, F.transform(F.sequence(F.lit(1), n), f))
    return t.select(
        F.col("o_orderpriority").alias("chrom"), start.alias("start"), end.alias("end"), F.concat(F.lit("o"), key.cast("string")).alias("name"),
        (key % 1001).cast("int").alias("score"), F.when(F.col("o_orderstatus") == "F", "+").when(F.col("o_orderstatus") == "O", "-").otherwise(".").alias("strand"),
        start.alias("thick_start"), end.alias("thick_end"), rgb.alias("item_rgb"), n.alias("block_count"),
        blocks(lambda x: (x * 10).cast("int")).alias("block_sizes"), blocks(lambda x: (x - 1).cast("int")).alias("block_starts"),
        F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("extra_fields"),
    )


def points(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """events as minutes from their second on."""
    t = _table(spark, sf_dir, "events")
    start = F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.date_trunc("SECOND", "ts").cast("timestamp_ntz")).cast("int")
    return t.select(F.col("event_type").alias("chrom"), start.alias("start"), (start + 60).cast("int").alias("end"), F.floor("value").cast("float").alias("score"), *more)


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as intervals on the signal's chromosomes."""
    k = F.col("c_custkey")
    start = (k * 37 % 2500).cast("int")
    chrom = F.when(k % 3 == 0, "A").when(k % 3 == 1, "N").otherwise("R")
    return _table(spark, sf_dir, "customer").select(chrom.alias("chrom"), start.alias("start"), (start + 1 + k % 5).cast("int").alias("end"), k.alias("id"))


def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as loci of many widths, each with a number of bins: id, chrom, start, end, n."""
    k = F.col("c_custkey")
    start = (k * 37 % 2400).cast("int")
    chrom = F.when(k % 3 == 0, "A").when(k % 3 == 1, "N").otherwise("R")
    bins = F.when(k % 4 == 0, 1).when(k % 4 == 1, 3).when(k % 4 == 2, 12).otherwise(50)
    return _table(spark, sf_dir, "customer").select(k.alias("id"), chrom.alias("chrom"), start.alias("start"), (start + 60 + k * 53 % 2500).cast("int").alias("end"), bins.alias("n"))


SIGNAL = """signal AS (SELECT l_returnflag AS chrom, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS start,
  CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) + l_linenumber AS INTEGER) AS "end", CAST(l_quantity AS FLOAT) AS score, l_orderkey, l_linenumber, l_linestatus FROM lineitem)"""
FEATURES = """features AS (SELECT o_orderpriority AS chrom, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS start,
  CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + 1 + o_orderkey % 30 AS INTEGER) AS "end", 'o' || o_orderkey AS name, CAST(o_orderkey % 1001 AS INTEGER) AS score,
  CASE o_orderstatus WHEN 'F' THEN '+' WHEN 'O' THEN '-' ELSE '.' END AS strand, o_orderkey, o_custkey, CAST(o_orderkey % 3 AS INTEGER) AS n FROM orders)"""
POINTS = """points AS (SELECT event_type AS chrom, CAST(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS INTEGER) AS start,
  CAST(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) + 60 AS INTEGER) AS "end", CAST(floor(value) AS FLOAT) AS score, event_id, user_id, event_type FROM events)"""
REGIONS = """regions AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS chrom, CAST(c_custkey * 37 % 2500 AS INTEGER) AS start,
  CAST(c_custkey * 37 % 2500 + 1 + c_custkey % 5 AS INTEGER) AS "end", c_custkey AS id FROM customer)"""
LOCI = """loci AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS chrom, CAST(c_custkey * 37 % 2400 AS INTEGER) AS start,
  CAST(c_custkey * 37 % 2400 + 60 + c_custkey * 53 % 2500 AS INTEGER) AS "end", CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 12 ELSE 50 END AS n FROM customer)"""
