"""Places and neighbours in an order without a task that holds a whole key.

Rows are dealt by ranges of key and order to parts of like size and written once, so that all that read them see the same
parts. A row's place is its place in its part and a prefix over the parts of its key, of which there are no more than Spark's
shuffle partitions. Rows that are equal in the order come as the hash of their columns says; rows equal in all
columns lie in one part.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracklake.shared import shared_path


def own_name() -> str:
    """A column name that no table has."""
    return f"_{uuid.uuid4().hex}"


class Dealt:
    """rows: the rows with their part; order: a struct that orders them; own: the window of a part of a key."""

    def __init__(self, rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...]):
        spark, self.columns, self.by, self.part, tie = rows.sparkSession, rows.columns, by, own_name(), own_name()
        tied = rows.withColumn(tie, F.xxhash64(*rows.columns))
        dealt = tied.repartitionByRange(*by, *order, tie).withColumn(self.part, F.spark_partition_id())
        path = shared_path(spark, "dealt")
        dealt.write.parquet(path)
        self.rows = spark.read.schema(dealt.schema).parquet(path)
        self.order = F.struct(*order, tie)
        self.own: WindowSpec = Window.partitionBy(*by, self.part).orderBy(*order, tie)
        self.parts: WindowSpec = Window.partitionBy(*by).orderBy(self.part)

    def with_carried(self, rows: DataFrame, per_part: DataFrame, **carried: Column) -> DataFrame:
        """rows with what their part has in per_part (by, part and values): carried, by name."""
        names = {c: own_name() for c in (*self.by, self.part)}
        there = per_part.select(*(F.col(c).alias(n) for c, n in names.items()), *(value.alias(c) for c, value in carried.items()))
        met = [rows[c].eqNullSafe(F.col(n)) for c, n in names.items()]
        return rows.join(there, met).drop(*names.values())


def ranked(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], name: str) -> DataFrame:
    """rows with name: their number in order within by, from 0."""
    d, size, before, place = Dealt(rows, by, order), own_name(), own_name(), own_name()
    sizes = d.rows.groupBy(*by, d.part).agg(F.count("*").alias(size))
    earlier = F.coalesce(F.sum(size).over(d.parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = d.with_carried(d.rows, sizes, **{before: earlier}).withColumn(place, F.row_number().over(d.own))
    return placed.select(*d.columns, (F.col(before) + F.col(place) - 1).alias(name))


def with_previous(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], column: str, name: str) -> DataFrame:
    """rows with name: the column's value in the row before, null for the first of each key."""
    d, last, carried = Dealt(rows, by, order), own_name(), own_name()
    lasts = d.rows.groupBy(*by, d.part).agg(F.max_by(column, d.order).alias(last))
    joined = d.with_carried(d.rows, lasts, **{carried: F.lag(last).over(d.parts)})
    previous = F.when(F.row_number().over(d.own) == 1, F.col(carried)).otherwise(F.lag(column).over(d.own))
    return joined.select(*d.columns, previous.alias(name))


def runs(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], key: str, name: str) -> DataFrame:
    """rows with name: the number, from 1, of the run of equal keys that they lie in; a null equals nothing."""
    d, new, first, last, inner, head, base = Dealt(rows, by, order), *(own_name() for _ in range(6))
    changed = (F.row_number().over(d.own) > 1) & F.coalesce(F.lag(key).over(d.own) != F.col(key), F.lit(True))
    marked = d.rows.withColumn(new, changed.cast("int"))
    per_part = marked.groupBy(*by, d.part).agg(F.min_by(key, d.order).alias(first), F.max_by(key, d.order).alias(last), F.sum(new).alias(inner))
    per_part = per_part.withColumn(head, F.coalesce(F.lag(last).over(d.parts) != F.col(first), F.lit(True)).cast("int"))
    begun = F.sum(F.col(head) + F.col(inner)).over(d.parts.rowsBetween(Window.unboundedPreceding, 0)) - F.col(inner)
    joined = d.with_carried(marked, per_part, **{base: begun})
    return joined.select(*d.columns, (F.col(base) + F.sum(new).over(d.own)).alias(name))


def running(rows: DataFrame, by: tuple[str, ...], order: str, columns: tuple[str, ...]) -> DataFrame:
    """rows, of which each (by, order) has one, with the sum of each of the columns up to the row in its place; nulls add nothing."""
    d, names = Dealt(rows, by, (order,)), {c: (own_name(), own_name()) for c in columns}
    totals = d.rows.groupBy(*by, d.part).agg(*(F.sum(c).alias(total) for c, (total, _) in names.items()))
    earlier = {before: F.sum(total).over(d.parts.rowsBetween(Window.unboundedPreceding, -1)) for total, before in names.values()}
    upto = d.own.rowsBetween(Window.unboundedPreceding, 0)
    added = lambda a, b: F.coalesce(a + b, a, b)
    sums = {c: added(F.sum(c).over(upto), F.col(before)) for c, (_, before) in names.items()}
    return d.with_carried(d.rows, totals, **earlier).select(*(sums[c].alias(c) if c in sums else c for c in d.columns))
