"""Sections of signal rows: coalescing, properties, splitting, expansion, order checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.functions import intervals as iv
from tracklake.operators import ranks

MAX_ITEMS = 32767


def coalesce_variable(rows: DataFrame) -> DataFrame:
    """Values at one position are added; the span is that of the longest."""
    return rows.groupBy("chrom", "start").agg(F.max("end").alias("end"), F.sum("score").cast("float").alias("score"))


def coalesce_bedgraph(rows: DataFrame) -> DataFrame:
    """Values of equal intervals are added."""
    return rows.groupBy("chrom", "start", "end").agg(F.sum("score").cast("float").alias("score"))


def properties(rows: DataFrame, section: str = "section") -> DataFrame:
    """start, end, span (rounded mean length) and size of each section."""
    mean = F.avg(F.col("end") - F.col("start"))
    return rows.groupBy("chrom", section).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.floor(mean + 0.5).cast("int").alias("span"), F.count("*").alias("size"))


def splice(rows: DataFrame, section: str = "section", most: int = MAX_ITEMS, order: tuple[str, ...] = ("start", "end", "score")) -> DataFrame:
    """part: the number of the sub-section, of at most `most` items in order."""
    return ranks.ranked(rows, ("chrom", section), order, "part").withColumn("part", F.floor(F.col("part") / most))


def gathered(rows: DataFrame, *by: str, most: int = MAX_ITEMS) -> DataFrame:
    """bedGraph sections (chrom, by, starts, ends, values) of signal rows, starts ascending, of at most `most` items, to a power of two below.

    A task fills sections with rows as they come, so that there are as many of one chromosome and by as it takes, and no row grows with the data.
    """
    lots = rows.withColumn("_lot", F.shiftright(F.monotonically_increasing_id(), most.bit_length() - 1))
    each = lots.groupBy("chrom", *by, "_lot").agg(F.sort_array(F.collect_list(F.struct("start", "end", "score"))).alias("x"))
    return each.select("chrom", *by, F.col("x.start").alias("starts"), F.col("x.end").alias("ends"), F.col("x.score").alias("values"))


def fixed_step(sections: DataFrame) -> DataFrame:
    """chrom, start, end, score of sections (chrom, start, step, span, values)."""
    each = sections.select("chrom", "start", "step", "span", F.posexplode("values").alias("i", "score"))
    at = F.col("start") + F.col("i") * F.col("step")
    return each.select("chrom", at.cast("int").alias("start"), (at + F.col("span")).cast("int").alias("end"), F.col("score").cast("float").alias("score"))


def variable_step(sections: DataFrame) -> DataFrame:
    """chrom, start, end, score of sections (chrom, span, positions, values)."""
    each = sections.select("chrom", "span", F.explode(F.arrays_zip("positions", "values")).alias("x"))
    return each.select("chrom", F.col("x.positions").cast("int").alias("start"), (F.col("x.positions") + F.col("span")).cast("int").alias("end"), F.col("x.values").cast("float").alias("score"))


def bedgraph(sections: DataFrame) -> DataFrame:
    """chrom, start, end, score of sections (chrom, starts, ends, values)."""
    each = sections.select("chrom", F.explode(F.arrays_zip("starts", "ends", "values")).alias("x"))
    return each.select("chrom", F.col("x.starts").cast("int").alias("start"), F.col("x.ends").cast("int").alias("end"), F.col("x.values").cast("float").alias("score"))


def consecutive(rows: DataFrame, by: str, order: str, key: str) -> DataFrame:
    """Runs of equal key in order, within by: run, first, size. A key may come back in a later run."""
    runs = ranks.runs(rows.select(*dict.fromkeys((by, order, key))), (by,), (order,), key, "run")
    return runs.groupBy(by, "run", key).agg(F.min(order).alias("first"), F.count("*").alias("size"))


def order_violations(rows: DataFrame, position: str, by: str = "chrom") -> DataFrame:
    """Rows whose start is below that of the row before, in the order of position."""
    return ranks.with_previous(rows, (by,), (position,), "start", "previous").where("start < previous")


def fixed_slots(rows: DataFrame, slot: int, by: str = "chrom", order: tuple[str, ...] = ("start", "end")) -> DataFrame:
    """The first item and size of each run of `slot` items in order."""
    placed = ranks.ranked(rows, (by,), order, "slot").withColumn("slot", F.floor(F.col("slot") / slot))
    return placed.groupBy(by, "slot").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("size"))


# ------------------------------------------------------------------ queries on sections that stay arrays


def lower_bound(values: Column, least) -> Column:
    """How many of the ascending values are below least, by halving; about log2(n) steps, no row a value."""
    least = iv.col(least)
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))
    at = F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi"))

    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
        below = (span["lo"] < span["hi"]) & (F.get(values, middle) < least)
        return F.struct(F.when(below, middle + 1).otherwise(span["lo"]).alias("lo"), F.when(below, span["hi"]).otherwise(F.least(span["hi"], middle)).alias("hi"))

    return F.aggregate(steps, at, halve)["lo"]


def _cut(values: Column, first: Column, last: Column) -> Column:
    """values[first:last], empty where last <= first."""
    return F.slice(values, first + 1, F.greatest(last - first, F.lit(0)))


def fixed_range(sections: DataFrame, lo: int, hi: int) -> DataFrame:
    """Sections (chrom, start, step, span, values) cut to the items within [lo, hi), by arithmetic on the grid; empty ones go."""
    start, step, n = F.col("start").cast("long"), F.col("step"), F.size("values")
    first = F.least(n, F.greatest(F.lit(0), F.ceil((F.lit(lo) - start) / step))).cast("int")
    last = F.least(n, F.floor((F.lit(hi) - F.col("span") - start) / step) + 1).cast("int")
    cut = sections.withColumns({"values": _cut(F.col("values"), first, last), "start": (start + first * step).cast("int")})
    return cut.where(F.size("values") > 0)


def variable_range(sections: DataFrame, lo: int, hi: int) -> DataFrame:
    """Sections (chrom, span, positions, values), positions ascending, cut to the items within [lo, hi); empty ones go."""
    first, last = lower_bound(F.col("positions"), lo), lower_bound(F.col("positions"), F.lit(hi) - F.col("span") + 1)
    cut = sections.withColumns({"_first": first, "_last": last})
    cut = cut.withColumns({c: _cut(F.col(c), F.col("_first"), F.col("_last")) for c in ("positions", "values")}).drop("_first", "_last")
    return cut.where(F.size("values") > 0)


def bedgraph_range(sections: DataFrame, lo: int, hi: int) -> DataFrame:
    """Sections (chrom, starts, ends, values), starts ascending, cut to the items within [lo, hi); empty ones go."""
    first, last = lower_bound(F.col("starts"), lo), lower_bound(F.col("starts"), hi)
    cut = sections.withColumns({"_first": first, "_last": last})
    items = F.filter(F.arrays_zip(*(_cut(F.col(c), F.col("_first"), F.col("_last")).alias(c) for c in ("starts", "ends", "values"))), lambda x: x["ends"] <= hi)
    cut = cut.withColumn("_items", items).where(F.size("_items") > 0)
    return cut.withColumns({c: F.col(f"_items.{c}") for c in ("starts", "ends", "values")}).drop("_first", "_last", "_items")


def fixed_at(position) -> Column:
    """The value that begins at a position of a fixed-step section; null where none does."""
    off = iv.col(position).cast("long") - F.col("start")
    index = (off / F.col("step")).cast("int")
    return F.when((off >= 0) & (off % F.col("step") == 0), F.get("values", index))


def variable_at(position) -> Column:
    """The value that begins at a position of a variable-step section; null where none does."""
    at = lower_bound(F.col("positions"), position)
    return F.when(F.get("positions", at) == iv.col(position), F.get("values", at))


def required(value: Column, position) -> Column:
    """The value of a point lookup; the query fails where there is none."""
    return F.coalesce(value, F.raise_error(F.concat(F.lit("nothing begins at "), iv.col(position).cast("string"))).cast("float"))
