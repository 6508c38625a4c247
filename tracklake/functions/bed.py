"""Typed features: unpacking a tab-separated tail into fields, and packing fields into a tail.

Both are column expressions. In permissive mode a row that cannot be read gets a struct (field, reason) in
the column error, with the zero-based number of the field at fault, and null fields; in strict mode it fails the query with the
one-based number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.schemas import FEATURE12

NAMES = [f[0] for f in FEATURE12]
TYPES = dict((f[0], f[1]) for f in FEATURE12)
DEFAULTS = dict((f[0], f[2]) for f in FEATURE12)


def _check(n: int) -> None:
    if not 3 <= n <= 12:
        raise ValueError(f"number of fields must be within 3..12, not {n}")


def colour(text: Column) -> Column:
    """r,g,b as one signed number with full opacity; 0 and . are 0; null if it is no colour."""
    parts = F.split(text, ",", 3)
    rgb = [F.try_element_at(parts, F.lit(k)).try_cast("int") for k in (1, 2, 3)]
    fits = rgb[0].between(0, 255) & rgb[1].between(0, 255) & rgb[2].between(0, 255)
    packed = (F.lit(-16777216) + rgb[0] * 65536 + rgb[1] * 256 + rgb[2]).cast("int")
    return F.when(text.isin("0", "."), F.lit(0)).when(fits, packed)


def colour_text(value: Column) -> Column:
    part = lambda k: F.shiftright(value, k).bitwiseAND(F.lit(255)).cast("string")
    return F.when(value == 0, F.lit("0")).otherwise(F.concat_ws(",", part(16), part(8), part(0)))


def int_list(text: Column, size: Column) -> Column:
    """The first `size` numbers of a comma-separated list; null if there are fewer."""
    found = F.transform(F.slice(F.split(text, ","), F.lit(1), F.greatest(size, F.lit(0))), lambda x: x.try_cast("int"))
    return F.when((F.size(found) == size) & ~F.exists(found, lambda x: x.isNull()), found)


def unpack(rows: DataFrame, n: int = 12, extra: bool = True, delimiter: str = "\t", omit_empty: bool = False, strict: bool = True) -> DataFrame:
    """Typed features of (chrom, start, end, rest): the first n fields are standard, the others extra_fields."""
    _check(n)
    pattern = "\\Q" + delimiter + "\\E"
    parts = F.split("rest", pattern, -1 if extra or omit_empty else n - 2)
    if omit_empty:
        parts = F.filter(F.transform(parts, F.trim), lambda x: x != "")
        if not extra:
            parts = F.when(F.size(parts) > n - 2, F.concat(F.slice(parts, 1, n - 3), F.array(F.array_join(F.slice(parts, F.lit(n - 2), F.size(parts)), delimiter)))).otherwise(parts)
    rows = rows.withColumn("_p", F.when(F.col("rest") == "", F.array().cast("array<string>")).otherwise(parts))
    at = lambda k: F.try_element_at("_p", F.lit(k - 2))  # noqa: E731  field k from 3 on
    number = lambda k: F.when(at(k) == ".", F.lit(0)).otherwise(at(k).try_cast("int"))
    made: dict[str, Column] = {}
    faults = [F.when(F.size("_p") < n - 3, F.struct((F.size("_p") + 3).alias("field"), F.lit("field is missing").alias("reason")))]
    fault = lambda k, bad, what: faults.append(F.when(bad, F.struct(F.lit(k).alias("field"), F.concat(F.lit(f"{NAMES[k]} value "), at(k), F.lit(what)).alias("reason"))))
    for k in range(3, 12):
        name = NAMES[k]
        if k >= n:
            made[name] = F.lit(DEFAULTS[name]).cast(TYPES[name])
        elif name == "name":
            made[name] = F.when(at(k) == "", F.lit(".")).otherwise(at(k))
        elif name == "strand":
            made[name] = F.when(at(k) == "", F.lit(".")).otherwise(F.substring(at(k), 1, 1))
            fault(k, ~made[name].isin("+", "-", "."), " is not a strand")
        elif name == "item_rgb":
            made[name] = colour(at(k))
            fault(k, made[name].isNull(), " is not a comma-separated RGB")
        elif name in ("block_sizes", "block_starts"):
            count = F.coalesce(made["block_count"], F.lit(0))
            found = int_list(at(k), count)
            made[name] = F.when(count > 0, found)
            fault(k, (count > 0) & found.isNull(), " is not a list of block_count integers")
        else:
            made[name] = number(k)
            fault(k, made[name].isNull(), " is not an integer")
    tail = F.slice("_p", F.lit(n - 2), F.greatest(F.size("_p") - (n - 3), F.lit(0)))
    empty = (F.size(tail) == 0) | ((F.size(tail) == 1) & (F.element_at(tail, 1) == ""))
    made["extra_fields"] = F.when(~empty, tail) if extra else F.lit(None).cast("array<string>")
    out = rows.withColumn("error", F.coalesce(*faults))
    if strict:
        failed = F.raise_error(F.concat_ws("", F.lit("field "), (F.col("error.field") + 1).cast("string"), F.lit(": "), F.col("error.reason"), F.lit(" in "), "chrom", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))
        return out.select(F.when(F.col("error").isNotNull(), failed.cast("string")).otherwise(F.col("chrom")).alias("chrom"), "start", "end", *(c.alias(k) for k, c in made.items()))
    fine = F.col("error").isNull()
    return out.select("chrom", "start", "end", *(F.when(fine, c).alias(k) for k, c in made.items()), "error")


def pack(rows: DataFrame, n: int = 12, extra: int | None = None, delimiter: str = "\t") -> DataFrame:
    """(chrom, start, end, rest) of typed features; extra: how many extra fields are written, None for all."""
    _check(n)
    blocks = lambda name: (
        F.when(F.col("block_count") == 0, F.lit("."))
        .when(F.coalesce(F.size(name), F.lit(0)) != F.col("block_count"), F.raise_error(F.concat(F.lit(f"{name} differ from block_count at "), "chrom", F.lit(":"), F.col("start").cast("string"))).cast("string"))
        .otherwise(F.array_join(F.transform(name, lambda x: x.cast("string")), ","))
    )
    how = {"name": F.when(F.col("name") == "", F.lit(".")).otherwise(F.col("name")), "item_rgb": colour_text(F.col("item_rgb")), "block_sizes": blocks("block_sizes"), "block_starts": blocks("block_starts")}
    fields = [F.array(how.get(c, F.col(c)).cast("string")) for c in NAMES[3:n]]
    own = F.coalesce("extra_fields", F.array().cast("array<string>"))
    if extra is not None:
        short = (F.size(own) > 0) & (F.size(own) < extra)
        own = F.when(short, F.raise_error(F.lit("too few extra fields")).cast("array<string>")).otherwise(F.slice(own, 1, extra))
    return rows.select("chrom", "start", "end", F.array_join(F.concat(*fields, own), delimiter).alias("rest"))


def field(i: int, n: int = 12, extra: int | None = None) -> Column:
    """Field i of a typed feature as text; null where it has none."""
    count = F.coalesce(F.size("extra_fields"), F.lit(0)) if extra is None else F.lit(extra)
    if i < min(n, 12):
        c = F.col(NAMES[i])
        return F.array_join(F.transform(c, lambda x: x.cast("string")), ",") if TYPES[NAMES[i]].startswith("array") else c.cast("string")
    return F.when(F.lit(i) < n + count, F.try_element_at("extra_fields", F.lit(i - n + 1)))


TYPED = tuple(name for name, _, _ in FEATURE12)


def typed(prefix: str = "") -> Column:
    """All fields of a typed feature, arrays and nulls too, as one value."""
    return F.struct(*(F.col(prefix + c).alias(c) for c in TYPED))


def same(left: str, right: str) -> Column:
    """Whether the typed features in the columns with two prefixes are equal in every field; null equals null."""
    return typed(left).eqNullSafe(typed(right))


def hashed(prefix: str = "") -> Column:
    """A hash that equal typed features share."""
    return F.xxhash64(typed(prefix))


def described(prefix: str = "") -> Column:
    """A typed feature as text, for reading: its fields by name, without those that are null."""
    return F.to_json(typed(prefix))
