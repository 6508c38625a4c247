"""Row shapes of the interval tables."""

from __future__ import annotations

from pyspark.sql import types as T

KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType()}


def shape(fields: str) -> T.StructType:
    """A row shape from "name type, name type"; needs no session."""
    return T.StructType([T.StructField(n, KINDS[k]) for n, k in (f.split() for f in fields.split(", "))])


FEATURE = shape("chrom string, start int, end int, rest string")
SIGNAL = shape("chrom string, start int, end int, score float")
SIZES = shape("chrom string, size int")
TILE = shape("dataset string, tile int, track int, start int, end int, value float")
ZOOM = shape("chrom string, start int, end int, count long, min double, max double, sum double, sum_squares double")
SECTION = shape("chrom string, start int, end int, step int, span int, kind string, items int")
TILES_READ = shape("dataset string, tile int, start int, end int, items int")
SUMMARY = shape("chrom string, bin long, count long, min double, max double, sum double, sum_squares double")

#: The typed feature: its fields in order, their Spark types, and what a missing field is.
FEATURE12 = (
    ("chrom", "string", None),
    ("start", "int", None),
    ("end", "int", None),
    ("name", "string", "."),
    ("score", "int", 0),
    ("strand", "string", "."),
    ("thick_start", "int", 0),
    ("thick_end", "int", 0),
    ("item_rgb", "int", 0),
    ("block_count", "int", 0),
    ("block_sizes", "array<int>", None),
    ("block_starts", "array<int>", None),
    ("extra_fields", "array<string>", None),
)
