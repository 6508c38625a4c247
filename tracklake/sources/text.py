"""Text forms of interval tracks: feature lines, bedGraph, WIG and chromosome sizes.

WIG lines depend on lines before them. Files are split as any text; a line's place is its split's offset and
its number within the split. The last declaration and the count of data lines run within blocks of a few thousand lines, and
what a block takes over from those before it is a prefix over the blocks of a file, so no task
reads a whole file or holds a whole split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.operators import ranks
from tracklake.schemas import SIZES
from tracklake.sources.layouts import file_system


#: Lines of a block within which declarations and counts run.
BLOCK = 1 << 12


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, split, line, value of plain or gzipped text; lines of zip archives likewise. path: a file, a folder or a pattern, or a list of these.

    Files tell by their own names whether they are archives, since a pattern or folder need not end like its files.
    """
    zips = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path")
    archived, text, file = zips.limit(1).count() > 0, spark.read.text(path), F.col("_metadata.file_path")
    if archived:
        text = text.where(~F.endswith(file, F.lit(".zip")))  # of file names alone, so that Spark leaves archives out when it plans the scan
    plain = text.select(file.alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"), "value")
    return plain.unionByName(_zipped(zips)) if archived else plain


def _zipped(names: DataFrame) -> DataFrame:
    """The first entry of each archive; an archive is read by one task, in pieces."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zipfile

        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, at = file_system(name)
                with fs.open_input_file(at) as source, zipfile.ZipFile(source) as z, z.open(z.infolist()[0]) as f:
                    k, held = 0, []
                    for raw in f:
                        held.append(raw.decode().rstrip("\r\n"))
                        if len(held) == 10_000:
                            yield _batch(name, k, held)
                            k, held = k + len(held), []
                    yield _batch(name, k, held)

    # Spark listed the files; without the content column it does not read them
    return names.repartition("path").mapInArrow(work, "file string, split long, line long, value string")


def _batch(name: str, first: int, held: list[str]) -> pa.RecordBatch:
    n = len(held)
    return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([0] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(held, pa.string())], names=["file", "split", "line", "value"])


def read_features(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """chrom, start, end, rest of feature lines: at most four tab-separated parts.

    strict: the query fails at lines without a start and an end; else these are null there.
    """
    parts = F.split("value", "\t", 4)
    part = lambda k: F.try_element_at(parts, F.lit(k))
    rows = lines(spark, path).withColumns({"chrom": parts[0], "start": part(2).try_cast("int"), "end": part(3).try_cast("int"), "rest": F.coalesce(part(4), F.lit(""))})
    if strict:
        rows = refused(rows, F.when(F.col("start").isNull() | F.col("end").isNull(), F.concat(F.lit("bad feature: "), "value")))
    return rows.select("chrom", "start", "end", "rest")


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=SIZES)


def parameters(value: Column) -> Column:
    """key=value pairs of a declaration as a map; double quotes go."""
    found = F.regexp_extract_all(value, F.lit(r'(\w+)=("[^"]*"|\S+)'), F.lit(0))
    pair = lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(F.regexp_extract(x, r"=(.*)$", 1), '^"|"$', "").alias("v"))
    return F.map_from_entries(F.array_distinct(F.transform(found, pair)))


def _running(rows: DataFrame, counted: Column, declared: Column) -> DataFrame:
    """nth and d: how many lines of a file up to each are counted, and the last of them that declares, given its nth.

    Both run within blocks of BLOCK lines, so that no task holds a split, however long; what a block takes over from those before it is one
    prefix over the blocks of its file.
    """
    block = ("_block", "file", "split")  # first the number, as it sorts fastest
    own = Window.partitionBy(*block).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumns({"_v": counted, "_d": declared, "_block": F.shiftright("line", BLOCK.bit_length() - 1)}).withColumn("_n", F.sum("_v").over(own))
    within = within.withColumn("_d", F.when(F.col("_d").isNotNull(), F.struct("_d.*", F.col("_n").alias("_at"), F.col("split").alias("_split"))))
    per_block = within.groupBy(*block).agg(F.sum("_v").alias("_t"), F.max_by("_d", F.when(F.col("_d").isNotNull(), F.col("line"))).alias("_last"))
    before = Window.partitionBy("file").orderBy("split", "_block").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.coalesce(F.sum("_t").over(before), F.lit(0))
    carried = per_block.select(*block, begun.alias("_begun"), "_last")
    carried = carried.withColumn("_last", F.when(F.col("_last").isNotNull(), F.struct("_last.*", (F.col("_last._at") + F.col("_begun")).alias("nth"))))
    carried = carried.select(*block, "_begun", last("_last").over(before).alias("_c"))
    placed = within.withColumn("_own", last("_d").over(own)).join(carried, [*block])
    d = F.when(F.col("_own").isNotNull(), F.struct("_own.*", (F.col("_own._at") + F.col("_begun")).alias("nth"))).otherwise(F.col("_c"))
    return placed.withColumn("nth", F.col("_n") + F.col("_begun")).withColumn("d", d)


def last(c) -> Column:
    return F.last(c, ignorenulls=True)


def refused(rows: DataFrame, fault: Column) -> DataFrame:
    """rows; the query fails where fault, a text, is not null, whatever columns are asked for."""
    return rows.where(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(True))


def parse_wig(rows: DataFrame, strict: bool = True) -> DataFrame:
    """file, section, chrom, start, end, score of WIG lines (file, split, line, value).

    strict: the query fails at other tracks, unexpected lines, declarations without what they need, data before a declaration
    and data that are no numbers; else such lines give no rows. Faults are raised in one place, at the end.
    """
    text = rows.withColumn("value", F.trim(F.regexp_replace("value", "[\r\t]", " "))).where("value <> '' AND NOT startswith(value, '#')")
    text = text.withColumn("word", F.substring_index("value", " ", 1))
    word, data = F.col("word"), F.col("word").rlike(r"^[-+0-9.NI]")
    p = parameters(F.col("value"))
    get = lambda k: F.try_element_at(p, F.lit(k))
    number = lambda k: get(k).try_cast("int")
    fixed, declares = word == "fixedStep", word.isin("variableStep", "fixedStep")
    wrong = lambda k: get(k).isNotNull() & number(k).isNull()
    fault = F.when((word == "track") & ~F.coalesce(get("type") == "wiggle_0", F.lit(False)), F.lit("track is not wiggle_0"))
    fault = fault.when(~word.isin("track", "browser", "variableStep", "fixedStep") & ~data, F.concat(F.lit("unexpected line: "), "value"))
    fault = fault.when(fixed & number("start").isNull(), F.lit("fixedStep needs a start"))
    fault = fault.when(declares & (get("chrom").isNull() | wrong("step") | wrong("span")), F.concat(F.lit("bad declaration: "), "value"))
    at = F.struct(F.concat_ws(":", F.col("split").cast("string"), F.col("line").cast("string")).alias("section"), "word", get("chrom").alias("chrom"), number("start").alias("start"), F.coalesce(number("step"), F.lit(1)).alias("step"), F.coalesce(number("span"), F.lit(1)).alias("span"))
    declared = _running(text.withColumn("fault", fault), F.when(data, 1).otherwise(0).cast("long"), F.when(declares, at))
    two = F.split("value", r"\s+")
    fixed = F.col("d.word") == "fixedStep"
    start = F.when(fixed, F.col("d.start") - 1 + (F.col("nth") - F.col("d.nth") - 1) * F.col("d.step")).otherwise(two[0].try_cast("int") - 1)
    score = F.when(fixed, two[0]).otherwise(F.try_element_at(two, F.lit(2))).try_cast("float")
    found = declared.where(data | F.col("fault").isNotNull()).withColumns({"start": start.cast("int"), "score": score})
    fault = F.coalesce("fault", F.when(F.col("d").isNull(), F.concat(F.lit("data before a declaration: "), "value")).when(F.col("start").isNull() | F.col("score").isNull(), F.concat(F.lit("bad data: "), "value")))
    found = refused(found, fault) if strict else found.where(fault.isNull())
    return found.select("file", F.col("d.section").alias("section"), F.col("d.chrom").alias("chrom"), "start", (F.col("start") + F.col("d.span")).cast("int").alias("end"), "score")


def read_wig(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return parse_wig(lines(spark, path), strict)


def parse_bedgraph(rows: DataFrame) -> DataFrame:
    """chrom, start, end, score of bedGraph lines.

    The query fails if the first line of a file, after comments and browser lines, is no track line, if a track line
    has another type, and at data that are no numbers.
    """
    text = rows.withColumn("value", F.trim("value")).where("value <> '' AND NOT startswith(value, '#') AND NOT startswith(value, 'browser')")
    kind = F.try_element_at(parameters(F.col("value")), F.lit("type"))
    track = F.startswith("value", F.lit("track"))
    first = text.groupBy("file").agg(F.min_by("value", F.struct("split", "line")).alias("first"))
    parts = F.split("value", r"\s+")
    part = lambda k, to: F.try_element_at(parts, F.lit(k)).try_cast(to)
    found = text.where(~track | ~F.coalesce(F.lower(kind) == "bedgraph", F.lit(False))).withColumns({"chrom": parts[0], "start": part(2, "int"), "end": part(3, "int"), "score": part(4, "float")})
    fault = F.when(track, F.lit("track is not bedGraph")).when(~F.startswith("first", F.lit("track")), F.lit("no track line"))
    fault = fault.when(F.col("start").isNull() | F.col("end").isNull() | F.col("score").isNull(), F.concat(F.lit("bad data: "), "value"))
    return refused(found.join(first, "file"), fault).select("chrom", "start", "end", "score")


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    return parse_bedgraph(lines(spark, path))


def shown(score: Column) -> Column:
    """A value as WIG writes it."""
    return F.when(F.isnan(score), F.lit("NaN")).when(score == F.lit(float("inf")), F.lit("Infinity")).when(score == F.lit(float("-inf")), F.lit("-Infinity")).otherwise(score.cast("string"))


def wig_text(rows: DataFrame) -> DataFrame:
    """One variableStep section, as text, for each chromosome and span of signal rows: chrom, span, part, value.

    A section is built in parts of LINES lines each, so that no row holds a whole chromosome, however many lines a position has.
    """
    line = F.concat((F.col("start") + 1).cast("string"), F.lit(" "), shown(F.col("score")))
    lines = rows.select("chrom", (F.col("end") - F.col("start")).alias("span"), "start", line.alias("line"))
    placed = ranks.ranked(lines, ("chrom", "span"), ("start", "line"), "place")
    parts = placed.groupBy("chrom", "span", F.floor(F.col("place") / LINES).alias("part")).agg(F.array_sort(F.collect_list(F.struct("start", "line"))).alias("items"))
    head = F.concat(F.lit("variableStep chrom="), "chrom", F.lit(" span="), F.col("span").cast("string"), F.lit("\n"))
    return parts.select("chrom", "span", "part", F.concat(head, F.array_join(F.transform("items", lambda x: x["line"]), "\n")).alias("value"))


#: Lines of one written section.
LINES = 1 << 12


def write_wig(rows: DataFrame, path: str, name: str = "track", description: str = "") -> None:
    """WIG files of signal rows, sections in order within each file; every file has its own track line."""
    track = f'track type=wiggle_0 name="{name}" description="{description}"'
    text = wig_text(rows).repartitionByRange("chrom", "span", "part").sortWithinPartitions("chrom", "span", "part")
    text.select(F.concat(F.lit(track + "\n"), "value").alias("value")).write.text(path)


def bedgraph_text(rows: DataFrame) -> DataFrame:
    """chrom, part, value: LINES lines of a chromosome, in order, as text."""
    placed = ranks.ranked(rows.select("chrom", "start", "end", "score"), ("chrom",), ("start", "end", "score"), "place")
    item = F.struct("start", "end", "score", bedgraph_line().alias("line"))
    parts = placed.groupBy("chrom", F.floor(F.col("place") / LINES).alias("part")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return parts.select("chrom", "part", F.array_join(F.transform("items", lambda x: x["line"]), "\n").alias("value"))


def write_bedgraph(rows: DataFrame, path: str, name: str = "track") -> None:
    """bedGraph files of signal rows, in order within each file, each part under a track line."""
    text = bedgraph_text(rows).repartitionByRange("chrom", "part").sortWithinPartitions("chrom", "part")
    text.select(F.concat(F.lit(f'track type=bedGraph name="{name}"\n'), "value").alias("value")).write.text(path)


def bedgraph_line() -> Column:
    return F.concat_ws(" ", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), shown(F.col("score")))
