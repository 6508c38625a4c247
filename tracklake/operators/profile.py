"""Profile of rows as they are written: counts, and the first row that breaks their order, in one pass without a sort.

Each task reads its splits in the order of their rows and leaves a state for each: its first and last row, where each
chromosome first comes, its counts and the first fault inside it. States are few, and merge: neighbours are compared by their number,
and a chromosome that comes again must go on from the end of the split before. The order is that of files by name and of rows within.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.operators import ranks

CHROM, START = "must be sorted by chromosome", "must be sorted by start"
STATE = "file string, split long, first long, items long, length long, first_chrom string, first_start int, last_chrom string, last_start int, fault long, reason string, chroms array<struct<chrom: string, at: long>>"
PLACE = ("file", "split", "row", "chrom", "start", "end")


def as_written(spark: SparkSession, path: str, *columns) -> DataFrame:
    """file, split, row and the columns (chrom, start, end) of Parquet files; row is the row's number in its file."""
    return spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.row_index").alias("row"), *columns)


class _Split:
    """The state of one split while its rows come."""

    def __init__(self, file: str, split: int, row: int, chrom: str, start: int):
        self.key, self.first, self.head = (file, split), row, (chrom, start)
        self.last, self.items, self.length, self.fault, self.reason = None, 0, 0, None, None
        self.chroms: dict[str, int] = {}

    def add(self, row: np.ndarray, chrom: np.ndarray, names: list, start: np.ndarray, end: np.ndarray) -> None:
        """More rows of the split; chrom: their places in names."""
        if self.fault is None and (found := self._fault(chrom, names, start)):
            self.fault, self.reason = int(row[found[0]]), found[1]
        for code, at in zip(*np.unique(chrom, return_index=True), strict=True):
            self.chroms.setdefault(names[code], int(row[at]))
        self.last = (names[chrom[-1]], int(start[-1]))
        self.items, self.length = self.items + len(row), self.length + int((end.astype(np.int64) - start).sum())

    def _fault(self, chrom: np.ndarray, names: list, start: np.ndarray) -> tuple[int, str] | None:
        """The place of the first row that breaks the order, and why."""
        goes_on = self.last is not None and names[chrom[0]] == self.last[0]
        if goes_on and start[0] < self.last[1]:
            return 0, START
        switches = np.flatnonzero(chrom[1:] != chrom[:-1]) + 1
        falls = np.flatnonzero((start[1:] < start[:-1]) & (chrom[1:] == chrom[:-1])) + 1
        found = [(int(falls[0]), START)] if len(falls) else []
        seen = set(self.chroms)
        for at in ([] if goes_on else [0]) + switches.tolist():  # ends at the first that comes again, so few steps
            if names[chrom[at]] in seen:
                found.append((at, CHROM))
                break
            seen.add(names[chrom[at]])
        return min(found, default=None)

    def row(self) -> tuple:
        return (*self.key, self.first, self.items, self.length, *self.head, *self.last, self.fault, self.reason, [{"chrom": c, "at": at} for c, at in self.chroms.items()])


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: _Split | None = None
    done = []
    for batch in batches:
        if not batch.num_rows:
            continue
        files, chroms = batch.column(0).dictionary_encode(), batch.column(3).dictionary_encode()
        file, names = np.asarray(files.indices), chroms.dictionary.to_pylist()
        split, row, start, end = (np.asarray(batch.column(k)) for k in (1, 2, 4, 5))
        chrom = np.asarray(chroms.indices)
        cuts = np.concatenate([[0], np.flatnonzero((file[1:] != file[:-1]) | (split[1:] != split[:-1])) + 1, [len(file)]])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            key = (files.dictionary[int(file[lo])].as_py(), int(split[lo]))
            if state is None or state.key != key:
                done += [state] if state else []
                state = _Split(*key, int(row[lo]), names[chrom[lo]], int(start[lo]))
            state.add(row[lo:hi], chrom[lo:hi], names, start[lo:hi], end[lo:hi])
    done += [state] if state else []
    for s in done:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("chrom", pa.string()), ("at", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(s.row(), kinds, strict=True)], names=[f.split()[0] for f in STATE.split(", ")[:11]] + ["chroms"])


def splits(rows: DataFrame) -> DataFrame:
    """The state of each split of rows (file, split, row, chrom, start, end) in the order they are read, and nth, its number."""
    return ranks.ranked(rows.select(*PLACE).mapInArrow(_states, STATE).withColumn("all", F.lit(0)), ("all",), ("file", "split"), "nth").drop("all")


def faults(states: DataFrame) -> DataFrame:
    """file, row, reason of the first fault that each split has by itself, and of those that its place after the others makes."""
    own = states.where("fault IS NOT NULL").select("file", F.col("fault").alias("row"), "reason", "nth")
    before = states.select((F.col("nth") + 1).alias("nth"), F.col("last_chrom").alias("c"), F.col("last_start").alias("s"))
    between = states.join(before, "nth").where("first_chrom = c AND first_start < s").select("file", F.col("first").alias("row"), F.lit(START).alias("reason"), "nth")
    each = states.select("file", "nth", "first", "first_chrom", "last_chrom", F.explode("chroms").alias("x")).select("*", "x.chrom", "x.at")
    order = Window.partitionBy("chrom").orderBy("nth")
    back = each.withColumns({"seen": F.lag("nth").over(order), "ended": F.lag("last_chrom").over(order)}).where("seen IS NOT NULL")
    goes_on = (F.col("seen") == F.col("nth") - 1) & (F.col("ended") == F.col("chrom")) & (F.col("first_chrom") == F.col("chrom"))
    again = back.where(~goes_on).select("file", F.col("at").alias("row"), F.lit(CHROM).alias("reason"), "nth")
    return own.unionByName(between).unionByName(again)


def profile(rows: DataFrame) -> DataFrame:
    """One row: chroms, items, total_length, sorted, and the first fault: file, row and reason, null where rows are in order."""
    from tracklake.shared import shared_path

    states, path = splits(rows), shared_path(rows.sparkSession, "states")
    states.write.parquet(path)
    states = rows.sparkSession.read.schema(states.schema).parquet(path)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    place = "struct<nth: bigint, row: bigint, reason: string, file: string>"
    counts = states.select("items", "length", none.alias("chrom"), F.lit(None).cast(place).alias("f"))
    chroms = states.select(zero.alias("items"), zero.alias("length"), F.explode("chroms.chrom").alias("chrom"), F.lit(None).cast(place).alias("f"))
    found = faults(states).select(zero.alias("items"), zero.alias("length"), none.alias("chrom"), F.struct("nth", "row", "reason", "file").cast(place).alias("f"))
    total = lambda c: F.coalesce(F.sum(c), zero)
    one = counts.unionByName(chroms).unionByName(found).agg(F.countDistinct("chrom").alias("chroms"), total("items").alias("items"), total("length").alias("total_length"), F.min("f").alias("f"))
    return one.select("chroms", "items", "total_length", F.col("f").isNull().alias("sorted"), F.col("f.file").alias("file"), F.col("f.row").alias("row"), F.col("f.reason").alias("reason"))
