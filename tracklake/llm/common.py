"""What the corpus operators share: the shared folder, written tables, word arrays and components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local master (tests) may go without that setting; it then gets a temporary folder.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark.sparkContext, "_tracklake_dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-tracklake-")
        spark.sparkContext._tracklake_dir = found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts the lineage there."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table written by save() that nothing reads any more."""
    spark = df.sparkSession
    bare = lambda path: path.partition("://")[2].rpartition("//")[2].lstrip("/") if "://" in path else path.removeprefix("file:").lstrip("/")
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if bare(path).startswith(bare(shared_dir(spark)) + "/"):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Ids that are broadcast at most: 16 MB of them.
BROADCAST_IDS = 2_000_000


def own_name() -> str:
    """A column name that no table has."""
    return f"_{uuid.uuid4().hex}"


def picked(documents: DataFrame, ids: DataFrame, how: str = "left_semi", column: str = "doc_id", most: int = BROADCAST_IDS) -> DataFrame:
    """The rows of documents whose id is among ids (a written table with one column), or with left_anti is not; nulls are equal.

    Up to `most` ids go to the tasks that read documents, so that no text moves; more are joined by a shuffle.
    """
    name = own_name()
    ids = ids.toDF(name)
    if ids.count() <= most:
        ids = F.broadcast(ids)
    return documents.join(ids, documents[column].eqNullSafe(F.col(name)), how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(work):
    """The work of a task, which at its end gives back what its worker holds and does not use; workers serve many stages."""

    def run(batches):
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library can
            ctypes.CDLL(None).malloc_trim(0)

    return run


def own_copy(texts: pa.Array) -> pa.Array:
    """The array without an offset; some string kernels go wrong on slices."""
    return texts.take(pa.array(np.arange(len(texts))))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """A batch's text column as large strings, null as empty."""
    return pc.fill_null(own_copy(batch.column(column)).cast(pa.large_string()), "")


def words_of(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """The words [^\\x20\\x09-\\x0D]+ of each text: for each word its text's place, and the words.

    Only A-Z are lower-cased.
    """
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    words = lists.values if isinstance(lists, (pa.ListArray, pa.LargeListArray)) else lists.flatten()
    offsets = np.asarray(lists.offsets)
    words = words.slice(offsets[0], offsets[-1] - offsets[0])
    at = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(offsets))
    full = np.asarray(pc.greater(pc.binary_length(words), 0)) if len(words) else np.zeros(0, bool)
    if not full.all():
        words, at = words.filter(pa.array(full)), at[full]
    return at, words


def hashes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """A fixed 64-bit hash for each word; also the dictionary code of each word and the dictionary."""
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    codes = np.asarray(coded.indices).astype(np.int64)
    names = coded.dictionary
    own = pd.util.hash_array(names.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(names) else np.zeros(0, np.uint64)
    return own[codes] if len(codes) else np.zeros(0, np.uint64), codes, names


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer over uint64 whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows that lie within one text, and their texts' places."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = at[n - 1 :] == at[: len(at) - n + 1]
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return mix(out[whole]), at[n - 1 :][whole]


def row_slices(at: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each text's run in an ascending array of places."""
    return np.searchsorted(at, np.arange(n + 1))


def edges_of(pairs: DataFrame) -> DataFrame:
    """The distinct edges (a < b) of pairs (a, b), written."""
    return save(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")


def components(edges: DataFrame, rounds: int = 60, written: bool = False) -> DataFrame:
    """Connected components of edges (a, b long): node, component (the smallest node reachable).

    Each round every node points to the neighbour, or itself, that is least in a random order,
    pointers are followed once, and the edges are contracted. An order is drawn anew every second round, by which their
    number falls by a constant factor whatever the shape of the graph; the round that keeps an order ends stars,
    whose middle then is the least. Rounds are written tables. Nulls may not occur. Edges that edges_of() has
    written are read as they are, and are gone afterwards.
    """
    spark = edges.sparkSession
    edges = edges if written else edges_of(edges)
    label = None
    for k in range(rounds):
        if edges.isEmpty():
            break
        rank = lambda c: F.xxhash64(F.col(c), F.lit(k // 2))  # noqa: E731, B023
        both = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).union(edges.select("b", "a"))
        least = both.groupBy("n").agg(F.min(F.struct(rank("m").alias("r"), F.col("m"))).alias("best"))
        point = save(least.select("n", F.when(F.col("best.r") < rank("n"), F.col("best.m")).otherwise(F.col("n")).alias("to")), "point")
        nxt = point.select(F.col("n").alias("to"), F.col("to").alias("to2"))
        point2 = save(point.join(nxt, "to").select("n", F.col("to2").alias("to")), "point")
        pa_, pb = point2.select(F.col("n").alias("a"), F.col("to").alias("x")), point2.select(F.col("n").alias("b"), F.col("to").alias("y"))
        fresh = save(edges.join(pa_, "a").join(pb, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if label is None:
            label_next = point2.select("n", F.col("to").alias("root"))
            label_next = save(label_next, "label")
        else:
            step = point2.select(F.col("n").alias("root"), F.col("to").alias("up"))
            label_next = save(label.join(step, "root", "left").select("n", F.coalesce("up", "root").alias("root")), "label")
            drop(label)
        for old in (edges, point, point2):
            drop(old)
        edges, label = fresh, label_next
    else:
        raise RuntimeError("components did not converge")
    if label is None:
        return spark.createDataFrame([], "node long, component long")
    least = label.groupBy("root").agg(F.min("n").alias("component"))
    return label.join(least, "root").select(F.col("n").alias("node"), "component")
