"""Best-fit packing by hierarchical residual merging.

Texts become token ids as the tokenizers library gives them, each document ends with id 0, and only documents longer than the capacity are cut: into full pieces, of which the first may be
shorter. Every scan task packs its own pieces by best fit, longest first. Bins whose free space is at most
SLACK are final. The others are items of the next round: they are dealt by a hash of the bin to
FAN times fewer groups than before, and best fit merges whole bins. Rounds go on until one group is left or a
round closes no gap any more; a group never gets more than GROUP bins on average, so no task holds all of them. A
merged bin takes the least of its parts' numbers, which stays unique.

Defined cases: a null or empty text is the single id 0; repeated rows and rows without doc_id are
packed like all others; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.bpe import PATTERN, steps, vocabulary, vocabulary_path
from tracklake.llm.common import save, tidy

CAPACITY = 2048
#: Free tokens at which a bin is nearly full.
SLACK = 8
FAN, GROUP = 8, 50_000
END_ID = 0

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


class Tokenizer:
    """Ids of texts as the tokenizers library gives them.

    tiktoken merges by the rank of the token that a pair makes. That is the library's order where every
    merge makes one token and their ids rise with their ranks, as in a trained byte-level file; it is then used, as it
    takes a quarter of the time. Other files, and texts whose white space is too much for its pattern, go through
    the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.fast = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        v = vocabulary(path)
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        plain = plain and not any(t.get(k) for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip", "normalized"))
        made = np.array([m for _, m in v.ranks.values()])
        if plain and (np.diff(made) > 0).all():
            ranks = {b: k for b, k in v.ids.items() if v.special.get(b.decode("utf-8", "replace")) != k}
            self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=v.special)

    @cached_property
    def library(self):
        from tokenizers import Tokenizer as Library

        found = Library.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, best fit with the longest first; the fill of each bin."""
    place, offset, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    free: dict[int, list[int]] = {}
    sizes: list[int] = []  # free sizes that some bin has, ascending
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        at = bisect_left(sizes, n)
        if at < len(sizes):
            size = sizes[at]
            b = free[size].pop()
            if not free[size]:
                del free[size], sizes[at]
        else:
            b, size = len(fill), capacity
            fill.append(0)
        place[k], offset[k] = b, fill[b]
        fill[b] += n
        if size > n:
            if size - n not in free:
                free[size - n] = []
                insort(sizes, size - n)
            free[size - n].append(b)
    return place, offset, np.asarray(fill, np.int64)


def cut(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of each piece of a document's ids and its end."""
    data = memoryview(np.append(ids, END_ID).astype("<u4").tobytes())
    n = len(ids) + 1
    lo, piece = 0, 0
    while lo < n:
        hi = lo + ((n % capacity or capacity) if lo == 0 else capacity)
        yield piece, lo, hi - lo, zlib.crc32(data[4 * lo : 4 * hi])
        lo, piece = hi, piece + 1


def _first(path: str, capacity: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, got, begin = Tokenizer(path), [], TaskContext.get().partitionId() << 33

        def packed() -> pa.RecordBatch:
            nonlocal begin
            doc = pa.concat_arrays([d for d, _ in got])
            rest = np.concatenate([r for _, r in got])
            place, offset, fill = best_fit(rest[:, 2], capacity)
            columns = [doc, pa.array(rest[:, 0].astype(np.int32)), pa.array(rest[:, 1]), pa.array(rest[:, 2]), pa.array(rest[:, 3]), pa.array(begin + place), pa.array(offset), pa.array(fill[place])]
            begin += len(fill)
            got.clear()
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for lo, texts in steps(batch):
                rows = np.array([(k, *x) for k, text in enumerate(texts) for x in cut(t.ids(text.as_py()), capacity)], np.int64)
                got.append((batch.column("doc_id").cast(pa.int64()).take(pa.array(lo + rows[:, 0])), rows[:, 1:]))
                if sum(len(d) for d, _ in got) >= 4 * GROUP:
                    yield packed()
        if got:
            yield packed()

    return work


def _merge(capacity: int):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bin", "offset"], kind="stable")
        bins = pdf.groupby("bin", sort=True)["fill"].first()
        place, offset, fill = best_fit(bins.to_numpy(), capacity)
        least = np.full(len(fill), np.iinfo(np.int64).max)
        np.minimum.at(least, place, bins.index.to_numpy())
        at = np.searchsorted(bins.index.to_numpy(), pdf["bin"].to_numpy())
        return pdf.assign(bin=least[place[at]], offset=pdf["offset"].to_numpy() + offset[at], fill=fill[place[at]])[[c.split()[0] for c in SCHEMA.split(", ")]]

    return work


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, slack: int = SLACK, fan: int = FAN, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of documents."""
    path = path or vocabulary_path()
    now = save(documents.select("doc_id", "text").mapInArrow(tidy(_first(path, capacity)), SCHEMA), "packed")
    full = F.col("fill") >= capacity - slack
    done, groups, before = [], None, None
    while True:
        done.append(now.where(full))
        left = now.where(~full)
        n, where = left.where("offset = 0").agg(F.count("*"), F.approx_count_distinct(F.shiftright("bin", 33))).first()
        if groups == 1 or n <= 1 or (before is not None and n > 0.97 * before and groups * fan > before / group):
            break
        least = -(-n // group)
        groups = max(least, -(-(groups or int(where)) // fan))
        before = n
        dealt = left.withColumn("group", F.pmod(F.xxhash64("bin", F.lit(groups)), F.lit(groups)))
        now = save(dealt.groupBy("group").applyInPandas(_merge(capacity), SCHEMA), "packed")
    out = left
    for part in done:
        out = out.unionByName(part)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
