"""Language-model scores by a weighted backoff automaton over corpus-wide n-gram counts.

Tokens are the words of a text, A-Z lower-cased, and one end. States are the contexts of
fewer than `order` tokens that training texts hold; the state of order k reads x with probability
(c(context x) + MU * p(x | shorter context)) / (c(context) + MU), its failure arc leads to the state of the shorter
context with weight MU / (c(context) + MU), and the empty context reads x with (c(x) + 0.1) / (N + 0.1 (V + 1)).
Every state's probabilities sum to one over the vocabulary and one unknown token. So an arc holds the probability of a token
that training texts hold after the state's context; any other token takes the failure arc's weight and is read by the state
there. Scoring goes from left to right once and carries the state; a block's texts advance together, token by token.

No vocabulary or n-gram table is ever in one place. The corpus is written in blocks of about BLOCK_BYTES of text.
1. Each block sends its distinct n-grams, 64-bit hashes in ascending order with their counts in its
   training texts, to shards by ranges of the hash.
2. A shard adds up the counts of all blocks and answers each block with the totals of its n-grams,
   in the same order, so that hashes travel once.
3. Each block builds the automaton of the states and arcs that its texts can meet, from the answers it has got, and its texts
   go through it.
A frequent word or pair is one entry for each block, so no shard is hot, and all that is
gathered grows with the corpus. No n-gram is cut off.

Defined cases: a null text is the end alone; a null doc_id counts as the text '' (held out); repeated
rows count and are scored each; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.bpe import steps
from tracklake.llm.common import hashes_of, mix, new_path, words_of

ORDER = 2
MU = 200.0
HELD = 10
BLOCK_BYTES = 10 << 20
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def planes(x: np.ndarray) -> bytes:
    """Eight-byte numbers with their first bytes together, then their second ones, and so on: those of small numbers compress well."""
    return np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)


def rising(x: np.ndarray) -> bytes:
    return planes(np.diff(x, prepend=np.uint64(0)))


def unrising(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data), dtype=np.uint64)


def blocks(documents: DataFrame, most: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """The texts in blocks, each a file of its own, and the number of blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 20, 0
        for batch in batches:
            for lo, texts in steps(batch):
                if held and held + texts.nbytes > most:
                    block, held = block + 1, 0
                held += texts.nbytes
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(texts)).cast(pa.int64()), texts.cast(pa.string()), pa.array(np.full(len(texts), block))], names=["doc_id", "text", "block"])

    spark, path = documents.sparkSession, new_path(documents.sparkSession, "blocks")
    made = documents.select("doc_id", "text").mapInArrow(work, "doc_id long, text string, block long")
    made.write.partitionBy("block").option("compression", "zstd").parquet(path)
    found = spark.read.schema(made.schema).parquet(path)
    return found, found.select("block").distinct().count()


class Tokens:
    """A block's tokens: the n-gram hashes that end at each, for each order, their texts and what is held out."""

    def __init__(self, ids: list, texts: pa.Array, order: int):
        n = len(ids)
        at, words = words_of(texts)
        h, _, _ = hashes_of(words)
        ends = np.cumsum(np.bincount(at, minlength=n)) + np.arange(n)
        self.n, self.size = n, np.bincount(at, minlength=n) + 1
        flat = np.full(len(h) + n, END, np.uint64)
        inside = np.ones(len(flat), bool)
        inside[ends] = False
        flat[inside] = h
        self.at = np.repeat(np.arange(n), self.size)
        self.held = np.fromiter((zlib.crc32(b"" if d is None else str(d).encode()) % HELD == 0 for d in ids), bool, n)
        place = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(self.size)[:-1]]) if n else np.zeros(0, np.int64), self.size)
        self.grams, before = [mix(flat)], flat
        with np.errstate(over="ignore"):
            gram = flat.copy()
            for k in range(1, order):
                before = np.concatenate([[START], before[:-1]]) if len(before) else before
                before = np.where(place < k, START, before)
                # k earlier tokens, the farthest hashed last; START stands for those before the text
                gram = mix(gram) * np.uint64(0x9E3779B97F4A7C15) + before
                self.grams.append(mix(gram + np.uint64(k)))


def uniques(t: Tokens) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct n-grams in ascending order, and each token's place among them, for each order."""
    return [np.unique(g, return_inverse=True) for g in t.grams]


def _block_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, pa.Array]]:
    """(block, doc_ids, texts) of each block; a block's rows come one after the other."""
    now, ids, parts = None, [], []
    for batch in batches:
        block = np.asarray(batch.column("block"))
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if block[a] != now:
                if now is not None:
                    yield now, ids, pa.concat_arrays(parts)
                now, ids, parts = int(block[a]), [], []
            ids += batch.column("doc_id").slice(a, b - a).to_pylist()
            parts.append(batch.column("text").slice(a, b - a).take(pa.array(np.arange(b - a))).cast(pa.large_string()))
    if now is not None:
        yield now, ids, pa.concat_arrays(parts)


def _send(order: int, shards: int):
    edges = np.array([(k << 64) // shards for k in range(1, shards)], np.uint64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in _block_runs(batches):
            t = Tokens(ids, texts, order)
            train = ~t.held[t.at]
            for k, (keys, back) in enumerate(uniques(t)):
                counts = np.bincount(back, train, len(keys)).astype(np.uint64)
                cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                rows = [(s, k + 1, block, rising(keys[a:b]), planes(counts[a:b])) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "n", "block", "grams", "counts"])

    return work


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = [unrising(x) for x in pdf.grams]
    size = [len(k) for k in keys]
    counts = np.concatenate([unplaned(x) for x in pdf.counts])
    order = np.argsort(flat := np.concatenate(keys), kind="stable")
    ranked = flat[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    group = np.cumsum(fresh) - 1
    sums = np.add.reduceat(counts[order], np.flatnonzero(fresh))
    total = np.empty(len(flat), np.uint64)
    total[order] = sums[group]
    cuts = np.cumsum(size)[:-1]
    first = np.arange(len(pdf)) == 0
    return pd.DataFrame({"block": pdf.block, "n": pdf.n, "shard": pdf.shard, "totals": [planes(x) for x in np.split(total, cuts)], "v": np.where(first, int((sums > 0).sum()), 0), "c": np.where(first, int(sums.sum()), 0)})


class Automaton:
    """The weighted backoff automaton of a block's n-grams.

    State 0 is the empty context, state k the k marks that stand before a text; then come the contexts
    of 1, 2, ... tokens that training texts hold. `fail` and `backoff` are each state's failure arc; an arc, found by
    `key` (state and token, ascending), has a log-probability and leads to the longest state that its words end with.
    """

    def __init__(self, t: Tokens, found: list[tuple[np.ndarray, np.ndarray]], totals: list[np.ndarray], n_train: int, v: int, n_docs: int, mu: float):
        order, self.tokens = len(totals), max(1, len(totals[0]))
        back = [b for _, b in found]
        at = [np.unique(b, return_index=True)[1] for b in back]  # where each n-gram ends for the first time
        begins = np.zeros(len(t.at), bool)
        begins[np.cumsum(t.size) - t.size] = True
        closed = np.roll(begins, -1)  # after an end nothing is read
        marks = np.arange(order) if n_docs else np.zeros(order, np.int64)
        self.start = int(marks[-1])
        size = [np.full(order, n_docs, np.float64)]
        fail = [np.maximum(np.arange(order) - 1, 0)]
        node, states = [np.zeros(1, np.int64)], order
        for k in range(1, order):
            below = node[k - 1][back[k - 2][at[k - 1]]] if k > 1 else np.zeros(len(totals[0]), np.int64)
            known = (totals[k - 1] > 0) & ~closed[at[k - 1]]
            own = below.copy()
            own[known] = states + np.arange(known.sum())
            states += int(known.sum())
            node.append(own)
            size.append(totals[k - 1][known])
            fail.append(below[known])
        self.fail, self.size = np.concatenate(fail), np.concatenate(size)
        self.backoff = np.log10(mu / (self.size + mu))
        keys, logs, to = [], [], []
        p = (totals[0] + 0.1) / (n_train + 0.1 * (v + 1))
        for k in range(order):
            end = at[k]
            if k:
                before = np.where(begins[end], marks[k], node[k][back[k - 1][end - 1]])
                context = np.where(begins[end], n_docs, totals[k - 1][back[k - 1][end - 1]])
                lower = p[back[k - 1][end]]
                p = np.where(context > 0, (totals[k] + mu * lower) / (context + mu), lower)
                arcs = totals[k] > 0
            else:
                before, arcs = np.zeros(len(end), np.int64), np.ones(len(end), bool)  # the empty context reads every token
            keys.append(before[arcs] * self.tokens + back[0][end[arcs]])
            logs.append(np.log10(p[arcs]))
            longest = min(k + 1, order - 1)
            to.append(node[longest][back[longest - 1][end[arcs]]] if longest else np.zeros(int(arcs.sum()), np.int64))
        keys, logs, to = (np.concatenate(x) for x in (keys, logs, to))
        rank = np.argsort(keys, kind="stable")
        self.key, self.log, self.to = keys[rank], logs[rank], to[rank]

    def read(self, tokens: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The log-probability of each text: size tokens each, one text after the other."""
        rank = np.argsort(-size, kind="stable")
        begin, left = (np.cumsum(size) - size)[rank], -size[rank]
        total, state = np.zeros(len(size)), np.full(len(size), self.start, np.int64)
        for step in range(int(size.max(initial=0))):
            n = int(np.searchsorted(left, -step, "left"))  # texts with a token here come first
            token, now, todo = tokens[begin[:n] + step], state[:n], np.arange(n)
            while len(todo):
                key = now[todo] * self.tokens + token[todo]
                k = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                hit = self.key[k] == key
                read, k = todo[hit], k[hit]
                total[read] += self.log[k]
                now[read] = self.to[k]
                todo = todo[~hit]
                total[todo] += self.backoff[now[todo]]
                now[todo] = self.fail[now[todo]]
        out = np.empty(len(size))
        out[rank] = total
        return out


def _score(order: int, mu: float, folder: str, n_train: int, v: int, n_docs: int):
    def answers(block: int) -> list[np.ndarray]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        got = pa.dataset.dataset(f"{root}/block={block}", filesystem=fs, format="parquet").to_table(columns=["n", "shard", "totals"]).sort_by([("n", "ascending"), ("shard", "ascending")])
        n = np.asarray(got["n"])
        data = got["totals"].to_pylist()
        return [np.concatenate([unplaned(data[i]) for i in np.flatnonzero(n == k + 1)]).astype(np.float64) for k in range(order)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in _block_runs(batches):
            t = Tokens(ids, texts, order)
            found, totals = uniques(t), answers(block)
            tokens = found[0][1]
            count = totals[0][tokens]
            base = np.bincount(t.at, np.log10((count + 0.1) / (n_train + 0.1 * (v + 1))), t.n)
            score = Automaton(t, found, totals, n_train, v, n_docs, mu).read(tokens, t.size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(t.held), pa.array(t.size.astype(np.int64)), pa.array(np.bincount(t.at, count > 0, t.n).astype(np.int64)), pa.array(np.full(t.n, n_train, np.int64)), pa.array(base), pa.array(score)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return work


def score(documents: DataFrame, order: int = ORDER, mu: float = MU, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of documents."""
    spark = documents.sparkSession
    texts, n_blocks = blocks(documents, block_bytes)
    shards = max(12, n_blocks // 2)
    sent = texts.mapInArrow(_send(order, shards), "shard int, n int, block long, grams binary, counts binary")
    # as many partitions as groups, so that no task gathers many
    answered = sent.repartition(order * shards, "n", "shard").groupBy("n", "shard").applyInPandas(_answer, "block long, n int, shard int, totals binary, v long, c long")
    folder = new_path(spark, "answers")
    answered.repartition(max(12, n_blocks), "block").write.partitionBy("block").option("compression", "zstd").parquet(folder)
    if n_blocks:
        got = spark.read.schema(answered.schema).parquet(folder).where("n = 1").agg(F.sum("v"), F.sum("c")).first()
        end = texts.where(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(HELD)) != 0).count()
        v, n_train = got[0], got[1]
    else:
        v, n_train, end = 0, 0, 0
    return texts.mapInArrow(_score(order, mu, folder, n_train, v, end), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
