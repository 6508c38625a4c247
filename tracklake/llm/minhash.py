"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, components.

A text, A-Z lower-cased, is the set of its distinct 5-word shingles; with fewer words the whole word
sequence is its one shingle; without words the set is empty and linked with nothing. Shingles are
64-bit hashes. In SuperMinHash every shingle ranks the M slots by a permutation of its own and gives
the slot of rank j the value j + u, u uniform in [0, 1); a slot keeps the least value. Ranks
are handed out round by round over all shingles of a batch at once, and a document leaves the rounds when
no slot can fall any more, so long texts stop after one or two rounds. M is prime, and a permutation
is slot = start + rank * step mod M, which makes any two slots jointly as uniform as a full
shuffle does.

BANDS bands of ROWS slots miss a pair at a Jaccard similarity of 0.85 with probability
(1 - 0.85^ROWS)^BANDS, 4e-8. Documents with one shingle set form one class before banding, so
copies cost nothing further. Links are found in three steps, and each link is confirmed on the
full shingle sets:
1. every bucket's members are compared with its smallest id;
2. large buckets that still hold several components compare their members with another member
   drawn at random, in as many rounds as asked for, while that finds links;
3. in buckets that still hold several components, every pair of members of different
   components is compared, in blocks of BLOCK members by BLOCK members outside the
   bucket's largest component, with the sets in the task; a task returns links only where
   they connect what it has not connected yet. A block has fewer members where sets are large.
Step 3 leaves no colliding pair undecided, so no bucket is capped; steps 1 and 2 exist so that it
meets few members where a group of near copies is very large. Of buckets with the same members one is taken.

What is linked are sets, not ids: a class has a number of its own, so rows that share an id but not a text are linked
by nothing but their texts. A component's id is the least doc_id of its rows.

Defined cases: null and empty texts have no shingles, component_id is their own id and they are kept;
rows without doc_id take no part in links and come back with a null component_id, kept; repeated
rows of one id with one text share a class; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklake.llm.bpe import steps
from tracklake.llm.common import BROADCAST_IDS, components, drop, edges_of, hashes_of, mix, own_name, picked, rolling, row_slices, save, tidy, words_of

SHINGLE = 5
M, ROWS, BANDS = 149, 5, 29
#: Members, and shingles of all members, that one side of a block holds about.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
ROUNDS = 2
#: A link: PERCENT * intersection size >= ... as in 100 * intersection >= PERCENT * union.
PERCENT = 85


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after the other, and the bounds of the texts."""
    at, words = words_of(texts)
    h, _, _ = hashes_of(words)
    count = np.bincount(at, minlength=len(texts))
    s, s_at = rolling(h, at, n)
    short = (count > 0) & (count < n)
    if short.any():
        bounds, extra = row_slices(at, len(texts)), []
        for d in np.flatnonzero(short):
            x = np.uint64(count[d])
            for w in h[bounds[d] : bounds[d + 1]]:
                x = mix(np.array([x ^ w], np.uint64))[0]
            extra.append(x)
        s, s_at = np.concatenate([s, np.array(extra, np.uint64)]), np.concatenate([s_at, np.flatnonzero(short)])
    order = np.lexsort((s, s_at))
    s, s_at = s[order], s_at[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (s_at[1:] != s_at[:-1])
    s, s_at = s[fresh], s_at[fresh]
    return s, row_slices(s_at, len(texts))


def signatures(s: np.ndarray, bounds: np.ndarray, m: int = M) -> np.ndarray:
    """SuperMinHash of each set, as rank << 48 | 48 random bits; empty sets keep the largest value."""
    n = len(bounds) - 1
    sig = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    seed = mix(s + np.uint64(0x5851F42D4C957F2D))
    start = (seed % np.uint64(m)).astype(np.int64)
    step = ((seed >> np.uint64(20)) % np.uint64(m - 1)).astype(np.int64) + 1
    live = np.arange(len(s))
    for j in range(m):
        if not len(live):
            break
        d = doc[live]
        with np.errstate(over="ignore"):
            u = mix(s[live] ^ (np.uint64(0xD1342543DE82EF95) * np.uint64(j + 1))) >> np.uint64(16)
        np.minimum.at(sig, d * m + (start[live] + j * step[live]) % m, (np.uint64(j) << np.uint64(48)) | u)
        here = np.unique(d)
        done = np.zeros(n, bool)
        done[here] = sig.reshape(n, m)[here].max(axis=1) < np.uint64((j + 1) << 48)
        live = live[~done[d]]
    return sig.reshape(n, m)


def bands_of(sig: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    out = np.empty((len(sig), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            x = np.full(len(sig), b + 1, np.uint64)
            for k in range(rows):
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + k])
            out[:, b] = x
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, texts in steps(batch):
            part = batch.slice(lo, len(texts))
            s, bounds = shingle_sets(texts)
            bands = bands_of(signatures(s, bounds))
            size = np.diff(bounds)
            one, two = fingerprint(s, bounds)
            flat = pa.array(bands.reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * bands.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(size.astype(np.int64)), pa.array(one), pa.array(two), lists], names=["doc_id", "n_shingles", "f1", "f2", "bands"])


def fingerprint(s: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set."""
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(s ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)])
        other = np.concatenate([[np.uint64(0)], np.cumsum(mix(s ^ np.uint64(0xE7037ED1A0B428DB)), dtype=np.uint64)])
        return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64), (other[bounds[1:]] - other[bounds[:-1]]).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, s of the texts that have the set asked for: rows of text, id, n, f1, f2."""
    for batch in batches:
        for lo, texts in steps(batch):
            part = batch.slice(lo, len(texts))
            s, bounds = shingle_sets(texts)
            one, two = fingerprint(s, bounds)
            n, f1, f2 = (np.asarray(part.column(c)) for c in ("n", "f1", "f2"))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(s.view(np.int64)))
            meant = pa.array((np.diff(bounds) == n) & (one == f1) & (two == f2))
            yield pa.RecordBatch.from_arrays([part.column("id").filter(meant), lists.filter(meant)], names=["id", "s"])


def _marked(names: tuple[str, str, str]):
    """The rows with three more columns: n, f1, f2 of their texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in steps(batch):
                part = batch.slice(lo, len(texts))
                s, bounds = shingle_sets(texts)
                more = (np.diff(bounds).astype(np.int64), *fingerprint(s, bounds))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x) for x in more)], names=[*part.schema.names, *names])

    return work


def _connect(percent: int):
    """Links between different components of one block of a bucket, without those that connect nothing new."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["minor", "id"], kind="stable").reset_index(drop=True)
        parent = {c: c for c in pdf.comp}

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        n, comp, minor = pdf.n.to_numpy(), pdf.comp.to_numpy(), pdf.minor.to_numpy()
        flat = np.concatenate([np.asarray(x, np.int64) for x in pdf.s])
        owner = np.repeat(np.arange(len(pdf)), [len(x) for x in pdf.s])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        out = []
        for i in np.flatnonzero(minor):
            x = np.asarray(pdf.s.iat[i], np.int64)
            lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
            width = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
            both = np.bincount(owner[at], minlength=len(pdf))
            for j in np.flatnonzero(100 * both >= percent * (n + n[i] - both)):
                if (a := root(comp[i])) != (b := root(comp[j])):
                    parent[max(a, b)] = min(a, b)
                    out.append((comp[i], comp[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return work


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, and more columns) whose full sets meet the threshold."""
    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select(*pairs.columns, F.size(F.array_intersect("sa", "sb")).alias("k"), (F.size("sa") + F.size("sb")).alias("t"))
    return both.where(100 * F.col("k") >= percent * (F.col("t") - F.col("k"))).select(*pairs.columns)


def linked(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int = PERCENT, rounds: int = ROUNDS, block: int = BLOCK, owner: Column | None = None) -> DataFrame:
    """Components by confirmed links: id, comp (the least id reachable) of the classes that share a bucket; written. The others are linked with nothing.

    classes: id, n (set size), bands, and first where what comes first in a bucket is not the least id: the member that the others
    are compared with should be an original, and copies mostly have larger ids. sets_of gives the full sets (id, s) of the ids (id) it is asked for.
    owner: what must differ within a bucket for it to count, if not the id.
    """
    first = F.col("first" if "first" in classes.columns else "id")
    plain = classes.select("id", "n", first.alias("first"), F.explode("bands").alias("bucket"))
    counts = [F.count("*").alias("m"), F.min_by("id", "first").alias("least"), F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x2")]
    if owner is None:
        full = plain.groupBy("bucket").agg(*counts).where("m > 1")
    else:
        full = plain.groupBy("bucket").agg(*counts, F.min(owner).alias("o1"), F.max(owner).alias("o2")).where("o1 <> o2")
    # of buckets with the same members one is enough
    full = save(full.groupBy("m", "least", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket", "m", "least"), "buckets")
    member = save(plain.join(full, "bucket").select("bucket", "id", "n", "m", "least"), "members")
    sizes = save(member.groupBy("id").agg(F.first("n").alias("n")), "sizes")
    drop(full)
    sets = save(sets_of(sizes.select("id")), "sets")
    near = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    pairs = member.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"), F.col("n").alias("n_b")).distinct()
    pairs = pairs.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("n_a")), "a").where(near(F.col("n_a"), F.col("n_b"))).select("a", "b")
    comp = _merged(sizes.select("id", F.col("id").alias("comp")), edges_of(confirm(pairs, sets, percent)))
    # Labels are joined once a round, and only to members of buckets that may still hold several components.
    small, large = (member.where(F.col("m") > 2).where((F.col("m") > block // 8) == is_large) for is_large in (False, True))
    for k in range(rounds):
        now, old = save(large.join(comp, "id"), "now"), large
        several = now.groupBy("bucket").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), F.col("id").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"))).alias("x")).where("c1 <> c2")
        several = save(several.select("bucket", "x.a", "x.ca", "x.na"), "open")
        large = save(now.drop("comp").join(several.select("bucket"), "bucket", "left_semi"), "members")
        if k:
            drop(old)
        if several.isEmpty():
            break
        pairs = now.join(several, "bucket").where((F.col("comp") != F.col("ca")) & near(F.col("n"), F.col("na")))
        one, two = F.struct(F.col("a").alias("id"), F.col("ca").alias("comp")), F.struct("id", "comp")
        pairs = pairs.select(F.least(one, two).alias("p"), F.greatest(one, two).alias("q")).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.col("p.comp").alias("ca"), F.col("q.comp").alias("cb")).distinct()
        fresh = edges_of(confirm(pairs, sets, percent).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        for old in (now, several):
            drop(old)
        if fresh.isEmpty():
            drop(fresh)
            break
        comp = _merged(comp, fresh)
    now = save(small.unionByName(large).join(comp, "id"), "now")
    several = save(now.groupBy("bucket").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("bucket"), "open")
    if not several.isEmpty():
        rest = save(now.join(several, "bucket", "left_semi"), "rest")
        comp = _merged(comp, edges_of(_rest(rest, sets, percent, block)))
        drop(rest)
    for old in (member, sizes, large, sets, several, now):
        drop(old)
    return comp


def _merged(comp: DataFrame, fresh: DataFrame) -> DataFrame:
    """Labels (id, comp) after links between their components, as edges_of() has written them; both are read for the last time."""
    got = components(fresh, written=True)
    return save(comp.join(got, comp.comp == got.node, "left").select("id", F.coalesce("component", "comp").alias("comp")), "labels")


def _rest(now: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Step 3 over members (bucket, id, n, m, comp) of the buckets with several components."""
    share = now.groupBy("bucket", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("e"))
    top = share.groupBy("bucket").agg(F.max(F.struct("k", "comp", "e")).alias("top"), F.sum("k").alias("m"), F.sum("e").alias("e"))
    parts = lambda k, e: F.ceil(F.greatest(k / block, e / BLOCK_SHINGLES)).cast("int")
    top = save(top.select("bucket", F.col("top.comp").alias("main"), parts(F.col("m"), F.col("e")).alias("blocks"), parts(F.col("m") - F.col("top.k"), F.col("e") - F.col("top.e")).alias("minors")), "top")
    both = dealt(now.select("bucket", "id", "n", "comp").join(top, "bucket")).join(sets, "id")
    return both.groupBy("bucket", "i", "j").applyInPandas(_connect(percent), "a long, b long")


def dealt(members: DataFrame) -> DataFrame:
    """Members (bucket, id, n, comp, main, blocks, minors) in the blocks (i, j) of their buckets, each once in a block.

    All stand in row i of their own, in each column; those outside the largest component (minor there) also in each row of column j.
    """
    salt = lambda c, k: F.pmod(F.xxhash64("id", F.lit(k)), F.col(c)).cast("int")
    row, column = salt("blocks", "all"), F.when(F.col("comp") != F.col("main"), salt("minors", "few"))
    spread = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    place = lambda i, j, minor: F.struct(i.alias("i"), j.alias("j"), minor.alias("minor"))
    across = F.transform(spread("minors"), lambda j: place(F.col("row"), j, F.coalesce(j == F.col("column"), F.lit(False))))
    down = F.transform(F.filter(spread("blocks"), lambda i: i != F.col("row")), lambda i: place(i, F.col("column"), F.lit(True)))
    places = F.when(F.col("column").isNull(), across).otherwise(F.concat(across, down))
    return members.withColumn("row", row).withColumn("column", column).select("bucket", "id", "n", "comp", F.explode(places).alias("p")).select("bucket", "p.i", "p.j", "id", "n", "comp", "p.minor")


def labelled(documents: DataFrame, percent: int = PERCENT, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, f1, f2, class, component (numbers, null for rows that take no part) and component_id of each row; written."""
    signed = save(documents.select("doc_id", "text").mapInArrow(tidy(_sign), "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"), "signed")
    able = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = able.groupBy("n_shingles", "f1", "f2").agg(F.min(F.struct("doc_id", "bands")).alias("r")).select(F.col("r.doc_id").alias("doc_id"), F.col("n_shingles").alias("n"), "f1", "f2", F.col("r.bands").alias("bands"))
    classes = save(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # numbers hold once they are written

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = save(classes.select("id", "doc_id", "n", "f1", "f2").join(ids, "id", "left_semi").select(F.col("doc_id").alias("_doc"), "id", "n", "f1", "f2"), "wanted")
        near = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
        texts = documents.select("doc_id", "text").join(near, F.col("doc_id") == F.col("_doc")).select("text", "id", "n", "f1", "f2")
        return texts.mapInArrow(tidy(_sets), "id long, s array<long>").dropDuplicates(["id"])

    comp = linked(classes.select("id", "n", "bands", F.col("doc_id").alias("first")), sets_of, percent, rounds, block)
    label = save(classes.join(comp, "id", "left").select("id", "doc_id", "n", "f1", "f2", F.coalesce("comp", "id").alias("component")), "label")
    least = label.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = label.join(least, "component").select("f1", "f2", F.col("n").alias("n_shingles"), F.col("id").alias("class"), "component", "component_id")
    out = signed.select("doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2", "n_shingles"], "left")
    takes_part = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    only = lambda c: F.when(takes_part, F.col(c))
    out = save(out.select("doc_id", "n_shingles", "f1", "f2", only("class").alias("class"), only("component").alias("component"), F.when(takes_part, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), "labelled")
    for old in (signed, classes, comp, label):
        drop(old)
    return out


def near_duplicates(documents: DataFrame, percent: int = PERCENT, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of documents."""
    rows = labelled(documents, percent, rounds, block)
    return rows.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep(documents: DataFrame, percent: int = PERCENT, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """The rows of documents that stay: of each component the row of the least doc_id, one if it has several.

    Rows without doc_id or without words stay all. Only ids move; where rows share an id, they are told apart by
    their sets. Other columns may have any name.
    """
    rows = labelled(documents, percent, rounds, block)
    winner = save(rows.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "class")).alias("w")).select("w.doc_id", "w.class"), "winners")
    every = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"), F.count("component").alias("able"))
    won = winner.groupBy("doc_id").agg(F.count("*").alias("won"))
    judged = every.join(won, "doc_id", "left").where("able > 0 AND (won IS NULL OR rows > 1)")
    gone = save(judged.select("doc_id", (F.col("rows") > 1).alias("several")), "gone")
    several = save(gone.where("several").select("doc_id"), "several")
    single = picked(documents, gone.select("doc_id"), "left_anti")
    if several.isEmpty():
        return single
    n, f1, f2, own = (own_name() for _ in range(4))
    schema = T.StructType([*documents.schema, *(T.StructField(c, T.LongType()) for c in (n, f1, f2))])
    apart = picked(documents, several).mapInArrow(tidy(_marked((n, f1, f2))), schema)
    stays = rows.join(several, "doc_id", "left_semi").join(winner, ["doc_id", "class"], "left_semi")
    stays = stays.select(F.col("doc_id").alias(own), F.col("n_shingles").alias(f"{own}n"), F.col("f1").alias(f"{own}1"), F.col("f2").alias(f"{own}2")).distinct()
    met = (apart["doc_id"] == F.col(own)) & (F.col(n) == F.col(f"{own}n")) & (F.col(f1) == F.col(f"{own}1")) & (F.col(f2) == F.col(f"{own}2"))
    best = apart.where(F.col(n) > 0).join(stays, met, "left_semi").dropDuplicates(["doc_id", n, f1, f2])
    return single.unionByName(best.drop(n, f1, f2)).unionByName(apart.where(F.col(n) == 0).drop(n, f1, f2))
