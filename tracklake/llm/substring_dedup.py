"""Substring dedup: paragraphs by MinHash banding, exact Jaccard, and components of removals; exact seeds for passages inside them.

Two kinds of stretches of LEAST words or more are compared, words with A-Z lower-cased.

* Paragraphs: the lines of a text. Lines of the same words are one class. Classes are banded (BANDS bands of ROWS
  minima over the line's 5-word shingles; at a Jaccard similarity of 0.8 a share of (1 - 0.8^ROWS)^BANDS = 0.08 % of the pairs
  shares no band), colliding ones are compared on their full shingle sets and linked at
  100 * intersection >= 80 * union, as in minhash.linked, and components are one passage.
* Seeds: repeated passages need not begin or end where lines do, so a seed is the LEAST words from an anchor on, and
  anchors are the 5-word shingles whose hash is least among WINNOW neighbours; a text without such a seed has one from
  its least shingle that leaves room. Of any LEAST + WINNOW - 1 = 39 words that two texts share, a seed of both lies
  inside; seeds of one passage overlap or touch. Equal seeds (96 bits) are one passage. Seeds of a document that
  lie in the same document at the same distance are one run, and a run grows at its ends as far as the WINNOW words beyond are equal
  there too (16 bits a word): where a passage goes on further, the next seed is in the run. Only ends that nothing else covers
  need to grow.

A passage that lies in two documents or more belongs to the smallest doc_id and is removed from all others. What overlaps or
touches in one document is joined to stretches.

Defined cases: rows without doc_id, null texts and texts of fewer than LEAST words have no stretches; repeated rows of an id are
one document; what repeats one word over and over is left to other rules, and so are repeated lines of fewer than LEAST
words. An empty table gives no rows. Other columns are ignored, or kept as they are by remove().
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.bpe import steps
from tracklake.llm.common import components, hashes_of, mix, own_name, picked, rolling, save, words_of
from tracklake.llm.minhash import linked

SHINGLE, LEAST, WINNOW = 5, 20, 20
ROWS, BANDS = 2, 7
PERCENT = 80
#: Places that are broadcast at most: 32 MB of them.
PLACES = 1_000_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
#: Factors of the hash functions whose minima are banded: odd, from a fixed sequence.
FACTORS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def sliding(x: np.ndarray, n: int, least: bool) -> np.ndarray:
    """The least (or largest) of each n neighbours."""
    take, have = (np.minimum if least else np.maximum), 1
    while have < n:
        step = min(have, n - have)
        x = take(x[:-step], x[step:])
        have += step
    return x


class Words:
    """The words of some texts as hashes: h; at: the text of each; place: its place there; line: its line, counted over all texts."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern(texts, "\n")
        self.n = len(texts)
        line_text = np.repeat(np.arange(self.n), np.asarray(pc.list_value_length(lists)))
        self.line, words = words_of(lists.flatten())
        self.h = hashes_of(words)[0]
        self.at = line_text[self.line]
        self.size = np.bincount(self.at, minlength=self.n)
        self.begin = np.cumsum(self.size) - self.size
        self.place = np.arange(len(self.h)) - self.begin[self.at]


def seeds(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words (over all texts) and the two hashes of all seeds."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    s, at = rolling(w.h, w.at, SHINGLE)
    if not len(s):
        return none
    size = np.bincount(at, minlength=w.n)
    begin = np.cumsum(size) - size
    anchor = np.zeros(len(s), bool)
    if len(s) >= WINNOW:
        low = sliding(s, WINNOW, True)
        low[at[: len(low)] != at[WINNOW - 1 :]] = 0  # a window over two texts picks nothing
        padded = np.concatenate([np.zeros(WINNOW - 1, np.uint64), low, np.zeros(WINNOW - 1, np.uint64)])
        anchor = sliding(padded, WINNOW, False)[: len(s)] == s
    place = np.arange(len(s)) - begin[at]
    span = LEAST - SHINGLE + 1
    fits = place + span <= size[at]
    bare = np.bincount(at[anchor & fits], minlength=w.n) == 0
    for d in np.flatnonzero((size >= span) & bare):
        anchor[begin[d] + int(np.argmin(s[begin[d] : begin[d] + size[d] - span + 1]))] = True
    first = np.flatnonzero(anchor & fits)
    first = w.begin[at[first]] + place[first]
    words = w.h[first[:, None] + np.arange(LEAST)]
    first, words = first[many := (words != words[:, :1]).any(axis=1)], words[many]
    one, two = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(LEAST):
            one, two = one * BASES[0] + words[:, k], mix(two * BASES[1] + words[:, k])
    return first, mix(one), (two >> np.uint64(32)).astype(np.uint32)


def line_starts(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First words (over all texts) and word counts of the lines of LEAST words or more that are not one word over and over."""
    if not len(w.h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], w.line[1:] != w.line[:-1]]))
    size = np.diff(np.append(first, len(w.h)))
    varied = np.minimum.reduceat(w.h, first) != np.maximum.reduceat(w.h, first)
    return first[good := (size >= LEAST) & varied], size[good]


def shingles_of(w: Words, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of lines, one line after the other, and where each line's begin."""
    count = size - SHINGLE + 1
    starts = np.cumsum(count) - count
    at = np.repeat(first - starts, count) + np.arange(int(count.sum()))
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            out = out * BASES[0] + w.h[at + k]
    return mix(out), starts


def bands_of(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Band hashes of each line."""
    out = np.empty((len(starts), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            x = np.full(len(starts), b + 1, np.uint64)
            for k in range(ROWS):
                f = FACTORS[b * ROWS + k]
                x = mix(x * BASES[0] + np.minimum.reduceat((s ^ (f >> np.uint64(3))) * f, starts))
            out[:, b] = x
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds (no bands) and lines of the texts; fresh: the first of its kind in its text."""
    for batch in batches:
        for lo, texts in steps(batch):
            w = Words(texts)
            s_first, s1, s2 = seeds(w)
            first, size = line_starts(w)
            bands, l1, l2 = np.zeros((0, BANDS), np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
            if len(first):
                bands = bands_of(*shingles_of(w, first, size))
                starts = np.cumsum(size) - size
                at = np.repeat(first - starts, size) + np.arange(int(size.sum()))
                with np.errstate(over="ignore"):
                    step = (at - np.repeat(first, size) + 1).astype(np.uint64)
                    l1 = mix(np.add.reduceat(mix(w.h[at] ^ (step * BASES[0])), starts))
                    l2 = (np.add.reduceat(mix(w.h[at] + step * BASES[1]), starts) >> np.uint64(32)).astype(np.uint32)
            f, g = np.concatenate([s1, l1]), np.concatenate([s2, l2]).view(np.int32)
            word = np.concatenate([s_first, first])
            order = np.lexsort((w.place[word], g, f, w.at[word]))
            fresh = np.ones(len(word), bool)
            same = (np.diff(f[order]) == 0) & (np.diff(g[order]) == 0) & (np.diff(w.at[word][order]) == 0)
            fresh[order[1:][same]] = False
            doc = batch.column("doc_id").slice(lo, len(texts)).cast(pa.int64()).take(pa.array(w.at[word]))
            seed = pa.array(np.arange(len(word)) < len(s_first))
            none = pa.nulls(len(s_first), pa.int64())
            columns = [pa.concat_arrays([none, pa.array(bands[:, b].view(np.int64))]) for b in range(BANDS)]
            sizes = np.concatenate([np.full(len(s_first), LEAST), size]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([doc, pa.array(w.place[word].astype(np.int32)), pa.array(sizes), pa.array(f.view(np.int64)), pa.array(g), pa.array(fresh), seed, *columns], names=["doc_id", "place", "size", "f", "g", "fresh", "seed", *(f"b{b}" for b in range(BANDS))])


CUT = "doc_id long, place int, size int, f long, g int, fresh boolean, seed boolean, " + ", ".join(f"b{b} long" for b in range(BANDS))


def asked(docs: DataFrame, places: DataFrame, work: Callable, schema: str) -> DataFrame:
    """What work makes of the texts of which places (doc_id, at) asks for something, with all its places in one list.

    Up to PLACES places go to the tasks that read the texts; with more, the texts asked for are moved to them once.
    """
    places = save(places.groupBy("doc_id").agg(F.collect_set("at").alias("at")), "places")
    if places.agg(F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0] <= PLACES:
        texts = docs.join(F.broadcast(places), "doc_id")
    else:
        texts = picked(docs, places.select("doc_id")).join(places, "doc_id")
    texts = texts.select("doc_id", "text", "at")
    return texts.mapInArrow(work, schema)


def _each(batch: pa.RecordBatch, lo: int, texts: pa.Array) -> Iterator[tuple[int, int, list]]:
    return zip(range(len(texts)), batch.column("doc_id").slice(lo, len(texts)).to_pylist(), batch.column("at").slice(lo, len(texts)).to_pylist(), strict=True)


def _line_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of the lines that begin at the places asked for."""
    for batch in batches:
        for lo, texts in steps(batch):
            w = Words(texts)
            first, size = line_starts(w)
            wanted, ids = [], []
            for k, _, places in _each(batch, lo, texts):
                for x in places:
                    wanted.append(w.begin[k] + x["place"])
                    ids.append(x["id"])
            at = np.searchsorted(first, np.array(wanted, np.int64))
            sets: list[np.ndarray] = []
            if len(at):
                s, starts = shingles_of(w, first[at], size[at])
                sets = [np.unique(x) for x in np.split(s, starts[1:])]
            bounds = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))], names=["id", "s"])


def _beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """16-bit hashes of the WINNOW words before a place, the nearest first, or from it on."""
    for batch in batches:
        for lo, texts in steps(batch):
            w = Words(texts)
            h = (w.h >> np.uint64(48)).astype(np.uint16).view(np.int16)
            docs, places, afters, found = [], [], [], []
            for k, doc, asked_for in _each(batch, lo, texts):
                own = h[w.begin[k] : w.begin[k] + w.size[k]]
                for x in asked_for:
                    p = x["place"]
                    docs.append(doc)
                    places.append(p)
                    afters.append(x["after"])
                    found.append(own[p : p + WINNOW] if x["after"] else own[max(0, p - WINNOW) : p][::-1])
            bounds = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(places, pa.int32()), pa.array(afters, pa.bool_()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, np.int16), *found])))], names=["doc_id", "place", "after", "words"])


def paragraphs_linked(docs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """f, g, first_doc, first_word of the classes of lines whose passage lies in two documents or more."""
    bands = [F.min(f"b{b}").alias(f"b{b}") for b in range(BANDS)]  # equal in a class
    classes = lines.groupBy("f", "g").agg(F.min("doc_id").alias("doc"), F.max("doc_id").alias("last"), F.min_by("place", "doc_id").alias("place"), F.min("size").alias("size"), *bands)
    classes = save(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = classes.select(F.col("id").alias("i"), "doc", "place").join(ids, F.col("i") == F.col("id"), "left_semi")
        places = wanted.select(F.col("doc").alias("doc_id"), F.struct("place", F.col("i").alias("id")).alias("at"))
        return asked(docs, places, _line_sets, "id long, s array<long>").dropDuplicates(["id"])

    tagged = [F.shiftleft(f"b{b}", 3).bitwiseOR(F.lit(b)) for b in range(BANDS)]
    reps = classes.select("id", (F.col("size") - SHINGLE + 1).cast("long").alias("n"), F.array(*tagged).alias("bands"))
    comp = linked(reps, sets_of, percent)
    passage = save(classes.join(comp, "id", "left").select("f", "g", "doc", "place", "last", F.coalesce("comp", "id").alias("passage")), "passages")
    many = passage.groupBy("passage").agg(F.min("doc").alias("first_doc"), F.max("last").alias("end_doc"), F.min_by("place", "doc").alias("first_word")).where("first_doc <> end_doc")
    return passage.join(many.select("passage", "first_doc", "first_word"), "passage").select("f", "g", "first_doc", "first_word")


def repeated(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, place, size, seed, first_doc, first_word of each seed and line that two documents or more hold."""
    docs = documents.where("doc_id IS NOT NULL").select("doc_id", "text")
    cut = save(docs.mapInArrow(_cut, CUT), "cut")
    own = cut.where("seed AND fresh").groupBy("f", "g").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last"), F.min_by("place", "doc_id").alias("first_word"))
    flagged = own.where("first_doc <> last").select("f", "g", "first_doc", "first_word")
    flagged = save(flagged.union(paragraphs_linked(docs, cut.where("NOT seed AND fresh"), percent)), "flagged")
    return cut.select("doc_id", "place", "size", "seed", "f", "g").join(flagged, ["f", "g"]).select("doc_id", "place", "size", "seed", "first_doc", "first_word")


def grown(docs: DataFrame, hits: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, first, end, first_doc, first_word, n_paragraphs of what runs of seeds cover, and of where they grow, in both documents.

    A run grows where it ends within WINNOW words of the end of all that runs and removed lines cover there; elsewhere
    others cover what it could reach.
    """
    apart = hits.where("seed AND doc_id <> first_doc").withColumn("gap", F.col("place") - F.col("first_word"))
    w = Window.partitionBy("doc_id", "first_doc", "gap").orderBy("place")  # seeds of one document
    fresh = F.coalesce(F.col("place") > F.lag("place").over(w) + LEAST, F.lit(True)).cast("int")
    runs = apart.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w)).groupBy("doc_id", "first_doc", "gap", "run")
    runs = save(runs.agg(F.min("place").alias("first"), (F.max("place") + LEAST).alias("end"), F.countDistinct("place").alias("n")), "runs")
    none = F.lit(None).cast("long")
    covers = runs.select("doc_id", "first", "end", "first_doc", "gap").union(lines.where("doc_id <> first_doc").select("doc_id", "first", "end", none, none.cast("int")))
    island = Window.partitionBy("doc_id", "island")
    whole = _numbered(covers, "doc_id").withColumn("island_first", F.min("first").over(island)).withColumn("island_end", F.max("end").over(island)).where("first_doc IS NOT NULL")
    left = F.when(F.col("first") < F.col("island_first") + WINNOW, F.struct(F.lit(False).alias("after"), F.col("first").alias("place")))
    right = F.when(F.col("end") > F.col("island_end") - WINNOW, F.struct(F.lit(True).alias("after"), F.col("end").alias("place")))
    ends = whole.select("doc_id", "first_doc", "gap", F.explode(F.array_compact(F.array(left, right))).alias("side")).select("doc_id", "first_doc", "gap", "side.after", "side.place")
    ends = save(ends, "ends")
    place = F.struct("place", "after").alias("at")
    there = ends.select(F.col("first_doc").alias("doc_id"), F.struct((F.col("place") - F.col("gap")).alias("place"), "after").alias("at"))
    words = save(asked(docs, ends.select("doc_id", place).union(there).distinct(), _beyond, "doc_id long, place int, after boolean, words array<smallint>").dropDuplicates(["doc_id", "place", "after"]), "beyond")
    partner = words.select(F.col("doc_id").alias("first_doc"), F.col("place").alias("first_word"), "after", F.col("words").alias("there"))
    both = ends.join(words, ["doc_id", "place", "after"]).withColumn("first_word", F.col("place") - F.col("gap")).join(partner, ["first_doc", "first_word", "after"])
    odd = F.array_position(F.zip_with("words", "there", lambda a, b: a == b), False)
    more = F.when(odd > 0, odd - 1).otherwise(F.least(F.size("words"), F.size("there"))).cast("int")
    both = both.withColumn("more", more).where("more > 0").select("doc_id", "first_doc", "place", "first_word", "more", F.when(F.col("after"), 0).otherwise(F.col("more")).alias("back"))
    both = save(both, "growth")
    none = F.lit(0).alias("n_paragraphs")
    here = both.select("doc_id", (F.col("place") - F.col("back")).alias("first"), (F.col("place") - F.col("back") + F.col("more")).alias("end"), "first_doc", (F.col("first_word") - F.col("back")).alias("first_word"), none)
    out = runs.select("doc_id", "first", "end", "first_doc", (F.col("first") - F.col("gap")).alias("first_word"), F.col("n").cast("int").alias("n_paragraphs")).union(here)
    held = out.groupBy("first_doc", "first_word", (F.col("end") - F.col("first")).alias("size")).agg(F.max("n_paragraphs").alias("n_paragraphs"))
    return out.union(held.select("first_doc", "first_word", F.col("first_word") + F.col("size"), "first_doc", "first_word", "n_paragraphs"))


def stretches(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, start, end (words, end exclusive), n_paragraphs, first_doc, first_word, removed of each repeated stretch of a document.

    removed: the stretch's passages lie in an earlier document too; first_doc and first_word say where the first of them begins
    there. What overlaps or touches, with one verdict, is one stretch; kept ones inside a removed stretch, whose first
    document has no seed there, go with it.
    """
    docs = documents.where("doc_id IS NOT NULL").select("doc_id", "text")
    hits = save(repeated(docs, percent), "repeated")
    lines = hits.where("NOT seed").select("doc_id", F.col("place").alias("first"), (F.col("place") + F.col("size")).alias("end"), "first_doc", "first_word", F.lit(1).alias("n_paragraphs"))
    ruled = save(grown(docs, hits, lines).union(lines).withColumn("removed", F.col("doc_id") != F.col("first_doc")), "ruled")
    gone = save(_islands(ruled.where("removed")), "gone")
    within = gone.select(F.col("doc_id").alias("_id"), F.col("first").alias("_first"), F.col("end").alias("_end"))
    inside = (F.col("doc_id") == F.col("_id")) & (F.col("first") >= F.col("_first")) & (F.col("end") <= F.col("_end"))
    stay = _islands(ruled.where("NOT removed").join(within, inside, "left_anti"))
    return gone.union(stay).select("doc_id", F.col("first").alias("start"), "end", "n_paragraphs", "first_doc", "first_word", "removed")


def _numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with the number, among those of the keys, of what overlaps or touches."""
    w = Window.partitionBy(*keys).orderBy("first", "end")  # the paragraphs of one document
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("first") > before, F.lit(True)).cast("int")
    return rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w))


def _islands(rows: DataFrame) -> DataFrame:
    """doc_id, removed, first, end, first_doc, first_word, n_paragraphs of what overlaps or touches in a document."""
    island = _numbered(rows, "doc_id")
    least = F.min(F.struct("first_doc", "first_word")).alias("least")
    found = island.groupBy("doc_id", "removed", "island").agg(F.min("first").alias("first"), F.max("end").alias("end"), least, F.sum("n_paragraphs").alias("n_paragraphs"))
    return found.select("doc_id", "removed", "first", "end", "least.first_doc", "least.first_word", "n_paragraphs")


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without the words of the cuts (first, end) and the white space after them."""
    if not cuts:
        return text
    at = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, done = [], 0
    for a, b in sorted(cuts):
        out.append(text[done : max(done, at[min(a, len(at) - 1)])])
        done = max(done, at[min(b, len(at) - 1)])
    return "".join(out) + text[done:]


def remove(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """documents with all removed stretches cut out of their texts; other columns, of any name, stay as they are."""
    own, name = own_name(), own_name()
    gone = stretches(documents, percent).where("removed").groupBy(F.col("doc_id").alias(own)).agg(F.collect_list(F.struct("start", "end")).alias(name))
    joined = documents.join(gone, documents["doc_id"] == gone[own], "left").drop(own)
    schema = documents.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [[(c["start"], c["end"]) for c in x or ()] for x in batch.column(name).to_pylist()]
            arrays = [batch.column(c) for c in schema.names]
            k = schema.names.index("text")
            arrays[k] = pa.array([t if t is None else without(t, c) for t, c in zip(arrays[k].to_pylist(), cuts, strict=True)], arrays[k].type)
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return joined.mapInArrow(work, schema)
