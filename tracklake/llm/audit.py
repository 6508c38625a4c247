"""Filter interaction audit: what each of five filters removes in every order, by part of the corpus.

One pass over the texts judges filters A to D and gives each document its length in code points and a hash of each of its blocks,
which grow by GROWTH, so that a text has few. Duplicates (E) are found by partition refinement: documents are
split by length, then by one block's hash after the other, and whatever is alone in its class drops out before the next.
Classes that survive all blocks are compared by their full texts, each with the text of its smallest doc_id; if
two texts share a class, all hashes are drawn anew from another seed. Of a class, ids above the smallest are marked.

Documents are then counted by part, mask of failed filters and labels; marked ones are moved to their new mask. All 120
orders are read off those few counts: what a step removes depends on its filter and on the set before it, 80 pairs.

Hot classes: classes of more than 1 / HEAVY of the rows are fewer than HEAVY, so they are broadcast; the rows of all
others are joined by a shuffle, where no class is large. A full text is compared in salted lots of LOT copies, for each of which
the class's first text is repeated. Only texts of classes with several members move, besides a few that a bit map of their ids lets pass.

Defined cases: a null text is empty, a null lang is the part of the empty string; a document without doc_id is no one's smaller
copy and is not marked; repeated rows of an id count each and do not mark each other; repeated labels of an id count as 1 where any
does. No documents give no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import own_name, save

FILTERS = "ABCDE"
WORDS, DISTINCT, CAPITALS, SYMBOLS = 200, 50, 3, "#$%&*|"
#: Code points of the first block; the next ones are so many times as long.
BLOCK, GROWTH, BLOCKS = 64, 8, 8
HEAVY, LOT = 10_000, 1000
#: Bits of the map of ids whose texts are asked for: it has at most MAP / 64 rows, of 16 bytes, whatever the input.
MAP = 1 << 25
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def masks(text: Column) -> Column:
    """The bits of filters A to D that a text fails."""
    words, chars = F.split(text, r"[\x20\x09-\x0D]+"), F.char_length(text)
    # white space at an end leaves an empty string there
    ends = (F.element_at(words, 1) == "").cast("int") + ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")
    n, distinct = F.size(words) - ends, F.size(F.array_distinct(words)) - F.least(ends, F.lit(1))
    fails = (
        n < WORDS,
        100 * distinct < DISTINCT * n,
        100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) > CAPITALS * chars,
        text.rlike(f"[{SYMBOLS}]"),
    )
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0)).cast("int")


def block_hashes(text: Column, chars: Column, seed: int, bits: int) -> Column:
    """The hash of each block that a text of so many code points has."""
    bounds = [0, *(BLOCK * GROWTH**k for k in range(BLOCKS - 1))]
    piece = lambda k: F.substring(text, bounds[k] + 1, bounds[k + 1] - bounds[k]) if k + 1 < BLOCKS else F.substring(text, bounds[k] + 1, 2**31 - 1 - bounds[k])
    short = lambda c: F.xxhash64(c, F.lit(seed)) if bits == 64 else F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(1 << bits))
    return F.filter(F.array(*(F.when((chars > bounds[k]) if k else F.lit(True), short(piece(k))) for k in range(BLOCKS))), lambda h: h.isNotNull())


def refined(before: Column, blocks: Column, k: int) -> Column:
    """The class after block k: the one before and the block's hash; texts that have no such block stay where they are."""
    return F.when(F.size(blocks) > k, F.xxhash64(before, F.try_element_at(blocks, F.lit(k + 1)))).otherwise(before)


def judged(documents: DataFrame, seed: int = 0, bits: int = 64) -> DataFrame:
    """doc_id, part, mask, chars, blocks of each row of documents."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.char_length(text).alias("chars"))
    return rows.select("doc_id", "part", masks(F.col("text")).alias("mask"), "chars", block_hashes(F.col("text"), F.col("chars"), seed, bits).alias("blocks"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic, whether their label says so."""
    one = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = rows.where("doc_id IS NOT NULL").join(one, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    without = rows.where("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    return known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}).unionByName(without)


def met(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """rows joined with classes (class, n and more) on class; no task gets a hot class.

    Fewer than HEAVY classes can have more than 1 / HEAVY of all rows: those are broadcast.
    """
    heavy = classes.where(F.col("n") > total / HEAVY)
    few = rows.join(F.broadcast(heavy), "class")
    many = rows.join(F.broadcast(heavy.select("class")), "class", "left_anti").join(classes.where(F.col("n") <= total / HEAVY), "class")
    return few.unionByName(many)


def surviving(rows: DataFrame, total: int) -> DataFrame:
    """rows (with chars and blocks) in classes of several, with class, n and least; what is alone in a class drops out round by round."""
    alive = rows.withColumn("class", F.xxhash64("chars"))
    for k in range(BLOCKS + 1):
        if k:
            alive = alive.withColumn("class", refined(F.col("class"), F.col("blocks"), k - 1))
        classes = save(alive.groupBy("class").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max(F.size("blocks")).alias("deep")).where("n > 1"), "classes")
        alive = save(met(alive.drop("n", "least"), classes.drop("deep"), total), "alive")
        if classes.agg(F.max("deep")).first()[0] in (None, *range(k + 1)):
            break
    return alive


def hinted(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of documents whose id may be among those asked for: a bit map of hashed ids keeps most other texts from moving."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(MAP))
    words = asked.select(bit.alias("b")).select(F.shiftright("b", 6).cast("int").alias("_word"), F.expr("shiftleft(1L, CAST(b % 64 AS INT))").alias("_one")).groupBy("_word").agg(F.bit_or("_one").alias("_bits"))
    met = documents.withColumn("_b", bit).join(F.broadcast(words), F.shiftright("_b", 6).cast("int") == F.col("_word"))
    return met.where(F.expr("shiftright(_bits, CAST(_b % 64 AS INT)) & 1 = 1")).drop("_b", "_word", "_bits")


def sound(documents: DataFrame, alive: DataFrame, seed: int, bits: int) -> bool:
    """Whether the full texts of each class of the surviving rows are equal; texts meet their rows by id and length."""
    asked = alive.select("doc_id", "chars", "class", "n", "least").distinct()
    text = F.coalesce("text", F.lit(""))
    texts = hinted(documents.select("doc_id", text.alias("text")), asked).withColumn("chars", F.char_length("text")).join(asked.hint("merge"), ["doc_id", "chars"])
    # an id whose rows differ meets the classes of all of them
    own = F.aggregate(block_hashes(F.col("text"), F.col("chars"), seed, bits), F.xxhash64("chars"), lambda c, h: F.xxhash64(c, h))
    texts = save(texts.where(own == F.col("class")).withColumn("lots", F.ceil(F.col("n") / LOT).cast("int")), "copies")
    other = own_name()
    first = texts.where("doc_id = least").groupBy("class", "lots").agg(F.first("text").alias(other)).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
    each = texts.withColumn("lot", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.col("lots")).cast("int"))
    return each.join(first, ["class", "lot"]).where(F.col("text") != F.col(other)).isEmpty()


def duplicates(documents: DataFrame, rows: DataFrame, seed: int = 0, bits: int = 64) -> DataFrame | None:
    """The rows (judged, written) that repeat the text of a smaller doc_id; None where hashes have met and another seed is needed."""
    alive = surviving(rows.where("doc_id IS NOT NULL"), rows.count())
    return alive.where("doc_id > least") if sound(documents, alive, seed, bits) else None


def combinations() -> list[tuple[str, int, str, int, int]]:
    """filter_order, step, filter, its bit, and the bits of those before it."""
    out = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            out.append(("".join(order), step, f, bit, before))
            before |= bit
    return out


def report(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and COUNTS from counts (part, mask, good, toxic, n)."""
    orders = combinations()
    pairs = sorted({(bit, before) for _, _, _, bit, before in orders})
    each = counts.withColumn("p", F.explode(F.array(*(F.lit(bit * 32 + before) for bit, before in pairs))))
    bit, before = F.floor(F.col("p") / 32).cast("int"), (F.col("p") % 32).cast("int")
    fails, earlier = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(before) != 0
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    gone = fails & ~earlier
    sums = each.groupBy("part", "p").agg(
        n(~fails & ~earlier).alias("kept"), n(gone).alias("removed"), n(fails & earlier).alias("redundant"),
        n(F.col("mask") == bit).alias("unique_fails"), n(gone & F.col("good")).alias("good_lost"), n(gone & F.col("toxic")).alias("toxic_lost"),
    )
    table = counts.sparkSession.createDataFrame([(o, s, b * 32 + e, b) for o, s, _, b, e in orders], "filter_order string, step int, p int, bit int")
    rows = sums.join(F.broadcast(table), "p")
    shapley = rows.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return rows.join(shapley, ["part", "bit"]).select("part", "filter_order", "step", *COUNTS)


def audit(documents: DataFrame, labels: DataFrame, bits: tuple[int, ...] = (64, 64, 64)) -> DataFrame:
    """part, filter_order, step and COUNTS of all documents (doc_id, text, lang); bits: hash bits of the first seed and of the next ones."""
    for seed, b in enumerate(bits):
        rows = save(labelled(judged(documents, seed, b), labels), "judged")
        marked = duplicates(documents, rows, seed, b)
        if marked is not None:
            break
    else:
        raise RuntimeError("two texts share a class with every seed")
    plain = rows.select("part", "mask", "good", "toxic", F.lit(1).alias("n"))
    moved = marked.select("part", F.explode(F.array(F.struct("mask", F.lit(-1).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.lit(1).alias("n")))).alias("m"), "good", "toxic")
    both = plain.unionByName(moved.select("part", "m.mask", "good", "toxic", "m.n"))
    return report(save(both.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")), "counts"))


ORACLE = """
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
  l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
  m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
  c AS MATERIALIZED (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
  f(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
  o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
  s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
  r AS (SELECT part, filter_order, step, bit, CAST(sum(CASE WHEN mask & bit = 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN good AND mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN toxic AND mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
    FROM (SELECT part, filter_order, step, bit, CAST(earlier AS INTEGER) AS earlier, mask, good, toxic, n FROM c, s) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""
