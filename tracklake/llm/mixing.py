"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

A document's size is its number of words. Sources, in code point order with null last, take the shares in turn and
divide PERCENT % of all words by them. A source's target stops at MOST times its size, and the excess goes to the
others by weight until none is above: water filling, where every source that has not stopped gets level * weight.

Within a source whole epochs come first: each document is taken floor(target / size of the source) times. What is left
of the target is filled in the order of exponential keys, -ln(u) / weight with u uniform from the document's id: the order in which
weighted sampling without replacement draws, so a document of twice the weight is drawn twice as soon. Sizes are summed along
that order up to the budget; the document where the budget ends gives as many of its first words as are left, so a
source's words meet its target to the rounding.

No task holds a source: documents, without their texts, are dealt by ranges of (source, key) to parts of like size, sizes are
summed within a part, and a part takes over the sum of those before it, of which a source has no more than Spark has
shuffle partitions. What a document must know of its source comes with its part, so no join meets a hot source.

Defined cases: null and empty texts have size 0 and take nothing; a null source is a source of its own, the last; repeated
rows count each, and rows that are alike are drawn in any order; a null doc_id draws by its text. Weights that are
null count as 1 and may not be 0 or less. Without rows, or without words, nothing is taken. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.common import own_name, save
from tracklake.operators import ranks

WORD = r"[^\x20\x09-\x0D]+"
SHARES, PERCENT, MOST = (3, 1, 2), 150, 2
#: Weight of a document by its label: quality 1, quality 0, none.
GOOD, POOR, UNKNOWN = 2.0, 0.5, 1.0


def exponential(name: Column, weight: Column) -> Column:
    """-ln(u) / weight, u uniform in (0, 1) from 52 bits of the name's MD5."""
    bits = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / weight


def keyed(documents: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """doc_id, source, size, weight and key of each row of documents; weights: doc_id and weight, ids once."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    rows = documents.select("doc_id", "source", size.alias("size"), name.alias("name"))
    if weights is None:
        rows = rows.withColumn("weight", F.lit(UNKNOWN))
    else:
        given = weights.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("weight").alias("_w"))
        # rows without an id have no label; they stay where they are
        known = rows.where("doc_id IS NOT NULL").join(given, F.col("doc_id") == F.col("_id"), "left").drop("_id")
        rows = known.unionByName(rows.where("doc_id IS NULL").withColumn("_w", F.lit(None).cast("double")))
        rows = rows.withColumn("weight", F.coalesce("_w", F.lit(UNKNOWN)).cast("double")).drop("_w")
    return rows.withColumn("key", exponential(F.col("name"), F.col("weight"))).drop("name")


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight from labels (doc_id, quality); of repeated labels the better counts."""
    best = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return best.select("doc_id", F.when(F.col("q") == 1, GOOD).when(F.col("q") == 0, POOR).otherwise(UNKNOWN).alias("weight"))


def targets(sizes: DataFrame, shares: tuple[int, ...] = SHARES, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """source, source_size, share, target of sources (source, source_size), a written table.

    A round sets the level for the sources that have not stopped; it ends when the level stops no more of them.
    """
    if percent > 100 * most:
        raise ValueError("the sources cannot give so many words")
    nth = ranks.ranked(sizes.withColumn("all", F.lit(0)).withColumn("none", F.col("source").isNull()), ("all",), ("none", "source"), "nth")
    turn = F.element_at(F.array(*(F.lit(s).cast("double") for s in shares)), (F.col("nth") % len(shares) + 1).cast("int"))
    rows = save(nth.select("source", "source_size", turn.alias("share")), "sources")
    level, cap = None, F.col("source_size") * F.lit(most)
    while True:
        stopped = F.lit(False) if level is None else F.col("share") * F.lit(level) > cap
        found = rows.agg(F.sum("source_size").alias("n"), F.coalesce(F.sum(F.when(stopped, cap)), F.lit(0)).alias("full"), F.sum(F.when(~stopped, F.col("share"))).alias("shares")).first()
        if not found.n or found.shares is None:
            fresh = 0.0
        else:
            fresh = (found.n * percent / 100 - found.full) / found.shares
        if level is not None and fresh <= level:
            break
        level = fresh
    return rows.select("source", "source_size", "share", F.least(F.col("share") * F.lit(level), cap.cast("double")).alias("target"))


def mix(documents: DataFrame, weights: DataFrame | None = None, shares: tuple[int, ...] = SHARES, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, weight, epochs for each row of documents (doc_id, text, source).

    taken: words the mix takes of the document, over all epochs.
    """
    rows = save(keyed(documents, weights), "keyed")
    dealt = ranks.Dealt(rows, ("source",), ("key", "size"))
    parts = dealt.rows.groupBy("source", dealt.part).agg(F.sum("size").alias("words"))
    sizes = save(parts.groupBy("source").agg(F.sum("words").alias("source_size")), "sizes")
    aim = targets(sizes, shares, percent, most)
    own, before = own_name(), F.coalesce(F.sum("words").over(dealt.parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = parts.withColumn("before", before).join(aim.withColumnRenamed("source", own), F.col("source").eqNullSafe(F.col(own))).drop(own)
    placed = dealt.with_carried(dealt.rows, known, before=F.col("before"), source_size=F.col("source_size"), target=F.col("target"))
    earlier = F.col("before") + F.coalesce(F.sum("size").over(dealt.own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("earlier", earlier).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    budget = F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least("size", budget - F.col("earlier")))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"), "source", "weight", "epochs")


def mixed(documents: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix itself: the rows of documents with their columns, once for each time they are taken; the last may be cut to its first words.

    Rows that share an id are met by id alone, and each gives the mean of what they take, rounded down.
    """
    names = [own_name() for _ in range(4)]
    i, taken, size, nth = names
    rows = plan.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(i)).agg(F.floor(F.avg("taken")).alias(taken))
    met = documents.join(rows.where(F.col(taken) > 0), documents["doc_id"] == F.col(i)).withColumn(size, F.regexp_count("text", F.lit(WORD)))
    each = met.withColumn(nth, F.explode(F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)).cast("int"))))
    left = F.col(taken) - (F.col(nth) - 1) * F.col(size)
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), left.cast("int")), "")
    return each.where(F.col(size) > 0).withColumn("text", F.when(left >= F.col(size), F.col("text")).otherwise(cut)).select(*documents.columns)


ORACLE = f"""
WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, ''))) AS name FROM documents),
  q AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
  k AS (SELECT s.doc_id, source, size, CASE q WHEN 1 THEN {GOOD} WHEN 0 THEN {POOR} ELSE {UNKNOWN} END AS weight,
    -ln((CAST(CAST('0x' || substr(md5(name), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / {float(1 << 52)}) / CASE q WHEN 1 THEN {GOOD} WHEN 0 THEN {POOR} ELSE {UNKNOWN} END AS key
    FROM s LEFT JOIN q ON s.doc_id = q.doc_id),
  z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
  w AS MATERIALIZED (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS share FROM z),
  l(level, final) AS (SELECT coalesce(sum(source_size) * 150 / 100 / sum(share), 0), false FROM w
    UNION ALL SELECT greatest(fresh, level), fresh <= level FROM (SELECT level, coalesce((sum(source_size) * 150 / 100 - sum(CASE WHEN share * level > source_size * 2 THEN source_size * 2 ELSE 0 END))
      / sum(CASE WHEN share * level <= source_size * 2 THEN share END), 0) AS fresh FROM l, w WHERE NOT final GROUP BY level)),
  t AS (SELECT source, source_size, least(share * (SELECT max(level) FROM l), CAST(source_size * 2 AS DOUBLE)) AS target FROM w),
  e AS (SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
    FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, source, CAST(weight AS DOUBLE) AS weight, epochs,
  CAST(epochs * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - epochs * source_size - earlier)) AS BIGINT) AS taken FROM e"""
