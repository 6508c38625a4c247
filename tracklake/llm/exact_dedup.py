"""Exact deduplication by content-defined chunk recipes, with DataFrame and SQL functions only.

A text, each run of white space [\\x20\\x09-\\x0D] replaced by one space, is cut where its own
content says so: after a space that follows a letter a-m and a punctuation mark, at least MIN_CHUNK
characters after the last cut and MAX_CHUNK at most. A chunk's identifier is its 64-bit hash.
Identifiers are verified over all distinct chunks: where one stands for two SHA-256 digests, the
documents that hold it carry the digests of their chunks too. Two documents are equal when
their ordered identifier lists are; the lists, not the texts, are what is grouped and joined, so a
text is read once and never shuffled. Equal recipes are confirmed by the digest of the whole text.

Defined cases: a null text counts as empty, and all empty texts are equal. A row without doc_id
stays only if no row of the group has one: then keep_id is null and one such row stays. Of
repeated rows of the smallest doc_id one is kept. An empty table gives no rows. Other columns are
ignored, or kept as they are by keep().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import own_name, picked, save

MIN_CHUNK, MAX_CHUNK = 512, 8192
SPACE = r"[\x20\x09-\x0D]+"


def chunk_pattern(least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> str:
    return rf"(?s).{{{least},{most}}}?(?:(?<=[a-m][.,;:!?] )|\z)|.{{1,{most}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def recipes(documents: DataFrame, id_bits: int = 64, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """doc_id, row, text_sha256, ids and proofs: the hash and the SHA-256 digest of each chunk in order; row tells repeated rows apart."""
    short = lambda c: F.xxhash64(c) if id_bits == 64 else F.pmod(F.xxhash64(c), F.lit(1 << id_bits))
    cut = documents.select("doc_id", normalised(F.col("text")).alias("norm")).select("doc_id", F.unhex(F.sha2("norm", 256)).alias("digest"), F.regexp_extract_all("norm", F.lit(chunk_pattern(least, most)), F.lit(0)).alias("chunks"))
    return cut.select("doc_id", F.monotonically_increasing_id().alias("row"), "digest", F.transform("chunks", short).alias("ids"), F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256))).alias("proofs"))


def verified(made: DataFrame) -> DataFrame:
    """The recipes (written), with proofs only for rows that hold an identifier of two distinct chunks."""
    distinct = made.select(F.explode(F.arrays_zip("ids", "proofs")).alias("c")).select("c.ids", "c.proofs").distinct()
    shared = save(distinct.groupBy("ids").count().where("count > 1").select(F.col("ids").alias("id")), "shared-ids")
    if shared.isEmpty():
        return made.withColumn("proofs", F.lit(None).cast("array<binary>"))
    holders = made.select("row", F.explode("ids").alias("id")).join(shared, "id", "left_semi").select("row").distinct().withColumn("held", F.lit(True))
    return made.join(holders, "row", "left").select("doc_id", "row", "digest", "ids", F.when(F.col("held"), F.col("proofs")).alias("proofs"))


def dedup(documents: DataFrame, id_bits: int = 64, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of documents.

    Recipes decide; that all texts of a recipe have one digest confirms them, and the query fails if not.
    """
    made = verified(save(recipes(documents, id_bits, least, most), "recipes"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = made.groupBy("ids", "proofs").agg(first, F.count("*").alias("group_size"), F.min("digest").alias("d1"), F.max("digest").alias("d2"))
    sound = F.when(F.col("d1") == F.col("d2"), F.col("first.row")).otherwise(F.raise_error(F.lit("one recipe, two texts")).cast("long"))
    g = groups.select(F.col("ids").alias("i"), F.col("proofs").alias("p"), F.col("first.doc_id").alias("keep_id"), sound.alias("keep_row"), "group_size")
    joined = made.join(g, (F.col("ids") == F.col("i")) & F.col("proofs").eqNullSafe(F.col("p")))
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep(documents: DataFrame) -> DataFrame:
    """The rows of documents that stay, with all their columns, whatever their names; of repeated rows one.

    Only ids move: a doc_id of which no row stays is dropped by an anti join. Ids of which some rows stay
    (repeated rows, rows without doc_id) go by their text too, one row for each text.
    """
    judged = save(dedup(documents), "judged")
    every = judged.groupBy("doc_id").agg(F.count_if("kept").alias("stay"), F.count("*").alias("n"))
    gone = save(every.where("stay < n"), "gone")
    single = picked(documents, gone.select("doc_id"), "left_anti")
    mixed = save(gone.where("stay > 0").select("doc_id"), "mixed")
    if mixed.isEmpty():
        return single
    sha, own, other = own_name(), own_name(), own_name()
    stay = judged.where("kept").join(mixed.toDF(own), F.col("doc_id").eqNullSafe(F.col(own)), "left_semi").select(F.col("doc_id").alias(own), F.col("text_sha256").alias(other))
    rows = picked(documents, mixed).withColumn(sha, F.sha2(normalised(F.col("text")), 256))
    rows = rows.join(stay, rows["doc_id"].eqNullSafe(F.col(own)) & (F.col(sha) == F.col(other)), "left_semi").dropDuplicates(["doc_id", sha])
    return single.unionByName(rows.drop(sha))


ORACLE = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
  h AS (SELECT doc_id, sha256(norm) AS text_sha256 FROM n),
  g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM h JOIN g USING (text_sha256)"""
