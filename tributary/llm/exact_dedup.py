"""Exact dedup by recipes of content-defined chunks.

A text is cut where its own characters say so, each chunk gets a 64-bit identifier, and
a dictionary of distinct chunks proves by comparing the chunks themselves that an
identifier stands for one chunk.  Texts are then equal when their ordered lists of
identifiers are; the texts themselves move once, as distinct chunks, and never again.

Defined results: null text counts as empty; texts are compared after lower-casing A-Z;
null ids never win against others, and a group of null ids only keeps all its rows;
rows with the same id and text count as copies and are all kept or all dropped; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import Scratch, lower_ascii, text_of

#: A chunk ends before a word when the characters around the blank fall into these classes; 64 to 8192 characters, the last may be shorter.
CHUNK = r"(?s).{64,8191}?(?:(?<=[enst.][\x20\n])(?=[a-h])|\z)|.{1,8192}"


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def collided(parts: DataFrame, chunk_col: str = "chunk") -> DataFrame:
    """Identifiers that stand for more than one chunk: distinct chunks are grouped as they are, then by identifier."""
    distinct = parts.select(F.xxhash64(chunk_col).alias("id"), chunk_col).distinct()
    return distinct.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")


def recipes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Per row: doc_id, text_sha256 and recipe, the verified identifiers of its chunks in order."""
    text = lower_ascii(text_of("text"))
    normal = docs.select("doc_id", text.alias("normal"))
    cut = normal.select("doc_id", F.sha2(F.col("normal").cast("binary"), 256).alias("text_sha256"), chunks(F.col("normal")).alias("chunks"))
    rows = scratch.write(cut.select("doc_id", "text_sha256", F.transform("chunks", lambda c: F.xxhash64(c)).alias("recipe")), "recipes")
    clash = scratch.write(collided(cut.select(F.explode("chunks").alias("chunk"))), "collided")
    if clash.isEmpty():
        return rows
    # a text with a chunk whose identifier is shared is known by its digest instead, at the head of its recipe
    hit = cut.select("doc_id", "text_sha256", F.explode(F.transform("chunks", lambda c: F.xxhash64(c))).alias("id")).join(clash, "id", "left_semi").select("text_sha256").distinct()
    hit = hit.withColumn("hit", F.lit(True))
    own = F.concat(F.array(*[F.conv(F.substring("text_sha256", 1 + 15 * k, 15), 16, 10).cast("long") for k in range(4)]), "recipe")
    return rows.join(hit, "text_sha256", "left").select("doc_id", "text_sha256", F.when(F.col("hit"), own).otherwise(F.col("recipe")).alias("recipe"))


def groups(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession, "exact")
    rows = recipes(docs, scratch).withColumn("key", F.xxhash64("recipe"))
    several = rows.groupBy("key", "recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    # a table of its own, alike at every size: of a join of two tables adaptive execution can split the rows of a hot group
    several = scratch.write(several, "groups").hint("merge")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.join(several, ["key", "recipe"], "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
