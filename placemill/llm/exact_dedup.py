"""Exact dedup: group by a 128-bit content hash, keep one stable id, compare bytes inside groups.

Null texts count as empty ones.  The row kept is the one with the largest doc_id ("last") or the smallest ("first"); of
rows that repeat both doc_id and text one is kept.  Rows without an id lose to rows with one.  An empty table gives an
empty result.  Columns of the input besides the id and the text are not read, so clashing names can't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placemill.llm.common import cut, cut_few, table

#: Groups of several rows (16 bytes each) up to which their hashes are broadcast; beyond it the rows are joined by a shuffle.
BROADCAST_ROWS = 200_000


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "last", hasher=content_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each input row.

    Hashes and ids are what is shuffled; the texts are only looked at again in groups of more than one row.  There the least and the greatest
    text are the byte comparison: they are equal only if all texts in the group are.  Both are map-side aggregates, so a group of any
    size sends one row a task.  Groups that fail the comparison (collisions) are grouped again by the text itself.
    """
    if keep not in ("last", "first"):
        raise ValueError("keep must be 'last' or 'first'")
    best = F.max if keep == "last" else F.min
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", hasher(F.col("text")))
    small = rows.select("doc_id", "hash", F.sha2("text", 256).alias("text_sha256"))
    # groups of one row need nothing; the others are few where texts repeat little
    groups = cut(rows.groupBy("hash").agg(F.count("*").alias("group_size"), best("doc_id").alias("keep_id")).filter("group_size > 1"))
    near = F.broadcast if groups.count() <= BROADCAST_ROWS else lambda df: df
    low_high = rows.join(near(groups.select("hash")), "hash", "left_semi").groupBy("hash").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    collided = cut_few(low_high.filter("low <> high").select("hash"))

    def grouped(some: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
        sizes, ids = F.coalesce("group_size", F.lit(1).cast("long")), F.coalesce("keep_id", "doc_id")
        return some.join(near(groups), keys, "left").select("doc_id", "hash", "text_sha256", sizes.alias("group_size"), ids.alias("keep_id"))

    if collided.isEmpty():
        found = grouped(small, groups, ["hash"])
    else:
        odd = rows.join(collided, "hash", "left_semi")
        by_text = odd.groupBy("hash", "text").agg(F.count("*").alias("group_size"), best("doc_id").alias("keep_id"))
        found = grouped(small.join(collided, "hash", "left_anti"), groups, ["hash"])
        found = found.unionByName(grouped(odd.withColumn("text_sha256", F.sha2("text", 256)), by_text, ["hash", "text"]))
    one = Window.partitionBy("doc_id", "text_sha256").orderBy("hash")  # rows of one id and text only
    return found.withColumn("_n", F.row_number().over(one)).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_n") == 1)).alias("kept"), "text_sha256"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
