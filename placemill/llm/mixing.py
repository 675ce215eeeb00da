"""Mixing sources to target weights by weighted fair queueing, natively.

Every document of a source is shuffled (a seeded hash of its id); copy e of it finishes at the virtual time
(words of its source up to it + e * words of the source) / target of the source.  The mix is the start of all copies in the
order of their finish times, up to the budget.  Targets share the budget by weight, but none exceeds `most` times its source;
the excess is shared again by weight.

Defined cases: null and empty texts have size 0 and are taken 0 times; the null source is a source, last in order; repeated
rows are documents of their own; documents of equal hash go by id and size; an empty table gives an empty result.  Columns besides
doc_id, source and text are carried along and never clash with the operator's own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placemill.llm.common import WORD, as_rows, cut, ranked, shared_folder, table

#: Hex digits of the shuffling hash that name a part of a source's order: each of the 4096 is summed by itself, so a source that has
#: a third of all rows is dealt to as many tasks.
DIGITS = 3
#: Parts of the virtual time; only the part in which the budget ends is looked at copy by copy.
TICKS = 65536


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """sources (no_source, source, source_size) with weight and target.

    The level at which the shares stop is where the sources, ordered by the level that fills them, have used up the budget:
    one sorted pass instead of repeated resharing.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    n = sources.count()
    at = ranked(sources, [F.col("no_source"), F.col("source")], rows=n).withColumn("weight", weight).drop("rank")
    at = at.withColumn("full_at", most * F.col("source_size") / F.col("weight"))
    order = [F.col("full_at"), F.col("no_source"), F.col("source")]
    at = cut(ranked(ranked(at, order, F.col("source_size"), "size_to", rows=n), order, F.col("weight"), "weight_to", rows=n), n)
    all_size, all_weight = at.agg(F.sum("source_size"), F.sum("weight")).first()
    if all_size is None:
        return at.select("no_source", "source", "source_size", "weight", F.lit(0.0).alias("target"))
    # filled: the sources before this one and this one are full and the level of the rest is above
    left = F.lit(float(all_size)) - most * (F.col("size_to") - F.col("source_size"))
    level = left / (F.lit(float(all_weight)) - (F.col("weight_to") - F.col("weight")))
    stop = at.withColumn("level", level).filter(F.col("level") < F.col("full_at")).agg(F.min_by("level", F.struct(*order))).first()[0]
    target = most * F.col("source_size") if stop is None else F.least(most * F.col("source_size"), F.lit(stop) * F.col("weight"))
    return at.select("no_source", "source", "source_size", "weight", target.cast("double").alias("target"))


def queue(sizes: DataFrame, weights: tuple[float, ...], most: int, seed: int) -> DataFrame:
    """sizes (doc_id, source, size; a column `key` is carried along) with source_size, target and first: the virtual time at which a document's first copy finishes."""
    carried = [c for c in sizes.columns if c == "key"]
    keyed = sizes.withColumn("no_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    keyed = keyed.withColumn("shuffled", F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), F.lit("")))
    keyed = cut(keyed.withColumn("bucket", F.substring("shuffled", 1, DIGITS)))
    by = ["no_source", "source"]
    buckets = cut(keyed.groupBy(*by, "bucket").agg(F.sum("size").alias("in_bucket")))
    sources = targets(buckets.groupBy(*by).agg(F.sum("in_bucket").alias("source_size")), weights, most)
    to = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 16 ** DIGITS rows
    offsets = buckets.withColumn("before", F.coalesce(F.sum("in_bucket").over(to), F.lit(0))).drop("in_bucket").join(sources, by)
    within = Window.partitionBy(*by, "bucket").orderBy("shuffled", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    served = keyed.withColumn("served", F.sum("size").over(within)).join(offsets, [*by, "bucket"])
    return cut(
        served.select(
            *carried, "doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target", "shuffled",
            ((F.col("before") + F.col("served")) / F.nullif(F.col("target"), F.lit(0.0))).alias("first"),
        )
    )


def mix(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = 3, seed: int = 17) -> DataFrame:
    """sizes (doc_id, source, size) with source_size, target and taken: size times the copies that the mix takes."""
    queued = queue(sizes, weights, most, seed)
    finishes = [F.col("first") + F.lit(e) * F.col("source_size") / F.col("target") for e in range(most)]
    # a time from 0 to infinity as a part of TICKS: all steps round monotonically, so the parts are in the order of the times
    tick = lambda t: F.floor((1 - 1 / (1 + t)) * TICKS).cast("int")
    each = F.array(*[F.struct(f.alias("finish"), tick(f).alias("tick"), F.lit(e).alias("copy")) for e, f in enumerate(finishes)])
    copies = queued.filter("size > 0").select("doc_id", "shuffled", "size", F.inline(each))
    ticks = cut(copies.groupBy("tick").agg(F.sum("size").alias("words")), TICKS + 1)
    budget = sizes.agg(F.sum("size")).first()[0] or 0
    run = ticks.withColumn("to", F.sum("words").over(Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)))
    last = run.filter(F.col("to") > budget).orderBy("tick").select("tick", "words", (F.col("to") - F.col("words")).alias("before")).first()
    key = ["finish", "shuffled", "doc_id", "copy"]
    end = None  # of the copies in the part in which the budget ends, the last one taken
    if last is not None:
        inside = ranked(copies.filter(F.col("tick") == last["tick"]).select(*key, "size"), [F.col(k) for k in key], F.col("size"), "to", rows=last["words"])  # a copy has a word at least
        end = inside.filter(F.col("to") + last["before"] <= budget).agg(F.max(F.struct(*key)).alias("end")).first()["end"]

    def goes(e: int) -> Column:
        if last is None:  # the budget takes all copies
            return F.lit(True)
        before = tick(finishes[e]) < last["tick"]
        if end is None:
            return before
        row = F.struct(finishes[e].alias("finish"), F.col("shuffled"), F.col("doc_id"), F.lit(e).alias("copy"))
        stop = F.struct(F.lit(end["finish"]).alias("finish"), F.lit(end["shuffled"]).alias("shuffled"), F.lit(end["doc_id"]).cast("long").alias("doc_id"), F.lit(end["copy"]).alias("copy"))
        return before | ((tick(finishes[e]) == last["tick"]) & (row <= stop))

    taken = sum((F.when((F.col("size") > 0) & goes(e), F.col("size")).otherwise(F.lit(0)).cast("long") for e in range(most)), F.lit(0).cast("long"))
    return queued.select(*[c for c in sizes.columns if c == "key"], "doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    return mix(docs.select(F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size")), **options)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs (doc_id, source, text and more) with each row as often as the mix takes it, all columns kept, whatever they are called.

    Every row has a key of its own, its place in a copy of docs beside the checkpoints, so rows that repeat an id get their own copies, and what is written
    is what is taken.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), as_rows(docs).alias("row"))
    folder = f"{shared_folder(spark)}/mixed-{uuid.uuid4().hex}"
    keyed.write.option("compression", "zstd").parquet(folder)
    rows = spark.read.parquet(folder)
    copies = mix(rows.select("key", "doc_id", "source", "size"), **options).filter("taken > 0").select("key", F.expr("taken div size").cast("int").alias("n"))
    out = rows.select("key", "row").join(copies, "key")
    return out.select("row", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("copy")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents")).drop("source")


SQL = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('17:' || doc_id) AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size,
               CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
        FROM s GROUP BY source),
runs AS (SELECT *, 3 * source_size / w AS full_at, sum(source_size) OVER o AS size_to, sum(w) OVER o AS weight_to FROM src
         WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (SELECT *, ((SELECT sum(source_size) FROM src)::DOUBLE - 3 * (size_to - source_size)) / ((SELECT sum(w) FROM src) - (weight_to - w)) AS level FROM runs),
stop AS (SELECT level FROM level WHERE level < full_at ORDER BY full_at, source NULLS LAST LIMIT 1),
goal AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, coalesce((SELECT level FROM stop) * w, (3 * source_size)::DOUBLE)) AS target FROM src),
q AS (SELECT s.*, source_size, target, sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::DOUBLE / nullif(target, 0) AS first
      FROM s JOIN goal ON s.source IS NOT DISTINCT FROM goal.source),
c AS (SELECT doc_id, size, sum(size) OVER (ORDER BY first + e * source_size / target, h, doc_id, e ROWS UNBOUNDED PRECEDING) AS upto
      FROM q, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0),
t AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM c WHERE upto <= (SELECT sum(size) FROM s) GROUP BY doc_id)
SELECT q.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN t ON q.doc_id = t.doc_id
"""
