"""What the operators share: the table reader, checkpoints in the shared folder, distributed ranks and components."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word, as Java's regular expressions have it.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of the Arrow batches that go to Python workers; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
#: Rows of a narrow table that one task writes at least.
CUT_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of its own only where none is named and Spark runs in this one process, as in tests."""
    context = spark.sparkContext
    at = context._jsc.sc().getCheckpointDir()
    if at.isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
        at = context._jsc.sc().getCheckpointDir()
    return at.get()


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bytes of an Arrow batch to BATCH_BYTES, unless they were set to something else than Spark's default."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(key, str(BATCH_BYTES))


def release() -> None:
    """Gives free memory of this worker back to the system, since an idle worker keeps what it has."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(f, schema) with small batches, and with workers that keep no memory between partitions."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return df.mapInArrow(run, schema)


def as_rows(docs: DataFrame) -> Column:
    """A struct of all columns of docs, so that an operator's own columns can't clash with them; `row.*` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def cut(df: DataFrame, rows: int | None = None, dear: bool = False) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir and read again, so that lost executors repeat nothing before it.

    rows: how many there are at most, if the caller knows; few rows are written by few tasks, CUT_ROWS each, so that small tables aren't hundreds of
    files.  dear: what makes the rows is work for many tasks, so that the rows are shuffled to the few.
    """
    shared_folder(df.sparkSession)
    if rows is not None:
        parts = max(2, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // CUT_ROWS)))
        df = df.repartition(parts) if dear else df.coalesce(parts)
    return df.checkpoint(eager=True)


def cut_few(df: DataFrame) -> DataFrame:
    """`cut` of the small rest of a table that a filter leaves (one row of hundreds): written by a sixteenth of the tasks."""
    return cut(df.repartition(max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16)))


class Store:
    """Tables bucketed by a key in the warehouse: joins and groupings by that key read them without a shuffle."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.held = spark, f"{name}_{uuid.uuid4().hex}", []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def put(self, df: DataFrame, *keys: str) -> DataFrame:
        name = f"{self.name}_{len(self.held)}"
        self.held.append(name)
        writer = df.write.format("parquet").option("compression", "zstd")
        (writer.bucketBy(self.buckets, *keys).sortBy(*keys) if keys else writer).saveAsTable(name)
        return self.spark.table(name)

    def close(self) -> None:
        for name in self.held:
            self.spark.sql(f"DROP TABLE IF EXISTS {name} PURGE")

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def tidy(spark: SparkSession) -> None:
    """Lets go of the files of shuffles that no frame refers to: Spark does so only when the driver collects its garbage."""
    spark.sparkContext._jvm.System.gc()


def ranked(df: DataFrame, order: list[Column], add: Column | None = None, name: str = "rank", parts: int | None = None, rows: int | None = None) -> DataFrame:
    """df with a global running number (or running sum of `add`, inclusive) in the given order, without one task for all rows.

    Range-partitions, cuts, counts each range and adds the ranges' offsets: one row a range is all that meets.  rows: as in `cut`.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.lit(1).cast("long") if add is None else add
    at = cut(df.withColumn("_v", value).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), rows)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = at.groupBy("_part").agg(F.sum("_v").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        at.join(F.broadcast(offsets.select("_part", "_before")), "_part")  # one row a partition
        .withColumn(name, F.sum("_v").over(within) + F.col("_before"))
        .drop("_v", "_part", "_before")
    )


def components(links: DataFrame) -> DataFrame:
    """(id, component) for the ids in links (a, b) that reach a smaller one: the smallest; all others are left to the caller.

    Alternates large-star and small-star steps; minima are taken map-side, joins on a hub
    are left to AQE to split, each round is cut, and nothing grows with the square of a component.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    before = mark(edges)
    while True:
        # large star: every larger neighbour of a node links to the node's smallest neighbour
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node's smaller neighbours and the node itself link to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        after = cut(small.union(least.select("a", F.col("m").alias("b"))).distinct(), 2 * before[0])
        edges, now = after, mark(after)
        if now == before:
            break
        before = now
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
