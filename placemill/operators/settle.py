"""Cutting lineage in iterative operators, and places in an order."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is named, a temporary one, if Spark runs in this one process."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(rows: DataFrame, name: str) -> DataFrame:
    """rows with a number of their own, settled, in as many parts as shuffles have: few small rows may be much work."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(rows.repartition(parts, *rows.columns).withColumn(name, F.monotonically_increasing_id()))


def tidy(spark: SparkSession) -> None:
    """Lets go of the files of shuffles and settled frames that nothing refers to: Spark does so only when the driver collects its garbage."""
    spark.sparkContext._jvm.System.gc()


def numbered(rows: DataFrame, name: str = "place") -> DataFrame:
    """rows, which are sorted, with their place in that order, from 1: by their partitions' row counts, so no task gets all rows."""
    at = settled(rows.withColumns({"_part": F.spark_partition_id(), "_n": F.monotonically_increasing_id()}))
    counts = at.groupBy("_part").agg(F.count("*").alias("_rows"))  # one row a partition
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.col("_n") - F.shiftleft(F.col("_part").cast("long"), 33) + 1  # how Spark numbers the rows of a partition
    return at.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_n", "_before")
