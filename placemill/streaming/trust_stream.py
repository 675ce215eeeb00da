"""Trust states kept up to date from a stream of reports.

The fold depends on the order of a place's reports, and late ones may come, so a micro-batch recomputes the places that it touches from
the whole log of those places: the same function as in batch.  The log lies in BUCKETS folders by a hash of the place, and a batch reads the folders of
its own places only, however long the log of all others is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placemill.operators import trust


#: Folders of the log.
BUCKETS = 1024


def touched_states(places: DataFrame, log: DataFrame, batch: DataFrame, days: int = trust.WINDOW_DAYS) -> DataFrame:
    ids = batch.select("place_id").distinct()
    return trust.trust_state(places.join(ids, places["id"] == ids["place_id"], "left_semi"), log.join(ids, "place_id", "left_semi"), days)


def append(batch: DataFrame, number: int, log_path: str, buckets: int = BUCKETS) -> list[int]:
    """Adds a batch to the log, one file a bucket, and returns its buckets; a batch that is repeated overwrites itself."""
    kept = batch.withColumns({"bucket": F.pmod(F.xxhash64("place_id"), F.lit(buckets)), "batch_id": F.lit(number)})
    kept.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").parquet(log_path)
    return [r["bucket"] for r in kept.select("bucket").distinct().collect()]  # `buckets` numbers at most


def read_log(spark: SparkSession, log_path: str, touched: list[int]) -> DataFrame:
    """The log of the buckets `touched`: no other folder is listed or read."""
    return spark.read.option("basePath", log_path).parquet(*[f"{log_path}/bucket={k}" for k in sorted(touched)])


def run(
    reports: DataFrame, places: Callable[[], DataFrame], log_path: str, sink: Callable[[DataFrame, int], None], checkpoint: str, days: int = trust.WINDOW_DAYS, trigger: dict | None = None, buckets: int = BUCKETS
) -> StreamingQuery:
    """Starts the query: each batch of the reports is appended to the log once (by its number) and the states that it changes go to the sink."""

    def step(batch: DataFrame, number: int) -> None:
        touched = append(batch, number, log_path, buckets)
        if touched:
            log = read_log(batch.sparkSession, log_path, touched)
            sink(touched_states(places(), log, log.filter(F.col("batch_id") == number), days), number)

    return reports.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def hourly_kinds(reports: DataFrame, late: str = "1 hour") -> DataFrame:
    """Reports by hour and kind, for a dashboard; rows later than the watermark are left out."""
    return reports.withWatermark("created_at", late).groupBy(F.window("created_at", "1 hour").alias("hour"), "kind").agg(F.count("*").alias("n"))
