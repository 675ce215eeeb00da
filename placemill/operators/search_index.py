"""An inverted index of trigrams for the search box: any part of a word is found without reading every place.

A run of the index holds (gram, id) of the places that were added together, sorted by gram in ranges, and the places themselves with their folded text, sorted by
id.  Adding makes a run more and rewrites nothing.  A query's words of three letters and more are looked up by their trigrams, a filter that reaches the scan and
skips the row groups of other grams; the lists of ids are intersected by counting, and only the places that are left are compared with the words.  A query of
shorter words only has no trigram to look up and scans the folded texts.  The rows are those of `reads.search` either way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill.functions import text

GRAM = 3


def grams(folded: Column) -> Column:
    """The distinct runs of GRAM letters in the words of a folded text."""
    words = F.filter(F.split(folded, " "), lambda w: F.length(w) >= GRAM)
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (GRAM - 1)), lambda k: F.substring(w, k, F.lit(GRAM))))))


class SearchIndex:
    """Runs in a shared folder; places are added once each, by id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, places: DataFrame) -> None:
        """A run more, of places (id, name_he, name_en, city, address_he and more) that aren't in the index yet."""
        folder, run = self.path, uuid.uuid4().hex
        rows = places.withColumn("_hay", text.haystack(F.col("name_he"), F.col("name_en"), F.col("city"), F.col("address_he")))
        rows.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{folder}/places/run={run}")
        # made from the run that was written, so that both agree
        kept = self.spark.read.parquet(f"{folder}/places/run={run}").select("id", F.explode(grams(F.col("_hay"))).alias("gram"))
        kept.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{folder}/grams/run={run}")

    def lookup(self, folded: str) -> DataFrame | None:
        """(id) of the places that have all trigrams of the folded query's words; null if it has none."""
        wanted = sorted({w[k : k + GRAM] for w in folded.split(" ") for k in range(len(w) - GRAM + 1)})
        if not wanted:
            return None
        found = self.spark.read.parquet(f"{self.path}/grams").filter(F.col("gram").isin(wanted))
        return found.groupBy("id").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(wanted)).select("id")

    def search(self, query: str) -> DataFrame:
        """The places whose folded text has every word of the query."""
        folded = self.spark.range(1).select(text.fold(F.lit(query)).alias("q")).first()["q"]
        rows = self.spark.read.parquet(f"{self.path}/places").drop("run")
        ids = self.lookup(folded)
        rows = rows if ids is None else rows.join(ids, "id", "left_semi")
        for word in filter(None, folded.split(" ")):
            rows = rows.filter(F.contains("_hay", F.lit(word)))
        return rows.drop("_hay")
