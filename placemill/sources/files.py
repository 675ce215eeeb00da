"""Readers and writers of the sheet, answers and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from placemill.functions import dates
from placemill.operators.reads import CATEGORIES

ANSWER = T.StructType([
    T.StructField("name_he", T.StringType()), T.StructField("name_en", T.StringType()), T.StructField("city_hint", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("phone", T.StringType()), T.StructField("phone_kind", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("note_he", T.StringType()), T.StructField("status", T.StringType()), T.StructField("confidence", T.DoubleType()),
])
ANSWERS = T.StructType([T.StructField("index", T.IntegerType()), T.StructField("places", T.ArrayType(ANSWER)), T.StructField("_corrupt_record", T.StringType())])
KINDS = ["single_location", "chain", "online_only", "unclear"]


def sheet_cells(spark: SparkSession, path: str) -> DataFrame:
    """(row, reported_at, field, text) of sheets (date, ignored, voucher, fighter) that each have a header; rows of under four columns and blank cells go.

    Rows are numbered as one sheet in the order of the files, the header of the first being row 1; a file is read whole by one task, since its cells may hold line breaks.
    """
    schema = "c0 string, c1 string, c2 string, c3 string, _corrupt_record string"
    lines = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("columnNameOfCorruptRecord", "_corrupt_record").csv(path)
    placed = lines.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    numbered = placed.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("at")))
    counts = numbered.groupBy("file").agg(F.max("n").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    body = numbered.join(F.broadcast(counts.select("file", before.alias("before"))), "file")  # one row a file
    body = body.withColumn("row", F.col("before") + F.col("n") + 1).filter("_corrupt_record IS NULL OR c3 IS NOT NULL")
    fields = F.inline(F.array(F.struct(F.lit("vacation_voucher").alias("field"), F.col("c2").alias("text")), F.struct(F.lit("fighter_card").alias("field"), F.col("c3").alias("text"))))
    return body.select("row", dates.parse_stamp(F.col("c0")).alias("reported_at"), fields).withColumn("text", F.trim("text")).filter("text <> ''")


def split_sheet_cells(spark: SparkSession, path: str) -> DataFrame:
    """`sheet_cells` of sheets of any size: each is read in splits, by as many tasks, also where cells hold line breaks.

    A line begins a record where the number of quotes before it in its file is even.  Quotes and lines are counted by split, so that a split knows from the sums of
    those before it whether it begins inside quotes and how many records there were.  Lines of one record meet in one row, and nothing else does.
    Blank lines between records count as none.  Line breaks inside cells are \n.
    """
    schema = "c0 string, c1 string, c2 string, c3 string"
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    lines = lines.withColumn("value", F.regexp_replace(F.regexp_replace("value", "\\r$", ""), "^\ufeff", "")).withColumn("quotes", F.regexp_count("value", F.lit('"')))
    inside = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("odd", F.coalesce(F.sum("quotes").over(inside), F.lit(0)) % 2)
    # a blank line inside quotes is part of a cell, so whether it counts depends on how its split begins
    filled = F.trim("value") != ""
    splits = lines.groupBy("file", "split").agg(F.sum("quotes").alias("quotes"), F.count_if((F.col("odd") == 0) & filled).alias("even"), F.count_if((F.col("odd") == 1) & filled).alias("uneven"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = splits.withColumn("begins", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    splits = splits.withColumn("records", F.when(F.col("begins") == 0, F.col("even")).otherwise(F.col("uneven")))
    splits = splits.select("file", "split", "begins", F.coalesce(F.sum("records").over(earlier), F.lit(0)).alias("before"))
    joined = lines.join(splits, ["file", "split"])
    outside = (F.col("odd") + F.col("begins")) % 2 == 0
    upto = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    joined = joined.filter(filled | ~outside).withColumn("record", F.col("before") + F.sum((outside & filled).cast("int")).over(upto))
    line = F.struct("split", "at", "value")
    records = joined.groupBy("file", "record").agg(F.sort_array(F.collect_list(line)).alias("lines"))  # the lines of one record
    text = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
    counts = joined.groupBy("file").agg((F.max("record") - 1).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cell = F.from_csv(text, schema, {"escape": '"'})
    body = records.filter("record > 1").select("file", "record", cell.alias("c")).join(F.broadcast(counts.select("file", before.alias("earlier"))), "file")  # one row a file
    fields = F.inline(F.array(F.struct(F.lit("vacation_voucher").alias("field"), F.col("c.c2").alias("text")), F.struct(F.lit("fighter_card").alias("field"), F.col("c.c3").alias("text"))))
    body = body.filter("c.c3 IS NOT NULL OR c.c2 IS NOT NULL").withColumn("row", F.col("earlier") + F.col("record"))
    return body.select("row", dates.parse_stamp(F.col("c.c0")).alias("reported_at"), fields).withColumn("text", F.trim("text")).filter("text <> ''")


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A file that is one JSON array."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_answers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid places by index, (line, why) of what isn't) of a JSON Lines file of answers."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", ANSWERS, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("a")).select("a.*")
    broken = lines.filter("_corrupt_record IS NOT NULL").select(F.col("_corrupt_record").alias("line"), F.lit("not JSON of this shape").alias("why"))
    places = lines.filter("_corrupt_record IS NULL").select("index", F.explode("places").alias("p"))
    p = F.col("p")
    checks = {
        "name": F.coalesce(p["name_he"] != "", F.lit(False)), "kind": F.coalesce(p["kind"].isin(*KINDS), F.lit(False)), "category": F.coalesce(p["category"].isin(*CATEGORIES), F.lit(False)),
        "confidence": F.coalesce(p["confidence"].between(0.0, 1.0), F.lit(False)),
    }
    why = F.concat_ws(",", *[F.when(~ok, F.lit(name)) for name, ok in checks.items()])
    return places.filter(why == "").select("index", "p.*"), broken.unionByName(places.filter(why != "").select(F.to_json("p").alias("line"), why.alias("why")))


def parse_answers(body: Column) -> Column:
    """Answers in a column of JSON, null where it doesn't parse."""
    return F.from_json(body, T.ArrayType(T.StructType(ANSWERS.fields[:2])))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def replace_table(df: DataFrame, path: str, key: str | None = None) -> None:
    """A table written anew beside the old one's readers: to a new folder, one per version."""
    (df.repartitionByRange(F.col(key)).sortWithinPartitions(key) if key else df).write.mode("errorifexists").parquet(path)
