import pytest

EDGES = [
    (900_001, None, None, None), (900_002, "", "en", "s"), (900_003, "a b c", "en", "s"), (900_004, "A B  c", "en", "s"), (900_005, "a b c d", "en", None), (900_006, "é z " * 30, "fr", "s"),
    (900_007, "a b c d", "en", "s"), (900_008, "x\x0b" + "  ".join("abcdefghijklmno"), "en", "t"), (900_008, "x\x0b" + "  ".join("abcdefghijklmno"), "en", "t"), (900_009, "\n\n \n", "en", "t"),
    (None, " ".join("abcdefghijklmnopqrs"), "en", "t"), (900_010, " ".join("abcdefghijklmnopqrs"), "en", "t"), (900_011, "word " * 30_000, "en", "long"), (900_012, "w" * 100_000, None, "long"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """A few hundred documents with planted copies, and the odd cases; also a column of a clashing name."""
    from pyspark.sql import functions as F

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    near = table.filter("doc_id < 40").select((F.col("doc_id") + 5000).alias("doc_id"), F.concat("text", F.lit(" one more\nAnd a line")).alias("text"), "lang", "source")
    same = table.filter("doc_id < 20").select((F.col("doc_id") + 6000).alias("doc_id"), "text", "lang", "source")
    parts = table.filter("doc_id between 50 and 70").select((F.col("doc_id") + 7000).alias("doc_id"), F.concat(F.lit("begins here "), F.substring("text", 50, 700)).alias("text"), "lang", "source")
    odd = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string")
    every = table.select("doc_id", "text", "lang", "source").union(near).union(same).union(parts).union(odd)
    return every.withColumn("kept", F.lit("other")).withColumn("size", F.lit(-1)).withColumn("rank", F.lit(-1)).repartition(4, "doc_id").cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
