"""Candidates of a query against all pairs of texts."""

import random

import pytest
from pyspark.sql import functions as F

from placemill.functions.similarity import token_set_ratio
from placemill.operators import resolve

WORDS = ["cafe", "coffee", "hotel", "hotels", "dan", "danny", "garden", "gardens", "burger", "burgers", "a", "ab", "x", "north", "south", "shalom", "pizza", "the", "of", "jerusalem", "tel", "aviv"]


def some_names(r, n):
    def one():
        text = " ".join(r.choice(WORDS) for _ in range(r.randint(1, 4)))
        if r.random() < 0.5:  # letters that are gone or new
            k = r.randrange(len(text))
            text = text[:k] + r.choice(["", "z", " "]) + text[k + r.randint(0, 1) :]
        return " ".join(text.split())

    return sorted({one() for _ in range(n)} - {""})


@pytest.mark.parametrize("least", [0.87, 0.8])
def test_no_pair_of_a_high_ratio_is_missed(spark, least):
    r = random.Random(8)
    queries, names = some_names(r, 250), some_names(r, 700)
    got = {tuple(x) for x in resolve.candidates(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame([(n,) for n in names], "name string"), least).collect()}
    want = {(q, n) for q in queries for n in names if token_set_ratio(q, n) >= 100 * least}
    assert want <= got and len(want) > 500
    assert len(got) < 0.5 * len(queries) * len(names)


def test_candidates_of_very_many_names(spark):
    """100,000 distinct names, every sixth with a common word: a query without it meets few of them, one with it the sixth that has it."""
    key = F.sha2(F.col("id").cast("string"), 256)
    letters = lambda at, n: F.translate(F.substring(key, at, n), "0123456789", "ghijklmnop")
    names = spark.range(100_000).select("id", F.concat(F.when(F.col("id") % 6 == 0, "hotel ").otherwise(""), letters(1, 9), F.lit(" "), letters(20, 7)).alias("name"))
    queries = names.filter("id < 120").select("id", F.col("name").alias("query"))
    met = resolve.candidates(queries.select("query"), names.select("name")).join(queries, "query").groupBy((F.col("id") % 6 == 0).alias("common")).agg(F.count("*").alias("n")).collect()
    n = {r["common"]: r["n"] for r in met}
    assert n[True] <= 20 * (100_000 / 6 + 10_000) and n[False] < 100 * 10_000
