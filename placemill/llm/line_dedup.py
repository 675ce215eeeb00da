"""Line dedup, natively: repeated runs of lines by a suffix array over line ids that is built by prefix doubling.

A document is the sequence of its lines that have a word; blank lines stay where they are and belong to no run.  Round 0 gives each
suffix the rank of its first line; each round after it ranks the suffixes by pairs of ranks, half a run apart, so that equal ranks are equal
runs of one, `min_lines`, twice `min_lines`, four times ... lines.  Ranks are the places of the distinct keys in a distributed sort
(each range adds the count of the ranges before), so no task sees all suffixes.  Suffixes of one rank are an interval of the suffix array
whose common prefix is at least as long as the round's runs; those whose rank is unique leave the rounds, which end when the
longest repeated run is passed.

Of every run of at least `min_lines` lines, or one line of at least `min_words` words, that occurs more than once, the first copy in the order (doc_id,
place) stays, and the lines of the later ones are deleted, also inside one document.  A suffix that isn't the first of its interval
covers its run; the longest interval of a suffix is at least half its longest common prefix with anything earlier, and the
rest of that prefix is covered by the suffixes inside it, so the runs that overlap in a document add up to the maximal ones.

Null and empty texts have no lines and stay as they are; texts that lose nothing keep their bytes.  Rows without an id are left alone.  Rows that
repeat an id and a text are one document.  An empty table gives an empty result.  Columns besides doc_id and text are carried along and
never clash with the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placemill.llm.common import WORD, as_rows, cut, ranked, table

MIN_LINES, MIN_WORDS = 2, 50


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _positions(docs: DataFrame) -> DataFrame:
    """(doc_id, key, line, words, place, pos): place among all lines, pos among those with a word; key: the text's hash."""
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("key"), F.posexplode(_lines(F.col("text"))).alias("place", "text_line"))
    rows = rows.filter(F.regexp_like("text_line", F.lit(WORD)))
    rows = rows.select("doc_id", "key", "place", F.regexp_count("text_line", F.lit(WORD)).alias("words"), F.md5("text_line").alias("line")).distinct()
    own = Window.partitionBy("doc_id", "key").orderBy("place")  # one document
    return rows.withColumn("pos", F.row_number().over(own).cast("long") - 1)


def _groups(suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys that more than one suffix has, with the first suffix's place."""
    first = F.min(F.struct("doc_id", "key", "pos")).alias("first")
    return suffixes.groupBy(*keys).agg(F.count("*").alias("n"), first).filter("n > 1").drop("n")


def _rank(groups: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    return ranked(groups, [F.col(k) for k in keys], rows=rows)


def intervals(at: DataFrame, min_lines: int) -> Iterator[tuple[int, DataFrame]]:
    """(lines, suffixes) of each round: the suffixes (doc_id, key, pos, rank, first) whose run of so many lines occurs more than once.

    first is the place (doc_id, key, pos) of the run's first copy.
    """
    here = cut(at.join(_rank(_groups(at, ["line"]), ["line"]), "line").select("doc_id", "key", "place", "pos", "words", "rank", "first"))
    have, document = 1, Window.partitionBy("doc_id", "key").orderBy("pos")
    while n := here.count():
        yield have, here
        step = min(have, min_lines - have) if have < min_lines else have  # up to `min_lines` the halves may overlap
        # the suffix `step` lines on has to be among those that are left
        ahead = F.max("rank").over(document.rangeBetween(step, step))
        pairs = here.select("doc_id", "key", "pos", F.col("rank").alias("left"), ahead.alias("right")).filter("right IS NOT NULL")
        groups = _rank(_groups(pairs, ["left", "right"]), ["left", "right"], n)
        here = cut(pairs.join(groups, ["left", "right"]).drop("left", "right"), n)
        have += step


def repeated(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, place, run) of the lines of docs (doc_id, text) that later copies of repeated runs cover; run: the lines of the whole covered run."""
    later = F.struct("doc_id", "key", "pos") > F.col("first")
    at = cut(_positions(docs))
    lines = at.limit(0).select("doc_id", "key", "pos", "place", F.lit(None).cast("long").alias("reach"))
    marks = []
    for have, here in intervals(at, min_lines):
        if have == 1:  # a covered line has an earlier copy by itself
            lines = here.filter(later).select("doc_id", "key", "pos", "place", F.lit(None).cast("long").alias("reach"))
        own = here.filter(later if have >= min_lines else later & (F.col("words") >= min_words)) if have in (1, min_lines) or have > min_lines else None
        if own is not None:
            marks.append(own.select("doc_id", "key", "pos", F.lit(None).cast("int").alias("place"), (F.col("pos") + have).alias("reach")))
    # a line is covered where a run that begins at or before it ends after it: one pass over each document
    document = Window.partitionBy("doc_id", "key")
    upto = document.orderBy("pos").rangeBetween(Window.unboundedPreceding, 0)
    covered = reduce(DataFrame.unionByName, marks, lines).withColumn("end", F.max("reach").over(upto)).filter("place IS NOT NULL AND end > pos")
    island = F.col("pos") - F.row_number().over(document.orderBy("pos"))
    return covered.withColumn("island", island).select("doc_id", "key", "place", F.count("*").over(Window.partitionBy("doc_id", "key", "island")).alias("run"))


def line_dedup(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, drop_emptied: bool = False) -> DataFrame:
    """docs without the repeated lines, all columns kept, whatever they are called; drop_emptied: also without documents that lost every word."""
    gone = repeated(docs.select("doc_id", "text"), min_lines, min_words).groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("place")).alias("gone"))
    rows = docs.select(F.col("doc_id").alias("own"), F.xxhash64("text").alias("own_key"), F.col("text"), as_rows(docs).alias("row"))
    out = rows.join(gone, (F.col("own") == F.col("doc_id")) & (F.col("own_key") == F.col("key")), "left").drop("doc_id", "key")
    out = out.withColumn("listed", F.when(F.col("gone").isNotNull(), _lines(F.col("text"))))  # split once, not for each part
    # what is left between one deleted line and the next
    listed, n = F.col("listed"), F.size("gone")
    begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("gone", k - 1) + 1)
    parts = F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(listed, begin(k) + 1, F.coalesce(F.get("gone", k), F.size(listed)) - begin(k)))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(parts), "\n"))
    out = out.select(text.alias("left"), "gone", "row")
    if drop_emptied:
        out = out.filter(F.col("gone").isNull() | F.regexp_like("left", F.lit(WORD)))
    return out.select(*[F.col("left").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256): lines with a word, those deleted, and the hash of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    before = F.size(F.filter(_lines(F.col("before")), lambda x: F.regexp_like(x, F.lit(WORD))))
    after = F.size(F.filter(_lines(F.col("text")), lambda x: F.regexp_like(x, F.lit(WORD))))
    out = line_dedup(docs.withColumn("before", F.col("text")))
    out = out.select("doc_id", before.cast("long").alias("n_lines"), after.cast("long").alias("left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.col("left")).alias("n_removed"), "kept_sha256")


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
p AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS one,
             row_number() OVER (PARTITION BY line, after ORDER BY doc_id, pos) AS two FROM p),
m AS (SELECT doc_id, pos FROM r WHERE words >= 50 AND one > 1
      UNION SELECT doc_id, pos FROM r WHERE after IS NOT NULL AND two > 1
      UNION SELECT doc_id, pos + 1 FROM r WHERE after IS NOT NULL AND two > 1),
g AS (SELECT w.doc_id, w.place FROM w JOIN m USING (doc_id, pos)),
k AS (SELECT l.doc_id, string_agg(CASE WHEN g.place IS NULL THEN l.line END, chr(10) ORDER BY l.place) AS kept, count(g.place) AS n_removed
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.place = g.place GROUP BY l.doc_id)
SELECT k.doc_id, (SELECT count(*) FROM w WHERE w.doc_id = k.doc_id) AS n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k
"""
