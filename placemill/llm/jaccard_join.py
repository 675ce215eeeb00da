"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

A document's set is its distinct shingles of SHINGLE words (A-Z lower-cased); with fewer words, the whole sequence.  Two link when
100 * intersection >= PERCENT * union.  Documents without words link with nothing.

1. Documents with equal word sequences are one class from here on; its smallest id stands for it.
2. Shingles have one global order: frequent ones last, then by hash.  Two sets that link share, for any l, at least l of the first
   n - ceil(PERCENT n / 100) + l shingles of both.  Each document picks its own l: its prefix grows while the estimated number of
   candidates under its frequent shingles is large, and a pair has to share as many as the lesser of its two l.
3. A round of cheap links (each set against one hub per shingle, for the few of the least hashes) contracts families of near copies, so
   the join proper only emits pairs of different families, never all pairs of a group.  The lists of frequent shingles are dealt
   out in blocks of pairs of buckets.
4. Candidates that the sizes, the places of their shared shingles or the histograms of their hashes rule out are dropped (all three
   are bounds, not estimates), under a frequent shingle before the pair is made; the rest is verified on the texts' shingles.

Rows that repeat an id are one document, that of the least text.  Null and empty texts have no words; rows without an id link with nothing.

The number of frequent shingles that the executors get is bounded (FREQUENT); which ones they are only decides the order, and so the
speed.  How lists are dealt out follows from their true lengths, so no list is one task's, whether its shingle was found frequent or not.
Hashes are of 64 bits a shingle, built from 64-bit hashes of its words.  Columns besides doc_id and text are not read, or carried along whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill.llm.common import Store, as_rows, components, cut, cut_few, mapped, table, tidy
from placemill.llm.words import mix, slices

SHINGLE, PERCENT = 4, 85
#: Frequent shingles that are put last: those in at least MANY documents, the most frequent ones, no more than FREQUENT.
MANY, FREQUENT = 16, 400_000
#: Documents under a shingle that one task compares with one another; longer lists, by their true lengths, are dealt out.
BLOCK = 2000
#: Rows of a table of shingles (a hash, a number, a flag: under 100 bytes each) up to which it is broadcast.
BROADCAST_ROWS = 500_000
#: Candidates under a document's frequent shingles that make its l one larger, and the largest l.
COST, LONGEST = 200, 6
#: Bins of the histogram of a set's hashes.
BINS = 128
#: Shingles of a set, those of the least hashes, for which it is compared with a hub.
HUBS = 4

#: Pairs of one document beyond which its text is dealt to several tasks.
HOT = 1000

DOC_SCHEMA = "doc_id long, h1 long, h2 long, n_shingles long"


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, int, int]]:
    """(row, sorted distinct shingle hashes, two hashes of the word sequence) of each text."""
    for w in slices(column, lower=True):
        words = w.hashes()
        grams, whole = w.windows(words, size, 11)
        at = np.flatnonzero(whole)
        row = w.row[at]
        order = np.lexsort((grams[at], row))
        values, row = grams[at][order], row[order]
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
        values, row = values[new], row[new]
        ends = np.searchsorted(row, np.arange(w.rows + 1))
        place = np.arange(len(words), dtype=np.uint64) - w.bounds[w.row].astype(np.uint64)
        zero = np.zeros(1, dtype=np.uint64)
        c1, c2 = (np.concatenate((zero, np.cumsum(mix(words ^ mix(place * np.uint64(2) + np.uint64(k)))))) for k in (1, 2_000_003))
        for k in range(w.rows):
            a, b = w.bounds[k], w.bounds[k + 1]
            s1, s2 = ((int(c[b]) - int(c[a])) % 2**64 for c in (c1, c2))
            if b - a == 0:
                found = np.zeros(0, dtype=np.uint64)
            elif b - a < size:
                found = np.array([s1], dtype=np.uint64)
            else:
                found = values[ends[k] : ends[k + 1]]
            yield w.first + k, found, s1, s2


def _need(n: int, percent: int) -> int:
    """The least overlap of a set of n with a set that links with it."""
    return -(-percent * n // 100)


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.uint64).view(np.int64))


def frequent(docs: DataFrame, size: int) -> DataFrame:
    """(t, df): shingles of many documents, with an estimate of how many, from all shingles of all documents.

    A task leaves out what it sees once among some 1.5 million, so the estimate is low for what is rare; it only orders shingles.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([_signed(values[n > 1]), pa.array(n[n > 1])], ["t", "n"])

        total = 0
        for batch in batches:
            for _, s, _, _ in _sets(batch.column(0), size):
                held.append(s)
                total += len(s)
            if total > 1_500_000:
                yield out()
                held, total = [], 0
        if held:
            yield out()

    seen = mapped(docs.select("text"), count, "t long, n long")
    return seen.groupBy("t").agg(F.sum("n").alias("df")).filter(F.col("df") >= MANY).orderBy(F.desc("df"), "t").limit(FREQUENT)


def hashes(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, h1, h2, n_shingles) of docs (doc_id, text)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(s1, s2, len(s)) for _, s, s1, s2 in _sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _signed([x[0] for x in out]), _signed([x[1] for x in out]), pa.array([x[2] for x in out], pa.int64())], ["doc_id", "h1", "h2", "n_shingles"])

    return mapped(docs.select("doc_id", "text"), emit, DOC_SCHEMA)


def _histogram(s: np.ndarray, bins: int = BINS) -> bytes:
    """How many hashes fall into each bin; 255 stands for as many or more."""
    return np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) % bins, minlength=bins), 255).astype(np.uint8).tobytes()


def _most_shared(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlaps of sets with histograms x and y (rows); n where two bins are too full to tell."""
    least = np.minimum(x, y)
    return np.where((least == 255).any(axis=-1), n, least.sum(axis=-1, dtype=np.int64))


def prefixes(docs: DataFrame, often: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, l, prefix, bins, heads) of docs (doc_id, text); heads: the HUBS least hashes, whatever their frequency."""
    found = often.toPandas()  # no more than FREQUENT rows
    t, n = found["t"].to_numpy(dtype=np.int64).view(np.uint64), found["df"].to_numpy(dtype=np.int64)
    last = docs.sparkSession.sparkContext.broadcast((t[np.argsort(t)], n[np.argsort(t)]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, df = last.value
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), [[] for _ in range(6)]
            for row, s, _, _ in _sets(batch.column(1), size):
                n, length = len(s), 1
                order, cost = s, None
                if n and len(heavy):
                    at = np.searchsorted(heavy, s)
                    is_heavy = heavy[np.minimum(at, len(heavy) - 1)] == s
                    if is_heavy.any():
                        order = np.concatenate((s[~is_heavy], s[is_heavy]))
                        cost = np.concatenate((np.zeros(n - int(is_heavy.sum()), dtype=np.int64), df[at[is_heavy]]))
                base = n - _need(n, percent)
                if cost is not None:  # longer prefixes for those with many candidates
                    length = int(min(LONGEST, n, 1 + cost[: base + 1].sum() // COST))
                for c, v in zip(out, (ids[row], n, length, order[: min(n, base + length)].view(np.int64), _histogram(s), s[:HUBS].view(np.int64)), strict=True):
                    c.append(v)
                if len(out[0]) >= 2000:
                    yield record(out)
                    out = [[] for _ in range(6)]
            if out[0]:
                yield record(out)

    def record(out: list[list]) -> pa.RecordBatch:
        prefix, heads = (
            pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in c]))).astype(np.int32), np.concatenate([*c, np.zeros(0, dtype=np.int64)]).astype(np.int64)) for c in (out[3], out[5])
        )
        arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), prefix, pa.array(out[4], pa.binary()), heads]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "l", "prefix", "bins", "heads"])

    return mapped(docs.select("doc_id", "text"), emit, "doc_id long, n_shingles long, l int, prefix array<long>, bins binary, heads array<long>")


def _blocked(entries: DataFrame, often: DataFrame) -> DataFrame:
    """entries with the block of buckets (ba, bb) that they meet in; a shingle of more than BLOCK entries has them dealt to as many buckets as its list has blocks."""
    long_lists = cut_few(entries.groupBy("t").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("t", F.ceil(F.col("n") / BLOCK).cast("int").alias("n")))
    heavy = often.select("t").withColumn("often", F.lit(True)).join(long_lists, "t", "full")
    if heavy.count() <= BROADCAST_ROWS:
        heavy = F.broadcast(heavy)
    dealt = entries.join(heavy, "t", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("bucket", F.pmod(F.xxhash64("doc"), F.col("n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    bins = F.when(F.col("often") | (F.col("n") > 1), F.col("bins")).alias("bins")  # only these shingles have long lists
    return dealt.withColumn("other", other).select("t", F.least("bucket", "other").alias("ba"), F.greatest("bucket", "other").alias("bb"), "doc", "n_doc", "pos", "l", "family", "bucket", bins)


def _pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b) candidate pairs with how often they met, from entries that are dealt out and sorted by (t, ba, bb, n_doc)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def lists(frame: pa.Table) -> Iterator[pa.RecordBatch]:
            t, ba, bb, doc, n, pos, l, family, bucket = (frame.column(k).to_numpy() for k in range(9))
            key_new = np.concatenate(([True], (t[1:] != t[:-1]) | (ba[1:] != ba[:-1]) | (bb[1:] != bb[:-1])))
            begin = np.flatnonzero(key_new)
            end = np.append(begin[1:], len(t))
            out_a, out_b, out_l = [], [], []
            size, bins = 0, frame.column(9)
            for i, j in zip(begin, end, strict=True):
                if j - i < 2 or (family[i:j] == family[i]).all():
                    continue
                nn, rest = n[i:j], n[i:j] - pos[i:j]
                shape = np.frombuffer(b"".join(bins.slice(i, j - i).to_pylist()), dtype=np.uint8).reshape(j - i, -1) if bins[i].is_valid else None
                for x in range(j - i - 1):  # sizes ascend: partners from x on, up to the size that can still link
                    to = int(np.searchsorted(nn, 100 * nn[x] // percent, side="right"))
                    if to <= x + 1:
                        continue
                    y = slice(x + 1, to)
                    need = -(-percent * (nn[x] + nn[y]) // (100 + percent))
                    both = np.minimum(l[i + x], l[i + x + 1 : i + to])
                    ok = (family[i + x + 1 : i + to] != family[i + x]) & (both - 1 + np.minimum(rest[x], rest[y]) >= need)
                    if ba[i] != bb[i]:
                        ok &= bucket[i + x + 1 : i + to] != bucket[i + x]
                    # both prefixes reach this shingle at the lesser of the two l
                    ok &= (pos[i + x] < nn[x] - -(-percent * nn[x] // 100) + both) & (pos[i + x + 1 : i + to] < nn[y] - -(-percent * nn[y] // 100) + both)
                    hit = np.flatnonzero(ok)
                    if len(hit) and shape is not None:
                        hit = hit[_most_shared(shape[x], shape[x + 1 + hit], nn[x]) >= need[hit]]
                    if len(hit):
                        other = doc[i + x + 1 + hit]
                        out_a.append(np.minimum(other, doc[i + x]))
                        out_b.append(np.maximum(other, doc[i + x]))
                        out_l.append(np.minimum(both[hit], np.minimum(nn[x], nn[y][hit])))
                        size += len(hit)
                if size > 100_000:
                    yield record(out_a, out_b, out_l)
                    out_a, out_b, out_l, size = [], [], [], 0
            if out_a:
                yield record(out_a, out_b, out_l)

        def record(a: list, b: list, least: list) -> pa.RecordBatch:
            keys, n = np.unique(np.stack((np.concatenate(a), np.concatenate(b), np.concatenate(least).astype(np.int64))), axis=1, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array(keys[2]), pa.array(n)], ["a", "b", "least", "met"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            whole = pa.Table.from_batches(held).combine_chunks()
            # all but the last list are complete
            t, ba, bb = (whole.column(k).to_numpy() for k in range(3))
            same = (t == t[-1]) & (ba == ba[-1]) & (bb == bb[-1])
            last = int(np.argmax(same))
            if last:
                yield from lists(whole.slice(0, last))
                whole = whole.slice(last)
            held = whole.to_batches()
        if held:
            yield from lists(pa.Table.from_batches(held).combine_chunks())

    met = mapped(entries, meet, "a long, b long, least long, met long")
    return met.groupBy("a", "b").agg(F.max("least").alias("least"), F.sum("met").alias("met")).filter("met >= least").select("a", "b")


def _possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and histograms leave room for a link."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            m, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 5))
            most = np.minimum(_most_shared(x, y, np.minimum(m, n)), np.minimum(m, n))
            keep = pa.array(100 * most >= percent * (m + n - most))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    own = reps.select("doc_id", "bins", "n_shingles")
    both = pairs.join(own.toDF("a", "bins_a", "n_a"), "a").join(own.toDF("b", "bins_b", "n_b"), "b")
    return mapped(both.select("a", "b", "bins_a", "bins_b", "n_a", "n_b"), bound, "a long, b long")


def _with_text(pairs: DataFrame, key: str, texts: DataFrame) -> DataFrame:
    """pairs with the text of their `key`; a document of very many pairs is dealt with them to several tasks."""
    named = texts.select(F.col("doc_id").alias(key), F.col("text").alias(f"text_{key}"))
    hot = cut_few(pairs.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select(key, F.ceil(F.col("n") / HOT).cast("int").alias("salts")))
    if hot.isEmpty():
        return pairs.join(named, key)
    salted = pairs.join(hot, key).withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.col("salts")).cast("int")).drop("salts")
    copies = named.join(hot, key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    spread = salted.join(copies, [key, "salt"]).drop("salt")
    return pairs.join(hot.select(key), key, "left_anti").join(named, key).unionByName(spread)


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, from the documents' texts."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = {r: s for r, s, _, _ in _sets(batch.column(2), size)}
            keep = np.zeros(batch.num_rows, dtype=bool)
            for r, s, _, _ in _sets(batch.column(3), size):
                o = left[r]
                both = len(np.intersect1d(o, s, assume_unique=True))
                keep[r] = 100 * both >= percent * (len(o) + len(s) - both) and both > 0
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    both = _with_text(_with_text(pairs, "a", texts), "b", texts)
    return mapped(both.select("a", "b", "text_a", "text_b"), verify, "a long, b long")


def links(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their hashes, classes, links between classes) of docs (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    often = cut(frequent(rows, size))
    n = docs.count()
    all_docs = cut(hashes(rows, size), n, dear=True)
    classes = cut(all_docs.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), n)
    with Store(spark, "jaccard") as store:
        own = rows.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        texts = store.put(own, "doc_id")
        tidy(spark)
        reps = store.put(prefixes(texts, often, size, percent), "doc_id")

        # families: each set against the smallest document under each of its first shingles
        heads = reps.select(F.col("doc_id").alias("doc"), F.explode("heads").alias("t"))
        hubs = store.put(heads.groupBy("t").agg(F.min("doc").alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n"))  # stored, so that Spark can split the join
        near = heads.join(hubs, "t").filter("doc > hub").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct()
        near = cut(_verified(cut(_possible(near, reps, percent), HUBS * n, dear=True), texts, size, percent), HUBS * n, dear=True)
        family = near.groupBy(F.col("b").alias("doc")).agg(F.min("a").alias("one"))
        up = family.join(family.toDF("one", "two"), "one", "left").select("doc", F.coalesce("two", "one").alias("family"))
        up = up.union(near.select(F.col("a").alias("doc"), F.col("a").alias("family")).distinct()).groupBy("doc").agg(F.min("family").alias("family"))

        # the join proper, between families
        named = reps.join(up.withColumnRenamed("doc", "doc_id"), "doc_id", "left").withColumn("family", F.coalesce("family", "doc_id"))
        entries = named.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n_doc"), F.col("l").cast("long").alias("l"), "family", "bins", F.posexplode("prefix").alias("pos", "t"))
        dealt = _blocked(entries, often)
        key = ["t", "ba", "bb"]
        met = _pairs(dealt.withColumn("pos", F.col("pos").cast("long")).repartition(*key).sortWithinPartitions(*key, "n_doc"), percent)
        possible = cut(_possible(met, reps, percent))
        linked = cut(near.union(_verified(possible, texts, size, percent)).distinct(), HUBS * n + possible.count(), dear=True)
    tidy(spark)
    return all_docs, classes, linked


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs."""
    rows, classes, linked = links(docs, size, percent)
    named = classes.join(components(linked), F.col("rep") == F.col("id"), "left")
    named = named.select("h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    full = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").join(named, ["h1", "h2"])
    rest = rows.filter("n_shingles = 0 OR doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    return full.select(*columns).union(rest.select(*columns))


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with only the smallest id of each component, all columns kept, whatever they are called; rows without an id stay."""
    lost = jaccard_components(docs, size, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("lost")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("own"), as_rows(docs).alias("row"))
    return rows.join(lost, F.col("own") == F.col("lost"), "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = None
