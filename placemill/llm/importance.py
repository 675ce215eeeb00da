"""Target-distribution importance resampling: documents are drawn by how much likelier their words are in the target texts.

A text's features are all runs of 1 and 2 consecutive words (A-Z lower-cased; a word is a run of letters a-z, digits and bytes from 0x80 on),
hashed to BUCKETS by crc32.  Two Arrow passes over whole texts:

1. every partition adds its features up to one vector of BUCKETS counts with np.bincount, and treeReduce merges the vectors, for all
   documents and for all target texts; the driver gets two vectors, whatever the input's size;
2. the gains by bucket (80 kB) are broadcast, and a document's gains are summed by np.bincount with them as weights.

The weight is the floored mean of a document's gains.  With Gumbel noise from a seeded hash of the id it becomes a score, and the highest scores are a
draw without replacement, in proportion to exp(weight / 1000).  Ranks come from a distributed sort.

Defined cases: null and empty texts, and texts without a word, have no features and weight 0.  Documents of fewer than `least` words are
never drawn (rank null), nor does an empty table draw any.  Without target texts, or documents, the gains come from the smoothing alone.  Rows that
repeat an id are documents of their own with equal noise; a row without an id has the noise of the empty id and comes last among ties.
A text is hashed about 0.5 MB at a time, a longer one alone.  Columns besides id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill.llm.common import cut, mapped, ranked, table
from placemill.llm.words import Words, slices

BUCKETS = 10_000
#: Words of a document that can be drawn, at least; the share that is drawn; the seed of the noise.
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Bytes of a word up to which crc32 is worked out for all words at once.
SHORT = 48

_BLANK = np.ones(256, dtype=bool)
_BLANK[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _byte_table() -> np.ndarray:
    """What a byte does to the state of crc32."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(0xEDB88320), state >> 1).astype(np.uint32)
    return state


_BYTE = _byte_table()


def _shift_tables(most: int) -> np.ndarray:
    """[n, k, b]: what byte k of a checksum, b, becomes when n bytes follow; crc32 is linear, so the four parts are joined by xor."""
    out = np.empty((most + 1, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(most):
        out[n + 1] = _BYTE[out[n] & 0xFF] ^ (out[n] >> np.uint32(8))
    return out


_SHIFT = _shift_tables(SHORT + 1)
_SPACE = np.uint32(zlib.crc32(b" "))


def _followed(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part of the checksum of two strings that comes from the first one, of checksum crc, when the second has n bytes."""
    out = np.zeros(len(crc), dtype=np.uint32)
    for k in range(4):
        out ^= _SHIFT[n, k, (crc >> np.uint32(8 * k)) & np.uint32(0xFF)]
    return out


def checksums(w: Words) -> np.ndarray:
    """crc32 of each word of a slice."""
    lengths = w.end - w.start
    order = np.argsort(-lengths, kind="stable")
    start, sizes = w.start[order], lengths[order]
    state = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    begin = int(np.searchsorted(-sizes, -SHORT, side="left"))  # longer ones come first
    for at in range(int(sizes[begin]) if begin < len(sizes) else 0):
        here = slice(begin, int(np.searchsorted(-sizes, -at, side="left")))
        state[here] = _BYTE[(state[here] ^ w.data[start[here] + at]) & np.uint32(0xFF)] ^ (state[here] >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for k in range(begin):
        state[k] = zlib.crc32(w.data[start[k] : start[k] + sizes[k]])
    out = np.empty_like(state)
    out[order] = state
    return out


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of all features of a slice: its words, then the pairs of neighbours."""
    one = checksums(w)
    first = np.flatnonzero(w.row[1:] == w.row[:-1])
    n = (w.end - w.start)[first + 1]
    short = np.minimum(n, SHORT)
    pair = _followed(one[first], short + 1) ^ _followed(np.full(len(first), _SPACE), short) ^ one[first + 1]
    for k in np.flatnonzero(n > SHORT):
        second = w.data[w.start[first[k] + 1] : w.end[first[k] + 1]]
        pair[k] = zlib.crc32(second, zlib.crc32(b" ", int(one[first[k]])))
    return np.concatenate((one, pair)) % np.uint32(BUCKETS), np.concatenate((w.row, w.row[first]))


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts (text) fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for w in slices(batch.column(0), lower=True, blank=_BLANK):
                total += np.bincount(features(w)[0], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = mapped(texts.select("text"), count, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], dtype=np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(BUCKETS, dtype=np.int64)


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket, 1000 times the log of how much likelier it is in the target, floored; all counts are smoothed by one."""
    own, target = own.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((target + 1) * (own.sum() + BUCKETS) / ((own + 1) * (target.sum() + BUCKETS)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight), a row for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain.astype(np.float64))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value
        for batch in batches:
            words, n, total = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for w in slices(batch.column(1), lower=True, blank=_BLANK):
                here = slice(w.first, w.first + w.rows)
                bucket, row = features(w)
                words[here] = np.diff(w.bounds)
                n[here] = np.bincount(row, minlength=w.rows)
                total[here] = np.bincount(row, weights=value[bucket], minlength=w.rows).astype(np.int64)  # whole numbers below 2 ** 53
            mean = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n), pa.array(mean)], ["doc_id", "n_words", "n_features", "weight"])

    return mapped(docs.select("doc_id", "text"), weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row for each row of docs (doc_id, text); rank is null where the document isn't drawn."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weighed = weights(own, gains(bucket_counts(own), bucket_counts(target)))
    scored = cut(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    enough = scored.filter(F.col("n_words") >= least)
    drawn = enough.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("weight")]
    placed = ranked(enough, order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return placed.select(*columns).union(rest.select(*columns))


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The ids that are drawn, best first by `rank`: (doc_id, rank), for a join with the documents."""
    return resample(docs, target, **options).filter("rank IS NOT NULL").select("doc_id", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"


def crc_sql(hexed: str, table_: str = "tab") -> str:
    """DuckDB's expression for the crc32 of the bytes that the column `hexed` has as hex digits; the column `table_` has _CRC_TABLE."""
    digits = f"list_transform(range(1, len({hexed}) // 2 + 1), lambda i: ('0x' || substr({hexed}, 2 * i - 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {digits}), lambda c, b: xor({table_}[(xor(c, b) % 256) + 1], c // 256)), 4294967295)"


SQL = rf"""
WITH tab AS (SELECT {_CRC_TABLE} AS tab),
texts AS (SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS n, text FROM documents UNION ALL SELECT 'b', item_id, row_number() OVER (), text FROM benchmark),
lists AS (SELECT kind, n, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS (SELECT kind, n, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM lists),
counted AS (SELECT kind, n, feature, count(*) AS c FROM f GROUP BY ALL),
hexed AS (SELECT feature, hex(feature) AS x FROM (SELECT DISTINCT feature FROM counted)),
bucketed AS (SELECT feature, {crc_sql("x")} % 10000 AS bucket FROM hexed, tab),
placed AS (SELECT kind, n, bucket, sum(c)::DOUBLE AS c FROM counted JOIN bucketed USING (feature) GROUP BY ALL),
totals AS (SELECT coalesce(sum(c) FILTER (kind = 'd'), 0) AS s_all, coalesce(sum(c) FILTER (kind = 'b'), 0) AS t_all FROM placed),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(sum(c) FILTER (kind = 'b'), 0) + 1) * (s_all + 10000) / ((coalesce(sum(c) FILTER (kind = 'd'), 0) + 1) * (t_all + 10000)))) AS gain
         FROM placed, totals GROUP BY bucket, s_all, t_all),
mean AS (SELECT n, sum(c)::BIGINT AS n_features, floor(sum(c * gain) / sum(c))::BIGINT AS weight FROM placed JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY n),
scored AS (SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || id), 1, 8))::BIGINT + 0.5) / 4294967296))))::BIGINT AS score
           FROM lists LEFT JOIN mean USING (n) WHERE kind = 'd'),
drawn AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () * {PERCENT} // 100 AS most FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {LEAST_WORDS} AND place <= most THEN place END AS rank FROM drawn
"""
