"""Substring dedup over a log-structured fingerprint index.

A window is `WINDOW` consecutive words of one document.  Every word under a window whose words also start in a document with a
smaller id is removed; windows are judged on the input.  Batches come in order of their ids; for each one

1. its texts are kept in a table bucketed by id, so that no later step shuffles them again;
2. every window gives its fingerprint (made once, into a table), the least hash of the SUB-word runs in it (equal windows have equal fingerprints, and
   neighbours mostly share one, so a text has about a fifth as many as windows);
3. the batch's fingerprints become a run: bucketed and sorted, unique, immutable, with one text that has it and whether others do;
   runs of the past are merge-joined with it, bucket by bucket, without a shuffle;
4. windows under a fingerprint that different texts have are verified by two 64-bit hashes over all their words' 64-bit hashes (a fingerprint that one
   text of the past had alone until now adds that text's windows first), and become a run of their own, which the runs of
   historical windows are merge-joined with in the same way;
5. while there are more than FAN runs of a kind, the two smallest are compacted into one by a merge join, bucket by bucket.

Texts of a batch that are equal are looked at once: all windows of the later copies occur earlier.  Null and empty texts have no words.
Rows without an id come last: they lose nothing and no one loses by them.  Rows of one id never take from each other.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill.llm.common import mapped, shared_folder, table
from placemill.llm.words import Words, mix, slices, text_buffers
from placemill.llm.words import table as multipliers

WINDOW, SUB = 13, 5
#: What holds while a batch is added: a bucket is one file in the order of its keys, and Spark is to rely on it; and what `_arranged` sorts is not taken for superfluous.
SETTINGS = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.optimizer.plannedWrite.enabled": "false"}
#: Runs of a kind beyond which they are compacted.
FAN = 2
#: Fingerprints (8 bytes each) up to which those that need a closer look are broadcast.
BROADCAST_ROWS = 1_000_000
#: Batches that the whole table is dealt into: the third one makes runs be compacted, and the fourth reads the compacted one.
BATCHES = 4


def _fingerprints(w: Words, words: np.ndarray, window: int, sub: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, fingerprint) of the windows of a slice, from the hashes of its words."""
    last = max(len(words) - window + 1, 0)
    at = np.flatnonzero(w.row[:last] == w.row[len(words) - last :])
    low, _ = w.windows(words, sub, 7)
    span, have = window - sub + 1, 1
    while have < span:  # the least of `have` neighbours becomes that of up to twice as many
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return at, low[at]


def _changes(row: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Where a run of windows of one text with one fingerprint begins."""
    new = np.ones(len(fp), dtype=bool)
    new[1:] = (fp[1:] != fp[:-1]) | (row[1:] != row[:-1])
    return new


def _hash_at(words: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashes of the windows of `size` words that start at `at`: those of `Words.windows`, without the others."""
    out = np.zeros(len(at), dtype=np.uint64)
    for j, m in enumerate(multipliers(size, seed)):
        out += words[at + j] * m
    return mix(out)


def fingerprints(docs: DataFrame, window: int, sub: int) -> DataFrame:
    """(fp, k1), once a text, from docs (k1, text)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for w in slices(batch.column(1)):
                at, fp = _fingerprints(w, w.hashes(), window, sub)
                row = w.row[at]
                new = _changes(row, fp)  # neighbours mostly share one, so that few are left to sort
                fp, row = fp[new], row[new]
                order = np.lexsort((fp, row))
                fp, row = fp[order], row[order]
                new = _changes(row, fp)
                yield pa.RecordBatch.from_arrays([pa.array(fp[new].view(np.int64)), pa.array(keys[row[new] + w.first], pa.int64())], ["fp", "k1"])

    return mapped(docs.select("k1", "text"), emit, "fp long, k1 long")


def windows(docs: DataFrame, window: int, sub: int) -> DataFrame:
    """(h1, h2, doc_id, k1, pos) of the windows whose fingerprint is in fps, from docs (doc_id, k1, text, fps)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            lists = batch.column(3)
            values, at_list = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            for w in slices(batch.column(2)):
                words = w.hashes()
                at, fp = _fingerprints(w, words, window, sub)
                row = w.row[at] + w.first
                new = _changes(row, fp)
                begin = np.flatnonzero(new)
                # a fingerprint in one text's list is in those of all texts here that have it, so the lists are looked up together
                kept = np.isin(fp[begin], values[at_list[w.first] : at_list[w.first + w.rows]])
                kept = np.repeat(kept, np.diff(np.append(begin, len(at))))
                row, at = row[kept], at[kept]
                pos = at - w.bounds[row - w.first]
                h1, h2 = _hash_at(words, at, window, 3), _hash_at(words, at, window, 5)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids[row], pa.int64()), pa.array(keys[row], pa.int64()), pa.array(pos.astype(np.int64))],
                    ["h1", "h2", "doc_id", "k1", "pos"],
                )

    return mapped(docs.select("doc_id", "k1", "text", "fps"), emit, "h1 long, h2 long, doc_id long, k1 long, pos long")


def stripped(docs: DataFrame, window: int, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) from docs (doc_id, text, starts, copy); with_text: and the kept words as text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            raw, ends = text_buffers(batch.column(1))
            for k, (doc_id, starts, copy) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True)):
                words = raw[ends[k] : ends[k + 1]].tobytes().split()  # at these six bytes
                n, kept = len(words), words
                if copy and n >= window:
                    kept = []
                elif starts.values is not None and len(starts.values):
                    gone = np.zeros(n + 1, dtype=np.int64)
                    at = np.unique(starts.values.to_numpy())
                    gone[at] += 1
                    gone[np.minimum(at + window, n)] -= 1
                    kept = list(compress(words, (np.cumsum(gone)[:n] == 0).tolist()))
                joined = b" ".join(kept)
                for column, value in zip(out, (doc_id, n, n - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None), strict=True):
                    column.append(value)
            kinds, names = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
            m = 4 + with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:m], kinds, strict=False)], names[:m])

    return mapped(docs.select("doc_id", "text", "starts", "copy"), emit, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else ""))


class FingerprintIndex:
    """Bucketed tables: fingerprints (fp, owner, shared), windows (h1, h2, first), texts (doc_id, k1, k2, text) and which id stands for a text.

    The runs live in the warehouse under the index's name; `save` writes the list of them to a folder, and `load` opens them again, also from
    another application.  Batches have to come in the order of their ids, since what was returned for a batch can't be changed by a later one
    with smaller ids; a batch with an id that isn't larger than all before is refused.
    """

    KEYS = {"fp": ["fp"], "window": ["h1", "h2"], "texts": ["doc_id", "k1"], "reps": ["k1"]}
    COLUMNS = {"fp": "fp long, owner long, shared boolean", "window": "h1 long, h2 long, first long", "texts": "doc_id long, text string, k1 long, k2 long", "reps": "k1 long, doc_id long"}

    def __init__(self, spark: SparkSession, window: int = WINDOW, sub: int = SUB, fan: int = FAN):
        self.spark, self.window, self.sub, self.fan = spark, window, sub, fan
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.written, self.last = f"fingerprints_{uuid.uuid4().hex}", 0, None
        self.runs: dict[str, list[str]] = {k: [] for k in self.COLUMNS}
        self.weight: dict[str, int] = {}  # batches of a run
        self.temporary: list[str] = []

    def save(self, path: str) -> None:
        """Writes the list of runs, one JSON line, to the folder `path`."""
        folder = self.spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        state = {k: getattr(self, k) for k in ("window", "sub", "fan", "buckets", "name", "written", "last", "runs", "weight")} | {"folder": folder}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index that `save` wrote; tables that this session's catalog doesn't know are registered where they lie."""
        state = json.loads(spark.read.text(path).first()[0])
        index = cls(spark, state["window"], state["sub"], state["fan"])
        for k in ("buckets", "name", "written", "last", "runs", "weight"):
            setattr(index, k, state[k])
        for kind, names in index.runs.items():
            keys = ", ".join(cls.KEYS[kind])
            for name in names:
                if not spark.catalog.tableExists(name):
                    spark.sql(f"CREATE TABLE {name} ({cls.COLUMNS[kind]}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {index.buckets} BUCKETS LOCATION '{state['folder']}/{name}'")
        return index

    def _store(self, df: DataFrame, kind: str) -> str:
        """df as an immutable bucketed table; what is grouped by the kind's keys already is not shuffled again."""
        name = f"{self.name}_{kind}_{self.written}"
        self.written += 1
        keys = self.KEYS.get(kind)
        if kind not in self.runs:
            self.temporary.append(name)
        writer = df.write.format("parquet")
        # hashes neither repeat nor compress
        writer = writer.option("compression", "zstd") if kind == "texts" else writer.option("compression", "snappy").option("parquet.enable.dictionary", "false")
        (writer.bucketBy(self.buckets, *keys).sortBy(*keys) if keys else writer).saveAsTable(name)
        return name

    def _arranged(self, df: DataFrame, kind: str) -> DataFrame:
        """df in the order in which `_store` writes it, by one number that Spark sorts without comparing rows: the bucket, and below it the upper bits of the first key.

        Spark's own sort for a bucketed table compares whole rows, hashing both anew, unless they come in order; then it only passes over them once.
        """
        keys, bits = self.KEYS[kind], self.buckets.bit_length()
        bucket = F.pmod(F.hash(*keys), F.lit(self.buckets)).cast("long")
        return df.sortWithinPartitions(F.shiftleft(bucket, 63 - bits) + F.shiftright(F.col(keys[0]), bits + 1) + F.lit(1 << 62 - bits))

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name} PURGE")

    def _free(self, *names: str) -> None:
        """Drops temporary tables that no later step reads."""
        self._drop(*names)
        self.temporary = [n for n in self.temporary if n not in names]
        self.spark.sparkContext._jvm.System.gc()  # shuffle files of finished steps go only when the driver collects its garbage

    def _tidy(self) -> None:
        self._free(*self.temporary)

    def close(self) -> None:
        """Drops the index."""
        for kind, names in self.runs.items():
            self._drop(*names)
            self.runs[kind] = []
        self._tidy()

    def _append(self, kind: str, name: str) -> None:
        """One run more of a kind; while there are more than `fan`, the two of the fewest batches are merged into one."""
        self.runs[kind].append(name)
        self.weight[name] = 1
        while kind in ("fp", "window") and len(self.runs[kind]) > self.fan:
            pair = sorted(self.runs[kind], key=lambda n: self.weight[n])[:2]
            left, right = (self.spark.table(n) for n in pair)
            keys, a, b = self.KEYS[kind], left.alias("a"), right.alias("b")
            # bucket by bucket, without a shuffle: each bucket's rows stay in it
            merged = a.join(b, keys, "full")
            if kind == "fp":
                both = F.col("a.owner").isNotNull() & F.col("b.owner").isNotNull()
                merged = merged.select("fp", F.least("a.owner", "b.owner").alias("owner"), (both | F.coalesce("a.shared", F.lit(False)) | F.coalesce("b.shared", F.lit(False))).alias("shared"))
            else:
                merged = merged.select("h1", "h2", F.least("a.first", "b.first").alias("first"))
            new = self._store(merged, kind)
            self.weight[new] = sum(self.weight.pop(n) for n in pair)
            self.runs[kind] = [n for n in self.runs[kind] if n not in pair] + [new]
            self._drop(*pair)

    def _gathered(self, pairs: DataFrame) -> DataFrame:
        """(k1, fps) from pairs (fp, k1), once each.  A text has few rows in a bucket, so nothing is combined before the shuffle, and no text has more than its own windows."""
        return pairs.repartition(self.buckets, "k1").groupBy("k1").agg(F.collect_list("fp").alias("fps"))

    @staticmethod
    def _union(frames: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, frames)

    def add(self, docs: DataFrame, with_text: bool = False) -> DataFrame:
        """What is left of docs (doc_id, text), whose ids are all larger than those added before."""
        before = {k: self.spark.conf.get(k) for k in SETTINGS}
        try:
            for k, v in SETTINGS.items():
                self.spark.conf.set(k, v)
            return self._added(docs, with_text)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
            self._tidy()

    def _added(self, docs: DataFrame, with_text: bool) -> DataFrame:
        spark = self.spark
        past = {k: [spark.table(n) for n in v] for k, v in self.runs.items()}
        keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        keyed = keyed.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit("other"), F.col("text")))
        span = keyed.agg(F.min("doc_id"), F.max("doc_id")).first()
        if self.last is not None and span[0] is not None and span[0] <= self.last:
            raise ValueError(f"id {span[0]} is not larger than {self.last}, which the index has already")
        new = {"texts": self._store(keyed.repartition(self.buckets, "doc_id", "k1"), "texts")}
        try:
            out = self._indexed(new, past, with_text)
        except BaseException:
            self._drop(*new.values())
            raise
        self._tidy()  # before runs are compacted, which needs room for both
        for kind in ("texts", "reps", "fp", "window"):
            self._append(kind, new[kind])
        self.last = self.last if span[1] is None else span[1]
        return out

    def _indexed(self, new: dict[str, str], past: dict[str, list[DataFrame]], with_text: bool) -> DataFrame:
        """Writes the runs of a batch whose texts are stored, into `new`, and returns what is left of the texts."""
        spark = self.spark
        texts = spark.table(new["texts"])
        known = texts.filter("doc_id IS NOT NULL")
        first = spark.table(self._store(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "grouped"))
        new["reps"] = self._store(first.select("k1", F.col("rep").alias("doc_id")), "reps")
        reps = spark.table(new["reps"])
        copies = known.select("doc_id", "k1", "k2").join(first.filter("n > 1"), ["k1", "k2"]).filter("rep < doc_id").select("doc_id", "k1").distinct()

        # fingerprints are made once; owners are combined before the shuffle, so one that all texts have is a row a task
        made = self._store(fingerprints(known, self.window, self.sub), "rows")
        rows = spark.table(made)
        owners = rows.groupBy("fp").agg(F.min("k1").alias("owner"), F.max("k1").alias("_last"))
        new["fp"] = self._store(self._arranged(owners.select("fp", "owner", (F.col("owner") != F.col("_last")).alias("shared")), "fp"), "fp")
        # the runs of the past are merge-joined with the batch's run one after the other: every side is in buckets and sorted, so nothing is shuffled
        looked, n = spark.table(new["fp"]).select("fp", "shared"), len(past["fp"])
        for i, run in enumerate(past["fp"]):
            looked = looked.join(run.select("fp", F.col("owner").alias(f"owner_{i}"), F.col("shared").alias(f"shared_{i}")), "fp", "left")
        had = sum((F.col(f"owner_{i}").isNotNull().cast("int") for i in range(n)), F.lit(0))
        several = reduce(Column.__or__, [F.coalesce(f"shared_{i}", F.lit(False)) for i in range(n)], had > 1)
        alone = F.when((had == 1) & ~several, F.coalesce(F.lit(None).cast("long"), *[f"owner_{i}" for i in range(n)]))
        looked = spark.table(self._store(looked.filter(F.col("shared") | (had > 0)).select("fp", alone.alias("alone")), "looked"))
        # where they are too many to broadcast, this is a join of two plain tables, which Spark can split at a fingerprint of very many texts
        near = F.broadcast if looked.count() <= BROADCAST_ROWS else lambda df: df
        wanted = self._gathered(rows.join(near(looked.select("fp")), "fp", "left_semi").distinct())
        at = spark.table(self._store(windows(known.join(wanted.join(reps, "k1"), ["doc_id", "k1"]), self.window, self.sub), "at"))
        self._free(made)

        sides = at.select("h1", "h2", F.col("doc_id").alias("first"))
        if n:
            # fingerprints that only one text of the past had: its windows under them are not in the index yet
            owners = self._gathered(looked.filter("alone IS NOT NULL").select("fp", F.col("alone").alias("k1")))
            placed = [owners.join(r, "k1") for r in past["reps"]]
            added = [windows(t.join(o, ["doc_id", "k1"]), self.window, self.sub) for t, o in zip(past["texts"], placed, strict=True)]
            sides = self._union([sides, *[a.select("h1", "h2", F.col("doc_id").alias("first")) for a in added]])
        new["window"] = self._store(self._arranged(sides.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.count("*").alias("n")), "window"), "window")
        seen, least = spark.table(new["window"]), [F.col("first")]
        for i, run in enumerate(past["window"]):
            seen = seen.join(run.select("h1", "h2", F.col("first").alias(f"first_{i}")), ["h1", "h2"], "left")
            least.append(F.col(f"first_{i}"))
        twice = reduce(Column.__or__, [f.isNotNull() for f in least[1:]], F.col("n") > 1)
        # stored, so that the join below is one that Spark can split
        firsts = spark.table(self._store(seen.filter(twice).select("h1", "h2", F.array_min(F.array(*least)).alias("first")), "firsts"))
        late = at.join(firsts, ["h1", "h2"]).filter("first < doc_id")
        starts = late.groupBy("doc_id", "k1").agg(F.collect_set("pos").alias("starts"))
        marks = starts.withColumn("copy", F.lit(False)).unionByName(copies.withColumns({"starts": F.lit(None).cast("array<bigint>"), "copy": F.lit(True)}))
        left = stripped(texts.join(marks, ["doc_id", "k1"], "left"), self.window, with_text)
        path = f"{shared_folder(spark)}/{self.name}_left_{self.written}"
        left.write.parquet(path)
        return spark.read.parquet(path)


def substring_dedup(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, sub: int = SUB, with_text: bool = False, fan: int = FAN) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), a row for each row of docs, which are added in `batches` ranges of ids."""
    index = FingerprintIndex(docs.sparkSession, window, sub, fan)
    ids = docs.select(F.col("doc_id").cast("double").alias("doc_id"))
    cuts = sorted(set(ids.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    out, below = [], F.lit(False)
    try:
        for k in range(len(cuts) + 1):
            inside = ~below if k == len(cuts) else ~below & (F.col("doc_id") <= cuts[k])
            out.append(index.add(docs.filter(F.coalesce(inside, F.lit(k == len(cuts)))), with_text))
            if k < len(cuts):
                below = F.coalesce(F.col("doc_id") <= cuts[k], F.lit(False))
    finally:
        index.close()
    return reduce(DataFrame.unionByName, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


SQL = None
