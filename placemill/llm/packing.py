"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

A document is its token ids and one closing id; only one that is longer than the capacity is cut, into pieces of the
capacity (the last may be shorter).  Pieces are dealt by a hash of their place to shards of about SHARD pieces, and each shard is packed by itself:
a sequence is filled greedily with the largest piece that fits; then its smallest piece is replaced by two unpacked pieces that
fill the gap it leaves more tightly, as long as that helps.  A shard leaves at most a few sequences unfilled, so shards cost
less than one sequence in some thousands, and no task sees more than its shard.

Null and empty texts are the closing id alone.  Repeated rows are packed one by one; a null id stays null.  An empty table packs
into nothing.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill.llm.common import cut, mapped, table

CAPACITY = 2048
#: Pieces that one task packs.
SHARD = 16_384
#: Words, and the vocabulary's matches in them, whose ids a worker remembers in each of two generations: up to about 0.4 GB a worker where all words differ.
WORDS, PARTS = 300_000, 800_000
#: Characters up to which a word is remembered.
SHORT = 32

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    The vocabulary's pattern never matches white space, so a text's ids are those of its words one after the other, and a word's
    ids are those of the pattern's matches in it.  Distinct words are looked up; words with characters outside Latin, where
    normalising may need more than lower-casing, go to the library whole.
    """

    LATIN = re.compile(r"[\x21-\x7e¡-±´-¸º»¿-įı-ſ]+")
    #: For words of LATIN, what the vocabulary's pattern matches.
    MATCH = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
    #: Python splits at these, the vocabulary's pattern doesn't.
    ODD = re.compile(r"[\x1c-\x1f]")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has its own core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        # what is full becomes the old generation, from which what is met again is taken over
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        split, whole, match = {}, [], self.MATCH.findall
        for w in new:
            if "<|" not in w and self.LATIN.fullmatch(w):
                split[w] = match(w.lower())
            else:
                whole.append(w)
        parts, needed = self.parts, {p for ps in split.values() for p in ps}
        if missing := needed.difference(parts):
            if len(parts) + len(missing) > PARTS:
                self.old_parts, self.parts = parts, {p: parts[p] for p in needed if p in parts}
                parts = self.parts
            again = {p: self.old_parts[p] for p in missing if p in self.old_parts}
            parts.update(again)
            missing = list(missing.difference(again))
            parts.update(zip(missing, self._library(missing), strict=True))
        found = {w: b"".join([parts[p] for p in ps]) for w, ps in split.items()}
        if whole:
            found.update(zip(whole, self._library(whole), strict=True))
        for p in missing:
            if len(p) > SHORT:  # used once, not remembered
                parts.pop(p, None)
        return found

    def ids(self, text: str) -> bytes:
        if self.ODD.search(text):
            return self._library([text])[0]
        listed, words = text.split(), self.words
        new = set(listed).difference(words)
        if not new:
            return b"".join(map(words.__getitem__, listed))
        found = {w: self.old_words[w] for w in new if w in self.old_words}
        if len(new) > len(found):
            found.update(self._learn(new.difference(found)))
        if len(words) + len(found) > WORDS:
            found.update((w, words[w]) for w in set(listed) if w in words)
            self.old_words, self.words = words, {w: v for w, v in found.items() if len(w) <= SHORT} if len(found) <= WORDS else {}
            return b"".join(map(found.__getitem__, listed))
        words.update(found)
        out = b"".join(map(words.__getitem__, listed))
        for w in found:
            if len(w) > SHORT:
                del words[w]
        return out


    def forget(self) -> None:
        """Forgets all words: an idle worker needs none, and most words of a partition are in no other."""
        self.words, self.parts, self.old_words, self.old_parts = {}, {}, {}, {}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, capacity: int = CAPACITY, closing: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, frugal: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all documents; with_ids: and ids, the piece's ids as bytes.

    frugal: workers forget the words of a partition when it ends, for jobs whose other stages need the memory; it takes some tenths more time.
    """
    path = path or vocabulary_path()
    end = np.asarray([closing], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = e.ids(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=False)], names)
        if frugal:
            e.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return mapped(rows, encode, PIECE_SCHEMA + (", ids binary" if with_ids else ""))


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length; all are from 1 to the capacity."""
    order = np.argsort(lengths, kind="stable")
    sorted_lengths = lengths[order]
    first = np.searchsorted(sorted_lengths, np.arange(capacity + 2))
    left = np.diff(first).tolist()  # unpacked pieces by length
    there = rev = 0  # bit k: there is an unpacked piece of length k, or of length capacity - k
    for k, n in enumerate(left):
        if n:
            there |= 1 << k
            rev |= 1 << (capacity - k)
    upto = [(1 << (k + 1)) - 1 for k in range(capacity + 1)]

    def take(k: int) -> None:
        nonlocal there, rev
        left[k] -= 1
        if not left[k]:
            there &= ~(1 << k)
            rev &= ~(1 << (capacity - k))

    def put(k: int) -> None:
        nonlocal there, rev
        left[k] += 1
        there |= 1 << k
        rev |= 1 << (capacity - k)

    def two(most: int, least: int) -> tuple[int, int] | None:
        """Two unpacked pieces of the largest sum from least to most."""
        for total in range(most, least - 1, -1):
            found = there & (rev >> (capacity - total)) & upto[total]
            while found:
                a = found.bit_length() - 1
                b = total - a
                if b > 0 and (a != b or left[a] > 1):
                    return a, b
                found &= ~(1 << a)
        return None

    used = first[:-1].tolist()  # the next piece of each length, in sorted order
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    number = 0
    while there:
        room, held = capacity, []
        while room and (fits := there & upto[room]):
            k = fits.bit_length() - 1
            take(k)
            held.append(k)
            room -= k
        while room and (pair := two(held[-1] + room, held[-1] + 1)):
            put(smallest := held.pop())
            for k in pair:
                take(k)
            held += pair
            held.sort(reverse=True)
            room += smallest - sum(pair)
        at = 0
        for k in held:
            row = order[used[k]]
            used[k] += 1
            sequence[row], offset[row] = number, at
            at += k
        number += 1
    return sequence, offset


def pack(rows: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """rows (of `pieces`, or any with a length from 1 to the capacity) with sequence_id and offset."""
    rows = cut(rows)
    shards = max(1, -(-rows.count() // shard))
    kept = [c for c in rows.columns if c not in ("_shard", "sequence_id", "offset")]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*kept).dtypes) + ", sequence_id long, offset long"

    def packed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = best_two_fit(frame["length"].to_numpy(), capacity)
        return frame.drop(columns="_shard").assign(sequence_id=sequence + (int(key[0]) << 40), offset=offset)

    # by the place in the checkpoint, which stays as it is: equal rows are dealt out too
    dealt = rows.select(*kept).withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("_shard").applyInPandas(packed, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))


SQL = None
