"""Name similarities: indel ratios and trigrams.

Trigram sets and their Jaccard similarity are plain expressions; what needs an alignment runs in Arrow UDFs, on candidates that an
equi-join has found.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Length of a longest common subsequence, a bit for each character of a."""
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & places.get(x, 0)
        v = (v + u | v - u) & full
    return (~v & full).bit_count()


def ratio(a: str, b: str) -> float:
    """100 for equal texts, 0 for texts without a common character; two empty texts are 0."""
    return 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """100 if one's words are among the other's; else the best of the common words against each whole and the rests' alignment."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = x & y, " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    common = len(" ".join(sorted(both)))
    long_x, long_y = common + bool(common) + len(only_x), common + bool(common) + len(only_y)
    distance = len(only_x) + len(only_y) - 2 * lcs_length(only_x, only_y)
    best = 100.0 * (1 - distance / (long_x + long_y))
    if common:
        for rest, whole in ((only_x, long_x), (only_y, long_y)):
            best = max(best, 100.0 * (1 - (bool(common) + len(rest)) / (common + whole)))
    return best


_WORD = re.compile(r"[^\W_]+")


def trigram_list(text: str) -> list[str]:
    """Trigrams of the words in order, each word with two spaces before and one after it."""
    return [p[k : k + 3] for w in _WORD.findall(text.lower()) for p in (f"  {w} ",) for k in range(len(p) - 2)]


def trigram_similarity(a: str, b: str) -> float:
    x, y = set(trigram_list(a)), set(trigram_list(b))
    return len(x & y) / len(x | y) if x or y else 0.0


def word_similarity(a: str, b: str) -> float:
    """The best similarity of a's trigrams to a contiguous extent of b's."""
    x, listed = set(trigram_list(a)), trigram_list(b)
    if not x or not listed:
        return 0.0
    ends, best = [k for k, t in enumerate(listed) if t in x], 0.0
    for start in ends:  # an extent that begins or ends on another trigram is never better
        inside: set[str] = set()
        hits = at = 0
        for end in [e for e in ends if e >= start]:
            for t in listed[start if end == start else at : end + 1]:
                if t not in inside:
                    inside.add(t)
                    hits += t in x
            at = end + 1
            best = max(best, hits / (len(x) + len(inside) - hits))
    return best


def _pairwise(score: Callable[[str, str], float]):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else score(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return lambda a, b: F.arrow_udf(run, T.DoubleType())(a, b)


indel_ratio = _pairwise(ratio)
sort_ratio = _pairwise(token_sort_ratio)
set_ratio = _pairwise(token_set_ratio)
word_ratio = _pairwise(word_similarity)


#: Trigrams are counted by so many hashes.
GRAM_BUCKETS = 1 << 16


@functools.lru_cache(GRAM_BUCKETS)
def _gram_hash(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass"))


def gram_buckets(name: Column) -> Column:
    """The buckets, under GRAM_BUCKETS, of the distinct trigrams that `name_similarity` compares."""

    def run(names: pa.Array) -> pa.Array:
        return pa.array([[_gram_hash(g) % GRAM_BUCKETS for g in set(trigram_list(x or ""))] for x in names.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))(name)


def gram_lists(name: Column, least: float, often: list[int]) -> Column:
    """struct<ranked, low, high, lack> of a name's distinct trigrams: their hashes, the rarest first (by `often`, a count for each bucket); a bit for each in two words;
    and how many of them another name may lack that is to be alike by more than `least`.
    """
    signed = lambda v, bits: v - (1 << bits) if v >> bits - 1 else v

    def one(text: str | None) -> tuple[list[int], int, int, int]:
        grams, marks = set(trigram_list(text or "")), [0, 0]
        hashes = sorted({_gram_hash(g) for g in grams}, key=lambda h: (often[h % GRAM_BUCKETS], h))
        for h in hashes:
            marks[h >> 6 & 1] |= 1 << (h & 63)
        return [signed(h, 32) for h in hashes], signed(marks[0], 64), signed(marks[1], 64), int((1 - least) * len(grams) + 1e-9)

    kinds = {"ranked": pa.list_(pa.int32()), "low": pa.int64(), "high": pa.int64(), "lack": pa.int32()}

    def run(names: pa.Array) -> pa.Array:
        found = [one(x) for x in names.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds.values())], list(kinds))

    return F.arrow_udf(run, "ranked array<int>, low bigint, high bigint, lack int")(name)


def name_similarity(a: Column, b: Column) -> Column:
    return F.greatest(word_ratio(a, b), word_ratio(b, a))


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text, without Python."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda k: F.substring(w, k, F.lit(3))))))


def trigram_jaccard(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    return both / F.nullif(F.size(x) + F.size(y) - both, F.lit(0))


def word_grams(canonical: Column) -> Column:
    """The distinct trigrams of a canonical text's words, whatever characters these have."""
    padded = F.transform(F.filter(F.split(canonical, " "), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda k: F.substring(w, k, F.lit(3))))))
