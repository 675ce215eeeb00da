"""Importance resampling against brute force with zlib."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from placemill.llm import importance
from placemill.llm.words import slices

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]


def expected(rows, target):
    own, goal = collections.Counter(), collections.Counter()
    for _, text in rows:
        own.update(features(text)[1])
    for text in target:
        goal.update(features(text)[1])
    s, t = sum(own.values()), sum(goal.values())
    out = []
    for doc_id, text in rows:
        n_words, f = features(text)
        gain = [math.floor(1000 * math.log((goal[b] + 1.0) * (s + 10000.0) / ((own[b] + 1.0) * (t + 10000.0)))) for b in f]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    most = len(enough) * 25 // 100
    placed = [(*(r[0], r[2], r[3], r[4]), k + 1 if k < most else None) for k, r in enumerate(enough)]
    return collections.Counter([*placed, *((r[0], r[2], r[3], r[4], None) for r in out if r[1] < 20)])


def test_buckets_are_those_of_zlib():
    r = random.Random(3)
    letters = "abcXYZ09 é漢\x00\n-_\x7f"
    texts = [None, "", "-", "A", "a" * 100_000, "x " + "b" * 49 + " " + "c" * 48 + " y"] + ["".join(r.choice(letters) for _ in range(r.randint(0, 200))) for _ in range(300)]
    found = collections.defaultdict(list)
    for w in slices(pa.array(texts), lower=True, limit=500, blank=importance._BLANK):
        for b, row in zip(*importance.features(w), strict=True):
            found[w.first + row].append(int(b))
    for k, text in enumerate(texts):
        assert collections.Counter(found[k]) == collections.Counter(features(text)[1])


def test_resampling_against_brute_force(spark, docs, rows):
    target = ["The café opens at nine", None, "", "word " * 50, rows[3][1]]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, frame)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert collections.Counter(tuple(r) for r in got.collect()) == expected([(i, t) for i, t, _ in rows], target)


def test_the_draw_leans_to_the_target(spark):
    r = random.Random(5)
    some, other = ([f"{x}{k}" for k in range(200)] for x in "ab")
    docs = [(k, " ".join(r.choice(some if k % 4 == 0 else other) for _ in range(60))) for k in range(400)]
    target = spark.createDataFrame([(" ".join(r.choice(some) for _ in range(60)),) for _ in range(40)], "text string")
    drawn = importance.resampled(spark.createDataFrame(docs, "doc_id long, text string"), target).collect()
    assert [x["rank"] for x in sorted(drawn, key=lambda x: x["rank"])] == list(range(1, 101))
    assert sum(x["doc_id"] % 4 == 0 for x in drawn) > 50  # a quarter of the documents are like the target; 25 without weights


def test_without_documents_or_target(spark, docs, empty):
    target = spark.createDataFrame([], "text string")
    assert importance.resample(empty, target).count() == 0
    assert {r["weight"] for r in importance.resample(docs.filter("doc_id = 900004"), target).collect()} == {int(np.floor(1000 * np.log(10005 / (2 * 10000))))}
