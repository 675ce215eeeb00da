"""The manifest against a tree that is built row by row, and its proofs against the definition."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from placemill.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row, text):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def climb(nodes):
    """(root, proofs): a proof is the runs on a node's way, with its place in them."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
        for i, k in enumerate(at):
            proofs[i].append((k % 16, runs[k // 16]))
        at, nodes = [k // 16 for k in at], [h("".join(r)) for r in runs]
    return nodes[0], proofs


def expected(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        ordered = sorted(by[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees.append((ordered, *climb([leaf(r, r["text"]) for r in ordered])))
    root, tops = climb([t[1] for t in trees])
    out = []
    for (ordered, subroot, proofs), top in zip(trees, tops, strict=True):
        for r, proof in zip(ordered, proofs, strict=True):
            path = proof + top
            hit = r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"]) if hit else r["text"]
            node = leaf(r, text)
            for k, run in path:
                node = h("".join([*run[:k], node, *run[k + 1 :]]))
            siblings = "".join("".join(run[:k] + run[k + 1 :]) for k, run in path)
            out.append((r["doc_id"], leaf(r, r["text"]), subroot, root, h(siblings), node, node == root))
    return collections.Counter(out)


def some_rows(seed, sources, n):
    r = random.Random(seed)
    rows = [(k, r.choice([None, "", "Some Text é", "lower", f"Row {k}"]), r.choice([None, "en"]), r.choice(sources), r.choice([None, k])) for k in r.sample(range(10 * n), n)]
    return [*rows, *rows[:3], (None, "No Id", "en", sources[0], 1), (None, None, None, None, None)]


@pytest.mark.parametrize(("sources", "n", "top"), [(["a"], 5, 65536), (["a", "b", None, "", "é", "zz"], 900, 65536), (["a", "b"], 1500, 2), ([f"s{k}" for k in range(300)], 700, 8), (["one", *[f"s{k}" for k in range(40)], *["one"] * 40], 1800, 3)])
def test_manifest_against_a_plain_tree(spark, sources, n, top):
    docs = spark.createDataFrame(some_rows(n, sources, n), SCHEMA).withColumn("tree", F.lit("x")).withColumn("digest", F.lit(1)).repartition(5)
    got = merkle.manifest(docs, merkle.lowered(docs), top=top)
    assert collections.Counter(tuple(r) for r in got.collect()) == expected(docs.collect())


def test_manifest_of_the_fixture(spark, docs, empty):
    rows = docs.withColumn("n_chars", F.length("text").cast("long"))
    got = merkle.manifest(rows, merkle.lowered(rows)).collect()
    assert collections.Counter(tuple(r) for r in got) == expected(rows.collect())
    assert {r["verified"] for r in got} == {True, False}
    none = empty.withColumn("n_chars", F.lit(None).cast("long"))
    assert merkle.manifest(none, merkle.lowered(none)).collect() == []


def test_proofs_hold_without_the_table(spark):
    docs = spark.createDataFrame(some_rows(4, ["a", "b", "b", "b"], 600), SCHEMA)
    rows = merkle.manifest(docs, with_path=True).collect()
    assert len({r["root"] for r in rows}) == 1 and all(r["verified"] for r in rows)
    for r in rows:
        node = r["leaf"]
        for step in r["path"]:
            node = h("".join([*step["before"], node, *step["after"]]))
        assert node == r["root"]
    single = merkle.manifest(docs.limit(1), with_path=True).collect()[0]
    assert single["leaf"] == single["root"] and single["proof_sha256"] == h("") and single["path"] == []
