"""Links among vectors against all pairs."""

import collections

import numpy as np
import pytest

from placemill.llm import vector_dedup as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.9):
    """(n_links, component_id) by row."""
    x = [np.asarray(v, dtype=np.float64) if v and all(c is not None for c in v) and np.isfinite(np.asarray(v, dtype=float)).all() and any(v) and i is not None else None for i, v, _ in rows]
    n, up = [0] * len(rows), {i: i for i, _, _ in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for d in {len(v) for v in x if v is not None}:
        at = [k for k, v in enumerate(x) if v is not None and len(v) == d]
        m = np.stack([x[k] / np.linalg.norm(x[k]) for k in at])
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= least, 1)), strict=True):
            i, j = at[a], at[b]
            n[i] += 1
            n[j] += 1
            low, high = sorted((find(rows[i][0]), find(rows[j][0])))
            up[high] = low
    return [(i, n[k], None if i is None else find(i), i is not None and find(i) == i) for k, (i, _, _) in enumerate(rows)]


def near(r, x, cosine):
    side = r.normal(size=x.shape)
    side -= (side @ x) / (x @ x) * x
    side /= np.linalg.norm(side)
    return cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine**2) * side


def planted(seed, n, dim, families, cosines=(0.91, 0.93, 0.96, 0.99, 0.999)):
    r = np.random.default_rng(seed)
    rows = [(k, [float(c) for c in r.normal(size=dim)], 0) for k in range(n)]
    for k in range(n // 5):
        rows.append((n + k, [float(c) for c in 3 * near(r, np.array(rows[k][1]), cosines[k % len(cosines)])], 1))
    for f, (size, cosine) in enumerate(families):
        centre = r.normal(size=dim)
        rows += [(100_000 * (f + 1) + k, [float(c) for c in near(r, centre, cosine)], 2) for k in range(size)]
    return rows


ODD = [
    (900_000, None, 0), (900_001, [], 0), (900_002, [0.0] * 16, 0), (900_003, [float("nan"), *[1.0] * 15], 0), (900_004, [None, *[1.0] * 15], 0), (900_005, [float("inf"), *[1.0] * 15], 0),
    (900_006, [1.0] * 16, 0), (900_007, [1.0] * 16, 0), (900_007, [1.0] * 16, 0), (900_008, [2.0] * 16, 0), (900_009, [-0.0, *[1.0] * 15], 0), (900_010, [0.0, *[1.0] * 15], 0), (None, [1.0] * 16, 0),
    (900_011, [-1.0] * 16, 0), (900_011, [1.0, *[-1.0] * 15], 0), (900_012, [5.0], 0), (900_013, [7.0], 0), (900_014, [-7.0], 0), (900_015, [1.0, 2.0], 0), (900_016, [1e-38] * 16, 0),
]


def share(got, want):
    """Links found by all links."""
    have, every = sum(r[1] for r in got), sum(r[1] for r in want)
    return have / every if every else 1.0


@pytest.mark.parametrize(
    ("seed", "n", "dim", "families", "segment", "family"),
    [(1, 400, 16, [], 8192, 256), (2, 600, 32, [(300, 0.995), (80, 0.96)], 50, 20), (3, 1500, 24, [(200, 0.99)], 64, 256), (4, 300, 7, [(150, 0.97), (150, 0.999)], 16, 20)],
)
def test_links_against_all_pairs(spark, monkeypatch, seed, n, dim, families, segment, family):
    monkeypatch.setattr(V, "SEGMENT", segment)
    monkeypatch.setattr(V, "FAMILY_SIZE", family)
    monkeypatch.setattr(V, "OCCUPANCY", 16)
    rows = planted(seed, n, dim, families) + ODD
    got = sorted((tuple(r) for r in V.vector_dedup(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()), key=str)
    # in single precision, as the column holds them
    single = [(i, v and [None if c is None else float(np.float32(c)) for c in v], z) for i, v, z in rows]
    want = sorted(brute(single), key=str)
    assert len(got) == len(want) and 0.97 <= share(got, want) <= 1
    # what the whole traversal finds is every link, counted once
    everything = sorted((tuple(r) for r in V.vector_dedup(spark.createDataFrame(rows, SCHEMA).repartition(7), target=1.0).collect()), key=str)
    if share(everything, want) == 1:
        assert everything == want
    monkeypatch.setattr(V, "_depth", lambda *_: 10.0)
    assert sorted((tuple(r) for r in V.vector_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str) == want


def test_doubles_and_no_rows(spark):
    schema = "vec_id long, embedding array<double>"
    assert V.vector_dedup(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1e300, 1e300]), (2, [1.0, 1.0]), (3, [1.0, -1.0]), (4, None)]
    got = {tuple(r) for r in V.vector_dedup(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)}
    assert {tuple(r) for r in V.vector_dedup(spark.createDataFrame([(4, None)], schema)).collect()} == {(4, 0, 4, True)}


def test_traversal_visits_the_nearest_cells():
    r = np.random.default_rng(5)
    e = [x - x.min(axis=1, keepdims=True) for x in (r.random((50, 9)), r.random((50, 12)))]
    for depth in (0.0, 0.3, 5.0):
        got = collections.Counter(zip(*(x.tolist() for x in V.traversal(*e, depth)), strict=True))
        want = collections.Counter((k, i, j) for k in range(50) for i in range(9) for j in range(12) if e[0][k, i] + e[1][k, j] <= depth)
        assert got == want


def test_recall_on_the_given_vectors(spark):
    """Copies of the given vectors, turned by exactly the least cosine (and a hair less, which must not link)."""
    r = np.random.default_rng(9)
    own = [(x["vec_id"], [float(c) for c in x["embedding"]], 0) for x in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    rows = own + [(10_000 + i, [float(c) for c in near(r, np.array(v), 0.9 + 1e-6)], 0) for i, v, _ in own] + [(20_000 + i, [float(c) for c in near(r, np.array(v), 0.8999)], 0) for i, v, _ in own[:200]]
    got = [tuple(x) for x in V.vector_dedup(spark.createDataFrame(rows, SCHEMA)).collect()]
    found = {x[0]: x[2] for x in got}
    assert np.mean([found[10_000 + i] == i for i, _, _ in own]) >= 0.95
    assert all(found[20_000 + i] == 20_000 + i for i, _, _ in own[:200])
