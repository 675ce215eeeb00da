"""Near duplicates among embeddings by an inverted multi-index.

Two vectors link when their cosine, in double precision, is LEAST or more.

1. Equal vectors are one class from here on (by 128 bits of hash); classes carry their number of rows.
2. The halves of the normed vectors have codebooks of their own, by k-means on at most SAMPLE classes; their product is a grid of cells, and every
   class lives in the cell of its two nearest centroids.
3. A class visits cells in the order of multi-sequence traversal: by the sum of its two squared distances, as far as this exceeds that of its
   own cell by a depth.  The depth is the one at which TARGET of the sample's pairs of exactly the least cosine, drawn in all directions, and of
   the sample's true links, would be met from either side.  There is no cap on cells or on what is in them.
4. A cell's classes and visitors are brought together by a row of the grid, or a part of one that holds SEGMENT classes (a larger cell is
   salted), and verified there.  What leaves a task is, by class, a number of links and the least id of a component, never the pairs.
5. Families of near copies, of which the sample shows many in one cell, are taken out of the grid first: classes within half the link's angle of a hub all
   link with one another without being compared, and other classes are compared with them if they are within one and a half times the angle
   of the hub, which loses none.

So links that are found are exact, and what may be lost is a share of the links near the least cosine, 1 - TARGET of them about.

Defined cases: vectors that are null, empty, zero, or hold a null or a component that isn't finite link with nothing, and so do rows without an id
(component_id null, kept false).  Vectors of different lengths don't link; each length has an index of its own.  Rows that repeat id and vector are each other's
links like other equal vectors; rows of one id are one node of the components.  An empty table gives an empty result.
Other columns, labels included, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placemill.llm.common import components, cut, mapped, table

LEAST = 0.9
#: Classes that codebooks, depth and hubs are fitted on, at most; those with the smallest hashes.
SAMPLE = 20_000
#: Classes of the sample whose pairs set the depth.
PROBES = 2_000
#: The share of the links of the least cosine that the traversal is to reach.
TARGET = 0.98
#: Centroids of a half: so many that a cell holds OCCUPANCY classes on average, MOST_CENTROIDS at most.
OCCUPANCY, MOST_CENTROIDS = 64, 1024
#: Classes that a task holds while visitors come by.
SEGMENT = 8192
#: Members that a family has in the sample, and in all by its share, before it is taken out of the grid; hubs at most.
FAMILY_SEEN, FAMILY_SIZE, MOST_HUBS = 10, 256, 4096
#: Cosines that are worked out at once.
AT_ONCE = 2_000_000
#: Salts of a cell or a family that a unit's number has room for.
ROOM = 1 << 24


def normed(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _bytes(column: pa.Array) -> np.ndarray:
    """The rows of a binary column of values of one length, as a matrix of bytes."""
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[at[0] : at[-1]].reshape(len(column), -1)


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, vec), a row for each row: the components as bytes, null where the vector can't link."""
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = [None] * batch.num_rows
            lists = batch.column(1)
            ends, valid = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
            values = np.asarray(lists.values.to_numpy(zero_copy_only=False), dtype="<f4" if single else "<f8")  # a null component is not a number
            for k in np.flatnonzero(valid):
                v = values[ends[k] : ends[k + 1]]
                if len(v) and np.isfinite(v).all() and v.any():
                    out[k] = (v + 0).tobytes()  # one kind of zero
            dims = [x and len(x) // (4 if single else 8) for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dim", "vec"])

    return mapped(rows, pack, "vec_id long, dim int, vec binary")


@dataclass
class Index:
    """What the executors get: codebooks, depth, hubs and, once the cells are counted, their parts and salts."""

    dim: int
    dtype: str
    least: float
    books: tuple[np.ndarray, np.ndarray]
    depth: float = 0.0
    hubs: np.ndarray | None = None
    part: np.ndarray | None = None  # of a cell, within its row of the grid
    salts: np.ndarray | None = None  # of a cell
    hub_salts: np.ndarray | None = None

    @property
    def split(self) -> int:
        return (self.dim + 1) // 2

    @property
    def within(self) -> float:
        """The cosine to a hub of which two classes link for certain."""
        return math.cos(math.acos(self.least) / 2) + 1e-9

    @property
    def near(self) -> float:
        """The cosine to a hub below which a class links with none of its family."""
        return math.cos(min(math.pi, 1.5 * math.acos(self.least))) - 1e-9

    def vectors(self, column: pa.Array) -> np.ndarray:
        return normed(_bytes(column).view(self.dtype))

    def excess(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By half: the squared distances to its centroids beyond that to the nearest one."""
        return tuple((lambda d: d - d.min(axis=1, keepdims=True))((c * c).sum(axis=1) - 2 * h @ c.T) for h, c in zip((x[:, : self.split], x[:, self.split :]), self.books, strict=True))

    def families(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(own family or -1, which families a class is to be compared with)."""
        if self.hubs is None or not len(self.hubs):
            return np.full(len(x), -1), np.zeros((len(x), 0), dtype=bool)
        cosines = x @ self.hubs.T
        own = np.where(cosines.max(axis=1) >= self.within, cosines.argmax(axis=1), -1)
        # of two families, the later one's members visit the earlier one's
        visits = (cosines >= self.near) & ((own < 0)[:, None] | (np.arange(len(self.hubs)) < own[:, None]))
        return own, visits


def traversal(e1: np.ndarray, e2: np.ndarray, depth: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, i, j) of the cells that each row visits: all whose two excesses add up to `depth` at most, found along the two sorted sequences."""
    order = np.argsort(e2, axis=1, kind="stable")
    ranked_ = np.take_along_axis(e2, order, axis=1)
    ranked_ = ranked_[:, : max(1, int((ranked_ <= depth).sum(axis=1).max(initial=1)))]
    row, i = np.nonzero(e1 <= depth)
    at, rank = np.nonzero(ranked_[row] <= (depth - e1[row, i])[:, None])
    row, i = row[at], i[at]
    return row, i, order[row, rank]


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """k centroids of x by k-means, in the order of their main direction, so that near ones have near numbers."""
    different = np.unique(x, axis=0)
    k = max(1, min(k, len(different)))
    c = different[rng.choice(len(different), k, replace=False)]
    for _ in range(rounds):
        near = np.argmin((c * c).sum(axis=1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=x[:, d], minlength=k) for d in range(x.shape[1])], axis=1) if x.shape[1] else c * 0
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    if k < 3 or not x.shape[1]:
        return c
    main = np.linalg.svd(c - c.mean(axis=0), full_matrices=False)[2][0]
    return c[np.argsort(c @ main, kind="stable")]


def _turned(x: np.ndarray, least: float, rng: np.random.Generator) -> np.ndarray:
    """Vectors of exactly the least cosine to x, in any direction."""
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    length = np.sqrt((side * side).sum(axis=1, keepdims=True))
    side = np.divide(side, length, out=np.zeros_like(side), where=length > 0)
    return least * x + math.sqrt(1 - least * least) * side


def _depth(index: Index, x: np.ndarray, target: float, rng: np.random.Generator) -> float:
    """The depth of traversal at which the share `target` of links is met from either side."""

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        e, f = index.excess(a), index.excess(b)
        at = np.arange(len(a))
        one, two = (sum(u[at, v.argmin(axis=1)] for u, v in zip(p, q, strict=True)) for p, q in ((e, f), (f, e)))
        return np.minimum(one, two)

    probes = x[:PROBES]
    found = [np.quantile(apart(probes, _turned(probes, index.least, rng)), target)]
    linked = []
    for begin in range(0, len(probes), 100):
        a, b = np.nonzero(probes[begin : begin + 100] @ x.T >= index.least)
        a += begin
        linked.append(apart(probes[a[a != b]], x[b[a != b]]))
    linked = np.concatenate(linked)
    if len(linked):
        found.append(np.quantile(linked, target))
    return float(max(found)) + 1e-12


def _hubs(index: Index, x: np.ndarray, n: int) -> np.ndarray:
    """Hubs of the families that are many in a cell of the sample: means of a class and those that link with it."""
    cells = np.stack([e.argmin(axis=1) for e in index.excess(x)], axis=1) @ [MOST_CENTROIDS, 1]
    least_seen = max(FAMILY_SEEN, math.ceil(FAMILY_SIZE * len(x) / n))
    found: list[np.ndarray] = []
    names, counts = np.unique(cells, return_counts=True)
    for cell in names[np.argsort(-counts, kind="stable")]:
        left = x[cells == cell][:1024]  # which hubs there are is decided on these; all classes count under them
        while len(left) >= least_seen and len(found) < MOST_HUBS:
            links = left @ left.T >= index.least
            most = int(links.sum(axis=1).argmax())
            if links[most].sum() < least_seen:
                break
            hub = left[links[most]].mean(axis=0)
            hub /= np.sqrt((hub * hub).sum())
            inside = left @ hub >= index.within
            if inside.sum() >= least_seen and all(hub @ f < index.within for f in found):
                found.append(hub)
            left = left[~(inside | links[most])]
    return np.array(found).reshape(-1, index.dim)


def fit(classes: DataFrame, dim: int, dtype: str, least: float, target: float, sample: int) -> Index:
    """Codebooks, depth and hubs from at most `sample` of classes (h, vec)."""
    n = classes.count()
    rows = classes.select("h", "vec").orderBy("h").limit(sample).toArrow()  # h is a hash
    raw = np.frombuffer(b"".join(rows.column("vec").to_pylist()), dtype=dtype).reshape(-1, dim)
    x, rng = normed(raw), np.random.default_rng(11)
    k = min(MOST_CENTROIDS, max(1, math.ceil(math.sqrt(n / OCCUPANCY))))
    split = (dim + 1) // 2
    index = Index(dim, dtype, least, (codebook(x[:, :split], k, rng), codebook(x[:, split:], k, rng)))
    index.depth = _depth(index, x, target, rng)
    index.hubs = _hubs(index, x, n)
    return index


def _counted(classes: DataFrame, index: Index) -> None:
    """Deals the cells out to parts of SEGMENT classes, from how many are in each: MOST_CENTROIDS ** 2 and MOST_HUBS numbers at most."""
    shared = classes.sparkSession.sparkContext.broadcast(index)
    k1, k2 = (len(b) for b in index.books)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        cells, families = np.zeros(k1 * k2, dtype=np.int64), np.zeros(len(ix.hubs), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = ix.vectors(batch.column(0))
                own, _ = ix.families(x)
                e1, e2 = ix.excess(x[own < 0])
                cells += np.bincount(e1.argmin(axis=1) * k2 + e2.argmin(axis=1), minlength=k1 * k2)
                families += np.bincount(own[own >= 0], minlength=len(ix.hubs))
        both = np.concatenate((cells, families))
        at = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[at])], ["at", "n"])

    found = mapped(classes.select("vec"), count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(k1 * k2 + len(index.hubs), dtype=np.int64)
    n[found["at"].to_numpy()] = found["n"].to_numpy()
    cells, families = n[: k1 * k2].reshape(k1, k2), n[k1 * k2 :]
    index.part = (np.cumsum(cells, axis=1) - cells) // SEGMENT
    index.salts, index.hub_salts = np.maximum(1, -(-cells // SEGMENT)), np.maximum(1, -(-families // SEGMENT))


ENTRY = "unit long, visitor boolean, h binary, rep long, w long, cell long, family int, cells binary, visits binary, vec binary"
NAMES = [c.split()[0] for c in ENTRY.split(", ")]


def entries(classes: DataFrame, index: Index) -> DataFrame:
    """ENTRY: a class once where it lives, with the cells that it visits (cells) and those of them that are there (visits), and once a unit that it visits."""
    shared = classes.sparkSession.sparkContext.broadcast(index)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        k2 = len(ix.books[1])
        for whole in batches:
            for begin in range(0, whole.num_rows, 2000):
                batch = whole.slice(begin, 2000)
                x = ix.vectors(batch.column(3))
                salt = _bytes(batch.column(0))[:, :4].copy().view("<u4").ravel().astype(np.int64)
                own, near = ix.families(x)
                free = np.flatnonzero(own < 0)
                e1, e2 = ix.excess(x[free])
                row, i, j = traversal(e1, e2, ix.depth)
                row, cell = free[row], i * k2 + j
                home = np.full(len(x), -1, dtype=np.int64)
                home[free] = e1.argmin(axis=1) * k2 + e2.argmin(axis=1)
                # (row, unit, cell) of every visit: to all salts of the cells and families that are visited
                salts = ix.salts.ravel()[cell]
                copy = np.arange(int(salts.sum())) - np.repeat(np.cumsum(salts) - salts, salts)
                unit = np.repeat((i * k2 + ix.part.ravel()[cell]) * ROOM, salts) + copy
                v_row, v_cell = np.repeat(row, salts), np.repeat(cell, salts)
                f_row, f = np.nonzero(near)
                salts = ix.hub_salts[f]
                copy = np.arange(int(salts.sum())) - np.repeat(np.cumsum(salts) - salts, salts)
                v_row = np.concatenate((v_row, np.repeat(f_row, salts)))
                unit = np.concatenate((unit, -1 - (np.repeat(f, salts) * ROOM + copy)))
                v_cell = np.concatenate((v_cell, np.full(len(copy), -1, dtype=np.int64)))
                # where each lives
                lives = np.where(own >= 0, -1 - (own * ROOM + salt % ix.hub_salts[own] if len(ix.hubs) else 0), 0)
                at = home[free]
                lives[free] = (at // k2 * k2 + ix.part.ravel()[at]) * ROOM + salt[free] % ix.salts.ravel()[at]
                order = np.lexsort((v_cell, unit, v_row))
                v_row, unit, v_cell = v_row[order], unit[order], v_cell[order]
                new = np.ones(len(v_row), dtype=bool)
                new[1:] = (v_row[1:] != v_row[:-1]) | (unit[1:] != unit[:-1])
                first = np.flatnonzero(new)
                ends = np.append(first[1:], len(v_row))
                visitor = unit[first] != lives[v_row[first]]
                lists = [v_cell[a:b].tobytes() for a, b in zip(first, ends, strict=True)]
                # members of families don't visit where they live
                at_home = {int(r): x for r, x, v in zip(v_row[first], lists, visitor, strict=True) if not v}
                all_cells = np.lexsort((cell, row))
                bounds = np.searchsorted(row[all_cells], np.arange(len(x) + 1))
                cells = [cell[all_cells[a:b]].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                r = np.concatenate((np.arange(len(x)), v_row[first][visitor]))
                take = batch.take(pa.array(r))
                out_cells = [*cells, *[b""] * int(visitor.sum())]
                out_visits = [*(at_home.get(k, b"") for k in range(len(x))), *(lists[k] for k in np.flatnonzero(visitor))]
                arrays = [
                    pa.array(np.concatenate((lives, unit[first][visitor]))), pa.array(np.arange(len(r)) >= len(x)), take.column(0), take.column(1), take.column(2), pa.array(home[r]),
                    pa.array(own[r].astype(np.int32)), pa.array(out_cells, pa.binary()), pa.array(out_visits, pa.binary()), take.column(3),
                ]
                yield pa.RecordBatch.from_arrays(arrays, NAMES)

    return mapped(classes.select("h", "rep", "w", "vec"), deal, ENTRY)


FOUND = "h binary, n long, a long, b long, family int, w long"
FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def _before(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether hashes (rows of 16 bytes) come before others."""
    a, b = (np.ascontiguousarray(z).view(">u8") for z in (x, y))
    return (a[:, 0] < b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] < b[:, 1]))


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


class Unit:
    """The classes that live in one unit, and what visitors meet there."""

    def __init__(self, index: Index, key: int):
        self.index, self.key, self.k2 = index, key, len(index.books[1])
        self.held: list[pa.RecordBatch] = []
        self.edges: list[np.ndarray] = []
        self.x = None

    def settle(self) -> None:
        """All that live here have come."""
        rows = pa.Table.from_batches(self.held).combine_chunks().to_batches()[0] if self.held else None
        self.held, self.rows = [], rows
        if rows is None:
            self.x = np.zeros((0, self.index.dim))
            return
        self.x = self.index.vectors(rows.column(9))
        self.h, self.rep, self.w = _bytes(rows.column(2)), rows.column(3).to_numpy(), rows.column(4).to_numpy()
        self.cell, self.family = rows.column(5).to_numpy(), rows.column(6).to_numpy()
        self.n, self.low = np.zeros(len(self.x), dtype=np.int64), self.rep.copy()
        lists = [np.frombuffer(c, dtype=np.int64) for c in rows.column(7).to_pylist()]
        #: (class, cell that it visits) as one number, sorted
        self.span = 1 + max((int(c.max()) for c in lists if len(c)), default=0)
        self.codes = np.concatenate([k * self.span + c for k, c in enumerate(lists)]) if lists else np.zeros(0, dtype=np.int64)

    def met(self, rows: pa.RecordBatch, at_home: bool) -> Iterator[pa.RecordBatch]:
        """Compares visitors (or those who live here) with the classes of the cells that they visit."""
        if not len(self.x):
            return
        ix = self.index
        x = self.x if at_home else ix.vectors(rows.column(9))
        h = self.h if at_home else _bytes(rows.column(2))
        rep, w, home = rows.column(3).to_numpy(), rows.column(4).to_numpy(), rows.column(5).to_numpy()
        n, low = np.zeros(len(x), dtype=np.int64), self.low if at_home else rep.copy()
        lists = [np.frombuffer(c, dtype=np.int64) for c in rows.column(8).to_pylist()]
        who, cell = np.repeat(np.arange(len(lists)), [len(c) for c in lists]), np.concatenate(lists) if lists else np.zeros(0, dtype=np.int64)
        order = np.argsort(cell, kind="stable")
        names, begin = np.unique(cell[order], return_index=True)
        for name, a, b in zip(names, begin, np.append(begin[1:], len(order)), strict=True):
            here = np.arange(len(self.x)) if name < 0 else np.flatnonzero(self.cell == name)
            step = max(1, AT_ONCE // max(1, len(here)))
            for c in range(a, b, step) if len(here) else ():
                v = who[order[c : min(b, c + step)]]
                p, q = np.nonzero(x[v] @ self.x[here].T >= ix.least)
                p, q = v[p], here[q]
                if name >= 0:  # a pair that also meets where the other one lives counts where the lesser of both lives
                    theirs = home[p]
                    code = q * self.span + theirs
                    at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                    twice = (theirs < self.span) & (self.codes[at] == code)
                    less = (self.cell[q] < theirs) | ((self.cell[q] == theirs) & _before(self.h[q], h[p]))
                    go = ~twice | less
                    p, q = p[go], q[go]
                if len(p):
                    n += np.bincount(p, weights=self.w[q], minlength=len(x)).astype(np.int64)
                    self.n += np.bincount(q, weights=w[p], minlength=len(self.x)).astype(np.int64)
                    self._join(p, q, low)
        if at_home:
            self.n += n
            return
        some = np.flatnonzero(n > 0)
        if len(some):
            none = pa.nulls(len(some), pa.int32())
            yield pa.RecordBatch.from_arrays([_binary(h[some]), pa.array(n[some]), pa.array(rep[some]), pa.array(rep[some]), none, pa.array(w[some])], FOUND_NAMES)
        if len(self.edges) > 100:
            yield from self.joined()

    def _join(self, p: np.ndarray, q: np.ndarray, low: np.ndarray) -> None:
        """Lowers the labels low[p] and self.low[q] along the links (p, q) until nothing changes; a label that went is an edge to the one that came."""
        before = np.concatenate((low[p], self.low[q]))
        while True:
            least = np.minimum(low[p], self.low[q])
            if (low[p] == least).all() and (self.low[q] == least).all():
                break
            np.minimum.at(low, p, least)
            np.minimum.at(self.low, q, least)
        after = np.concatenate((low[p], self.low[q]))
        moved = before != after
        if moved.any():
            self.edges.append(np.unique(np.stack((before[moved], after[moved])), axis=1))

    def joined(self) -> Iterator[pa.RecordBatch]:
        """Ids of one component, in pairs."""
        if self.edges:
            a, b = np.unique(np.concatenate(self.edges, axis=1), axis=1)
            self.edges = []
            none, zero = pa.nulls(len(a), pa.binary()), pa.array(np.zeros(len(a), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([none, zero, pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32()), zero], FOUND_NAMES)

    def told(self) -> Iterator[pa.RecordBatch]:
        """What is known of those who live here."""
        yield from self.joined()
        some = np.flatnonzero((self.n > 0) | (self.family >= 0)) if len(self.x) else []
        if len(some):
            family = pa.array(self.family[some], pa.int32(), mask=self.family[some] < 0)
            yield pa.RecordBatch.from_arrays([_binary(self.h[some]), pa.array(self.n[some]), pa.array(self.rep[some]), pa.array(self.rep[some]), family, pa.array(self.w[some])], FOUND_NAMES)


def met(dealt: DataFrame, index: Index) -> DataFrame:
    """FOUND from entries sorted by (unit, visitor), each unit in one partition."""
    shared = dealt.sparkSession.sparkContext.broadcast(index)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit: Unit | None = None

        def settled() -> Iterator[pa.RecordBatch]:
            if unit is not None and unit.x is None:
                unit.settle()
                if unit.rows is not None and unit.key >= 0:
                    yield from unit.met(unit.rows, True)

        for batch in batches:
            keys, visitor = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            new = np.flatnonzero((keys[1:] != keys[:-1]) | (visitor[1:] != visitor[:-1])) + 1
            for a, b in zip([0, *new], [*new, len(keys)], strict=True):
                if a == b:
                    continue
                if unit is None or unit.key != keys[a]:
                    if unit is not None:
                        yield from settled()
                        yield from unit.told()
                    unit = Unit(shared.value, int(keys[a]))
                if visitor[a]:
                    yield from settled()
                    yield from unit.met(batch.slice(a, b - a), False)
                else:
                    unit.held.append(batch.slice(a, b - a))
        if unit is not None:
            yield from settled()
            yield from unit.told()

    return mapped(dealt, meet, FOUND)


def links(classes: DataFrame, dim: int, dtype: str, least: float = LEAST, target: float = TARGET, sample: int = SAMPLE) -> DataFrame:
    """FOUND of the classes of one length: rows with a hash count links, and a and b are in one component."""
    index = fit(classes, dim, dtype, least, target, sample)
    _counted(classes, index)
    return cut(met(entries(classes, index).repartition("unit").sortWithinPartitions("unit", "visitor"), index))


def vector_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, target: float = TARGET, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors."""
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = prepared(vectors, id_col, vector_col).withColumn("h", F.when(F.col("vec_id").isNotNull(), F.unhex(F.md5("vec"))))
    can = cut(rows.filter("h IS NOT NULL"))
    small = can.groupBy("h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"))
    classes = cut(can.withColumnRenamed("vec_id", "rep").join(small, ["h", "rep"]).dropDuplicates(["h"]))
    dims = [r["dim"] for r in classes.select("dim").distinct().orderBy("dim").collect()]
    found = [links(classes.filter(F.col("dim") == d), d, "<f4" if single else "<f8", least, target, sample) for d in dims]
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))
    each = None
    for d, f in zip(dims, found, strict=True):
        own = f.withColumn("family", F.when(F.col("family").isNotNull(), F.struct(F.lit(d).alias("d"), F.col("family").alias("f"))))
        each = own if each is None else each.unionByName(own)
    families = cut(each.filter("family IS NOT NULL").groupBy("family").agg(F.sum("w").alias("all"), F.min("a").alias("least")))
    near = F.broadcast(families)  # MOST_HUBS rows for each length at most
    counted = each.filter("h IS NOT NULL").groupBy("h").agg(F.sum("n").alias("n"), F.max("family").alias("family")).join(near, "family", "left").select("h", "n", "all")
    edges = each.filter("a <> b").select("a", "b").union(each.join(near, "family").select("a", F.col("least").alias("b")))
    named = components(edges)
    told = classes.select("h", "rep", "w").join(counted, "h", "left").join(named, F.col("rep") == F.col("id"), "left")
    n = F.col("w") - 1 + F.coalesce("n", F.lit(0)) + F.coalesce(F.col("all") - F.col("w"), F.lit(0))
    told = told.select("h", n.alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "h").join(told, "h", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(table(spark, sf_dir, "embeddings"))


#: Every pair: the links that the index is to find.
SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {LEAST}),
r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.id),
c AS (SELECT id, min(c) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN n ON id = a
"""
