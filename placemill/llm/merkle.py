"""Merkle dataset manifest: a tree of hashes over all rows, a proof for each row, and a check of each row against the root.

A leaf is the sha256 of a row's columns, each `-` if null, else its UTF-8 byte count, a colon and its value.  The leaves of a source, by id, are
the lowest level of the source's tree; every FAN nodes of a level (the last run may be shorter) become the sha256 of their hex
digests, until one is left, the subroot.  The subroots, by source, are the leaves of the tree of the root.

1. Leaves are hashed in the JVM; only digests are shuffled, sorted by (source, id) in ranges, so that a source of any size is dealt to many tasks.
2. Every block of FAN ** levels leaves of a source is reduced by one task to one node.  `levels` grows with the number of rows, so that the
   driver gets TOP nodes at most, for the sources of several blocks together; those of one block are ready.  Where there are more
   than TOP sources, their subroots are reduced in blocks in the same way.
3. The driver builds the tops of the trees and broadcasts them; an executor reads a block's suffix path off them: its ancestors' runs up to the root.
4. Tasks go over the same sorted blocks once more, without a shuffle: they rebuild a block's levels, hash each row's siblings, and fold the digest of
   what is there now with its siblings up to the root.

Defined cases: null and empty values differ (`-` and `0:`).  The null source is a source, the first one.  Rows without an id come first in their source;
rows that repeat an id go by their digests, and rows that repeat altogether have leaves of equal digests and proofs of their own.  A
single row's proof is the hash of nothing.  An empty table gives an empty result.  Texts of any length are hashed whole.  Columns
besides those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill.llm.common import cut, mapped, ranked, table
from placemill.llm.importance import _CRC_TABLE, crc_sql

FAN, BITS = 16, 4
#: Nodes that the driver holds: of all sources of several blocks together (two times as many at most), and of the tree of subroots.
TOP = 65_536
#: Levels that a block has at least: 256 leaves.
LEAST_LEVELS = 2
#: Sources up to which their places are broadcast (a name and three numbers each); beyond it they are joined by a shuffle.
BROADCAST_SOURCES = 100_000

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
PATH = "path array<struct<before:array<string>,after:array<string>>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Levels = list[list[str]]
Path = list[tuple[int, list[str]]]


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row's values, 32 bytes."""
    field = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.unhex(F.sha2(F.concat(*[field(c.cast("string")) for c in values]), 256))


def lowered(docs: DataFrame) -> Column:
    """The leaf of a row whose text is lower-cased (A-Z) where 5 divides the crc32 of its id; null elsewhere."""
    text = F.translate(F.col("text"), UPPER, LOWER)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(hit, leaf([text if c == "text" else F.col(c) for c in COLUMNS]))


def digest(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def climbed(nodes: list[str], most: int | None = None, whole: bool = True) -> Levels:
    """The levels above nodes, up to `most`; whole: these are all nodes of their level, so that a single one is the end."""
    levels = [nodes]
    while (most is None or len(levels) <= most) and (not whole or len(levels[-1]) > 1):
        last = levels[-1]
        levels.append([digest(last[k : k + FAN]) for k in range(0, len(last), FAN)])
    return levels


def path_of(levels: Levels, place: int) -> Path:
    """(place in its run, run) of a node of the lowest level, and of its ancestors but the last."""
    path = []
    for level in levels[:-1]:
        begin = place // FAN * FAN
        path.append((place - begin, level[begin : begin + FAN]))
        place //= FAN
    return path


def folded(node: str, path: Path) -> str:
    """The root that a node gives with its siblings."""
    for k, run in path:
        node = digest([*run[:k], node, *run[k + 1 :]])
    return node


def siblings(path: Path) -> str:
    return "".join("".join(run[:k]) + "".join(run[k + 1 :]) for k, run in path)


def _needed(nodes: int, least: int, most: int) -> int:
    """Levels after which `nodes` are no more than `most`."""
    levels = least
    while nodes / FAN**levels > most:
        levels += 1
    return levels


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, where groups begin and the end) of sorted rows whose first two columns name their group; no group is cut."""

    def keys(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return np.asarray(t.column(0)), np.asarray(t.column(1))

    def ready(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        a, b = keys(t)
        return t, np.concatenate(([0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, [len(a)]))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = keys(batch)
        one = (a == a[-1]) & (b == b[-1])
        split = int(np.argmax(one))  # where the last group of this batch begins
        if not split and held:
            x, y = keys(held[-1])
            split = 0 if (x[-1], y[-1]) == (a[0], b[0]) else -1
        if split:
            done = [*held, batch.slice(0, max(split, 0))]
            yield ready(pa.Table.from_batches(done).combine_chunks())
            held, batch = [], batch.slice(max(split, 0))
        held.append(batch)
    if held:
        yield ready(pa.Table.from_batches(held).combine_chunks())


def reduced(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, block, n, digest) of the blocks of nodes (tree, block, n, digest), sorted by (tree, place) with whole blocks in a partition."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends in whole_groups(batches):
            digests = [x.hex() for x in rows.column(3).to_pylist()]
            first = rows.take(pa.array(ends[:-1]))
            n = first.column(2).to_pylist()
            tops = [climbed(digests[i:j], levels, n[k] <= FAN**levels)[-1][0] for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
            arrays = [first.column(k).combine_chunks() for k in range(3)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(tops)], ["tree", "block", "n", "digest"])

    return mapped(nodes.select("tree", "block", "n", "digest"), reduce, "tree long, block long, n long, digest string")


def _in_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes (tree, place, n and more), each block in one partition, by place, written once."""
    return cut(nodes.withColumn("block", F.shiftright("place", BITS * levels)).repartition("tree", "block").sortWithinPartitions("tree", "place"))


def _finisher(levels: int, tops: dict[int, Levels], upper: Levels, upper_levels: int, with_path: bool):
    """f(rows of one block, path inside the block of its subroot) -> columns of SCHEMA, and the path."""

    def finish(tree: int, block: int, n: int, ids: pa.Array, own: list[str], seen: list[str | None], inner: Path) -> list[list]:
        inside = climbed(own, levels, n <= FAN**levels)
        above = path_of(tops[tree], block) if tree in tops else []
        subroot = tops[tree][-1][0] if tree in tops else inside[-1][0]
        suffix = above + inner + path_of(upper, tree >> BITS * upper_levels)
        root = upper[-1][0]
        proofs, roots, paths = [], [], []
        for begin in range(0, len(own), FAN):
            run = own[begin : begin + FAN]
            path = path_of(inside, begin)
            rest = path[1:] + suffix
            text, known = siblings(rest), {}
            for k in range(len(run)):
                first = [(k, run)] if path else []
                proofs.append(sha256((siblings(first) + text).encode()).hexdigest())
                node = folded(seen[begin + k] or run[k], first)
                if node not in known:
                    known[node] = folded(node, rest)  # equal nodes go on alike
                roots.append(known[node])
                if with_path:
                    paths.append([{"before": r[:i], "after": r[i + 1 :]} for i, r in first + rest])
        return [own, [subroot] * len(own), [root] * len(own), proofs, roots, [r == root for r in roots], *[paths] * with_path]

    return finish


def _batch(ids: pa.Array, columns: list[list], with_path: bool) -> pa.RecordBatch:
    run = pa.list_(pa.string())
    kinds = [pa.string()] * 5 + [pa.bool_()] + [pa.list_(pa.struct([("before", run), ("after", run)]))] * with_path
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *["path"] * with_path]
    return pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names)


def _chunk(ids: pa.ChunkedArray | pa.Array) -> pa.Array:
    return ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids


def _finished(leaves: DataFrame, finish, inner: DataFrame | None, with_path: bool) -> DataFrame:
    """SCHEMA from leaves in blocks; inner: (tree, block, path) with the runs inside the blocks of subroots, where there are such."""
    schema = SCHEMA + (f", {PATH}" if with_path else "")
    hexed = lambda values: [x and x.hex() for x in values]

    def block(rows: pa.Table, path: Path) -> pa.RecordBatch:
        tree, number, n = (rows.column(k)[0].as_py() for k in range(3))
        return _batch(_chunk(rows.column(5)), finish(tree, number, n, rows.column(5), hexed(rows.column(3).to_pylist()), hexed(rows.column(4).to_pylist()), path), with_path)

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends in whole_groups(batches):
            trees, numbers, n = (rows.column(k).to_pylist() for k in range(3))
            own, seen = hexed(rows.column(3).to_pylist()), hexed(rows.column(4).to_pylist())
            out: list[list] = [[] for _ in range(6 + with_path)]
            ids, begin = _chunk(rows.column(5)), 0
            for i, j in zip(ends[:-1], ends[1:], strict=True):
                for column, values in zip(out, finish(trees[i], numbers[i], n[i], ids, own[i:j], seen[i:j], []), strict=True):
                    column.extend(values)
                if j - begin > 10_000 or j == len(own):
                    yield _batch(ids.slice(begin, j - begin), out, with_path)
                    out, begin = [[] for _ in out], j

    columns = ["tree", "block", "n", "digest", "seen", "doc_id"]
    if inner is None:
        return mapped(leaves.select(*columns), many, schema)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pa.compute.sort_indices(left, [("place", "ascending")])).select(columns)
        return pa.Table.from_batches([block(left, [(x["k"], x["run"]) for x in right.column("path")[0].as_py()])])

    by = ["tree", "block"]
    return leaves.select(*columns, "place").groupBy(*by).cogroup(inner.groupBy(*by)).applyInArrow(both, schema)


def _inner_paths(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, path) of the sources whose subroots, in blocks, are nodes: the runs of each one's ancestors inside its block."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("k", pa.int32()), ("run", pa.list_(pa.string()))]))
        for rows, ends in whole_groups(batches):
            n, places, digests = rows.column(2).to_pylist(), rows.column(4).to_pylist(), [x.hex() for x in rows.column(3).to_pylist()]
            paths = []
            for i, j in zip(ends[:-1], ends[1:], strict=True):
                inside = climbed(digests[i:j], levels, n[i] <= FAN**levels)
                paths += [[{"k": k, "run": run} for k, run in path_of(inside, at)] for at in range(j - i)]
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(paths, kind)], ["source_tree", "path"])

    return mapped(nodes.select("tree", "block", "n", "digest", "place"), find, "source_tree long, path array<struct<k:int,run:array<string>>>")


def manifest(docs: DataFrame, seen: Column | None = None, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", source_col: str = "source", with_path: bool = False, top: int = TOP) -> DataFrame:
    """SCHEMA, a row for each row of docs: its leaf, subroot, the root, the hash of its proof, and whether what is there now folds to the root.

    seen: the digest (`leaf`) of what is there now, null where nothing changed.  with_path: also the proof itself, the siblings before and after by level,
    bottom up.  top: as TOP.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), leaf([F.col(c) for c in columns]).alias("digest"), (F.lit(None).cast("binary") if seen is None else seen).alias("seen"))
    placed = ranked(cut(rows), [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.col("digest")], name="at")
    placed = cut(placed)
    sources = cut(placed.groupBy("source").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    n_sources, total = sources.agg(F.count("*"), F.sum("n")).first()
    if not n_sources:
        return spark.createDataFrame([], SCHEMA + (f", {PATH}" if with_path else ""))
    numbered = ranked(sources, [F.asc_nulls_first("source")], name="tree", rows=n_sources).withColumn("tree", F.col("tree") - 1)
    numbered = numbered.select(F.col("source").alias("_source"), "first", "n", "tree")
    if n_sources <= BROADCAST_SOURCES:
        numbered = F.broadcast(numbered)
    levels = _needed(2 * total, LEAST_LEVELS, 2 * top)
    leaves = placed.join(numbered, F.col("source").eqNullSafe(F.col("_source"))).select("tree", (F.col("at") - F.col("first")).alias("place"), "n", "digest", "seen", "doc_id")
    leaves = _in_blocks(leaves, levels)
    blocks = cut(reduced(leaves, levels))
    # the tops of the sources of several blocks: no more than 2 * total / FAN ** levels nodes
    tops: dict[int, list[str]] = {}
    for r in blocks.filter(F.col("n") > FAN**levels).orderBy("tree", "block").collect():
        tops.setdefault(r["tree"], []).append(r["digest"])
    built = {tree: climbed(nodes) for tree, nodes in tops.items()}
    subroots = blocks.filter(F.col("n") <= FAN**levels).select("tree", "digest").union(spark.createDataFrame([(t, x[-1][0]) for t, x in built.items()], "tree long, digest string"))
    upper_levels = _needed(n_sources, 0, top)
    inner = None
    if not upper_levels:
        upper = climbed([r["digest"] for r in subroots.orderBy("tree").collect()])  # no more than `top` rows
    else:
        nodes = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(n_sources).cast("long").alias("n"), F.unhex("digest").alias("digest"))
        nodes = _in_blocks(nodes, upper_levels)
        upper = climbed([r["digest"] for r in reduced(nodes, upper_levels).orderBy("block").collect()])  # as many
        every = blocks.select("tree", "block")
        inner = _inner_paths(nodes, upper_levels).join(every, F.col("source_tree") == F.col("tree")).select("tree", "block", "path")
    shared = spark.sparkContext.broadcast((built, upper))

    def finish(*block) -> list[list]:
        tops_, upper_ = shared.value
        return _finisher(levels, tops_, upper_, upper_levels, with_path)(*block)

    return _finished(leaves, finish, inner, with_path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return manifest(docs, lowered(docs))


def _sql(levels: int = 5, upper: int = 3) -> str:
    """The manifest in DuckDB's SQL, for sources of up to FAN ** levels rows and up to FAN ** upper sources: one step for each level."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    row = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in COLUMNS) + ")"
    steps = [
        f"tab AS (SELECT {_CRC_TABLE} AS tab)",
        f"docs AS (SELECT *, {row('text')} AS leaf, {row('lower_text')} AS other, hex(doc_id::VARCHAR) AS x, tab"
        f" FROM (SELECT *, translate(text, '{UPPER}', '{LOWER}') AS lower_text FROM documents), tab)",
        f"base AS (SELECT doc_id, leaf, CASE WHEN {crc_sql('x')} % 5 = 0 THEN other ELSE leaf END AS seen, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,"
        " row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM docs)",
        "a0 AS (SELECT s, p, n, leaf AS h FROM base)",
    ]

    def climb(a: str, count: int) -> None:
        for k in range(count):
            steps.append(f"{a}r{k} AS (SELECT s, p // {FAN} AS p, any_value(n) AS n, list(h ORDER BY p) AS run FROM {a}{k} GROUP BY s, p // {FAN})")
            steps.append(f"{a}{k + 1} AS (SELECT s, p, (n + {FAN - 1}) // {FAN} AS n, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h FROM {a}r{k})")

    climb("a", levels)
    steps.append(f"b0 AS (SELECT 0 AS s, s AS p, count(*) OVER () AS n, h FROM a{levels})")
    climb("b", upper)
    before, text, fold, joins = "base", "''", "seen", ""
    for a, count, group, place in (("a", levels, "base.s", "base.p"), ("b", upper, "0", "base.s")):
        for k in range(count):
            r, at = f"{a}r{k}", f"({place} // {FAN**k} % {FAN})"
            joins += f" JOIN {r} ON {r}.s = {group} AND {r}.p = {place} // {FAN ** (k + 1)}"
            low, high = f"array_to_string({r}.run[1:{at}], '')", f"array_to_string({r}.run[{at} + 2:], '')"
            text += f" || CASE WHEN {r}.n > 1 THEN {low} || {high} ELSE '' END"
            steps.append(f"{a}f{k} AS (SELECT {before}.* {'REPLACE' if before != 'base' else ''} {'(' if before != 'base' else ','} CASE WHEN {r}.n > 1 THEN sha256({low} || {fold} || {high}) ELSE {fold} END AS folded{')' if before != 'base' else ''} FROM {before}{f' JOIN {r} ON {r}.s = {group} AND {r}.p = {place} // {FAN ** (k + 1)}'})".replace("base.", f"{before}."))
            before, fold = f"{a}f{k}", "folded"
    steps.append(f"proofs AS (SELECT base.doc_id, base.s, base.p, sha256({text}) AS proof_sha256 FROM base{joins})")
    last = f"b{upper}.h"
    return (
        f"WITH {', '.join(steps)} SELECT f.doc_id, f.leaf, a{levels}.h AS subroot, {last} AS root, proof_sha256, folded AS folded_root, folded = {last} AS verified"
        f" FROM {before} f JOIN proofs ON f.s = proofs.s AND f.p = proofs.p JOIN a{levels} ON f.s = a{levels}.s CROSS JOIN b{upper}"
    )


SQL = _sql()
