"""Text tables from drawn pages: ruled lines, cells and runs of characters, as windows over positions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placemill.functions import text

RUN_GAP, RUN_DRIFT = 0.6, 1.2


def merged_positions(values: DataFrame, keys: list[str], column: str, tolerance: float) -> DataFrame:
    """(keys, position, n): the mean of each chain of values whose neighbours are at most the tolerance apart."""
    order = Window.partitionBy(*keys).orderBy(column)
    begins = F.coalesce((F.col(column) - F.lag(column).over(order) > tolerance).cast("int"), F.lit(1))
    chain = F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return values.withColumn("_begins", begins).withColumn("_chain", chain).groupBy(*keys, "_chain").agg(F.avg(column).alias("position"), F.count("*").alias("n")).drop("_chain")


def bounds(positions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slot, low, high): the spaces between neighbouring positions, from 0."""
    order = Window.partitionBy(*keys).orderBy("position")
    spaced = positions.withColumns({"low": F.col("position"), "high": F.lead("position").over(order), "slot": F.row_number().over(order) - 1})
    return spaced.filter("high IS NOT NULL").select(*keys, "slot", "low", "high")


def bucket(value: Column, edges: Column) -> Column:
    """The place of the half-open space among sorted edges that holds a value; null outside."""
    below = F.size(F.filter(edges, lambda e: e <= value))
    return F.when((below > 0) & (below < F.size(edges)), below - 1)


def column_bounds(verticals: DataFrame, widths: DataFrame, margin: float = 40.0, columns: int = 4) -> DataFrame:
    """(page, slot, low, high) of the leftmost columns between ruled lines (page, position), of pages (page, width) that have as many lines before the margin notes; other pages have none."""
    inside = verticals.join(widths, "page").filter(F.col("position") < F.col("width") - margin)
    ranked = inside.withColumns({"_n": F.row_number().over(Window.partitionBy("page").orderBy("position")), "_all": F.count("*").over(Window.partitionBy("page"))})
    return bounds(ranked.filter((F.col("_n") <= columns + 1) & (F.col("_all") > columns)).select("page", "position"), ["page"])


def row_bounds(horizontals: DataFrame, baselines: DataFrame) -> DataFrame:
    """(page, slot, low, high) between ruled lines (page, position) where a page has three of them; else cuts midway between the lines of text (page, position)."""
    ruled = horizontals.withColumn("_n", F.count("*").over(Window.partitionBy("page"))).filter("_n >= 3").select("page", "position")
    order = Window.partitionBy("page").orderBy("position")
    ahead, first = F.lead("position").over(order), F.lag("position").over(order).isNull()
    drawn = baselines.join(ruled.select("page").distinct(), "page", "left_anti").withColumns({"_next": ahead, "_first": first})
    below = F.when(F.col("_next").isNull(), F.col("position") + 12.0).otherwise((F.col("position") + F.col("_next")) / 2)
    cuts = drawn.select("page", F.explode(F.when(F.col("_first"), F.array(F.col("position") - 6.0, below)).otherwise(F.array(below))).alias("position"))
    return bounds(ruled.unionByName(cuts), ["page"])


def runs(chars: DataFrame) -> DataFrame:
    """(page, run, text, x0, x1, top, bottom): characters that were drawn one after the other, as one run in reading order; runs of blanks are left out.

    chars has page, seq, text, x0, x1, top and bottom.  A run goes on while a character begins where the run so far ends (its largest x1) and lies on the
    line of its first one.  Pages are read as streams in the order of their characters, with one run's numbers as all that is held.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, run, top, end = None, 0, 0.0, 0.0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["page"] != page:
                    page, run, going = r["page"], 0, False
                else:
                    going = abs(r["x0"] - end) <= RUN_GAP and abs(r["top"] - top) <= RUN_DRIFT
                run, top, end = (run, top, max(end, r["x1"])) if going else (run + 1, r["top"], r["x1"])
                out.append(run)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "run"])

    own = chars.select(F.col("page").cast("long").alias("page"), F.col("seq").cast("long").alias("seq"), "text", *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "top", "bottom")])
    schema = "page long, seq long, text string, x0 double, x1 double, top double, bottom double, run long"
    numbered = own.repartition("page").sortWithinPartitions("page", "seq").mapInArrow(number, schema)
    letters = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda c: c["text"]), "")
    first = lambda c: F.min_by(c, "seq").alias(c)
    out = numbered.groupBy("page", "run").agg(letters.alias("drawn"), first("x0"), F.max("x1").alias("x1"), first("top"), F.max("bottom").alias("bottom"))
    out = out.withColumn("_words", F.filter(F.split("drawn", r"\s+"), lambda w: w != "")).filter(F.size("_words") > 0)
    return out.withColumn("text", text.order_run(F.col("_words"))).drop("drawn", "_words")


def cells(found: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(page, row, column, text): the runs in each cell of the grid, lines from the top, each from the right.

    rows and columns are `bounds` by page; a page has a bounded grid, so the range joins are on the page.
    """
    grid = F.sort_array(F.collect_list(F.struct("slot", "low", "high")))
    grids = rows.groupBy("page").agg(grid.alias("r")).join(columns.groupBy("page").agg(grid.alias("c")), "page")
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    inside = found.join(grids, "page").withColumn("row", F.try_element_at(F.filter("r", lambda s: (s["low"] <= middle("top", "bottom")) & (middle("top", "bottom") < s["high"])), F.lit(1))["slot"])
    inside = inside.withColumn("column", F.try_element_at(F.filter("c", lambda s: (s["low"] <= middle("x0", "x1")) & (middle("x0", "x1") < s["high"])), F.lit(1))["slot"])
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.round("top", 0).alias("line"), (-F.col("x1")).alias("from"), "text"))), lambda x: x["text"]), " ")
    return inside.filter("row IS NOT NULL AND column IS NOT NULL").groupBy("page", "row", "column").agg(joined.alias("text")).withColumn("text", text.squash(F.col("text")))
