"""Layouts of images in grids, boxes round items, and the order in which people read them."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Aspect ratios that cells of a sheet usually have.
RATIOS = [16 / 9, 4 / 3, 3 / 2, 1.85, 2.39, 1.0, 9 / 16, 3 / 4, 2 / 3]
#: Weights of a layout's score, and its most rows and columns.
WEIGHTS, MOST = {"cell": 0.45, "shape": 0.25, "cells": 0.15, "symmetry": 0.15}, 6
#: Space round a box, and how far down a row of reading reaches.
PAD, BAND = 20.0, 50.0


def _off(a: Column, b: Column | float) -> Column:
    """How far two ratios are apart, 0 where they are equal."""
    return F.greatest(a / b, b / a) - 1


def _score(w: Column, h: Column, rows: Column, cols: Column) -> Column:
    r, c = rows.cast("double"), cols.cast("double")
    cell = (w / c) / (h / r)
    best = reduce(lambda a, b: F.least(a, b), [_off(cell, F.lit(x)) for x in RATIOS])
    parts = {"cell": F.exp(best * -3), "shape": F.exp(_off(w / h, c / r) * -2), "cells": F.least(r * c / 6, F.lit(1.0)), "symmetry": 1 - F.abs(r - c) / F.greatest(r, c)}
    return sum(parts[k] * w for k, w in WEIGHTS.items())


def layout_scores(sizes: DataFrame, key: str, width: str, height: str) -> DataFrame:
    """(key, rows, cols, score) of all grids of up to MOST rows and columns, but for a single cell."""
    n = F.sequence(F.lit(1), F.lit(MOST))
    grids = sizes.select(key, F.col(width).cast("double").alias("_w"), F.col(height).cast("double").alias("_h"), F.explode(n).alias("rows")).withColumn("cols", F.explode(n)).where("rows > 1 or cols > 1")
    return grids.select(key, "rows", "cols", _score(F.col("_w"), F.col("_h"), F.col("rows"), F.col("cols")).alias("score"))


def rank_layouts(sizes: DataFrame, key: str, width: str, height: str, k: int = 8) -> DataFrame:
    """The k best layouts of each image, a row of ``sizes``; among equals fewer rows, then fewer columns first. All grids of an image are ranked in its row, without a sort over images."""
    grids = F.array(*[F.struct(F.lit(r).alias("rows"), F.lit(c).alias("cols")) for r in range(1, MOST + 1) for c in range(1, MOST + 1) if r > 1 or c > 1])
    w, h = F.col(width).cast("double"), F.col(height).cast("double")
    ranked = F.array_sort(F.transform(grids, lambda g: F.struct((-_score(w, h, g["rows"], g["cols"])).alias("less"), g["rows"].alias("rows"), g["cols"].alias("cols"))))
    return sizes.select(key, F.posexplode(F.slice(ranked, 1, k)).alias("_n", "_g")).select(key, F.col("_g.rows").alias("rows"), F.col("_g.cols").alias("cols"), (-F.col("_g.less")).alias("score"), (F.col("_n") + 1).alias("place"))


def grid_cells(sizes: DataFrame, key: str, width: str, height: str, rows: int, cols: int) -> DataFrame:
    """(key, row, col, x, y, width, height) of the cells of one grid, in whole pixels."""
    cell = lambda c, n: F.col(c).cast("double") / n
    near = lambda x: F.floor(x + 0.5)
    out = sizes.select(key, F.col(width), F.col(height), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    return out.select(key, "row", "col", near(F.col("col") * cell(width, cols)).alias("x"), near(F.col("row") * cell(height, rows)).alias("y"), near(cell(width, cols)).alias("width"), near(cell(height, rows)).alias("height"))


def bounding_box(items: DataFrame, key: list[str], x: str, y: str, widths: list[str], heights: list[str], pad: float = PAD, default: tuple[float, float] = (300.0, 280.0)) -> DataFrame:
    """(key, x, y, width, height) of the box round each key's items; an item's size is the first of several columns that is neither null nor 0."""
    size = lambda cs, d: F.coalesce(*[F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in cs], F.lit(d))
    left, top, right, low = F.min(x), F.min(y), F.max(F.col(x) + size(widths, default[0])), F.max(F.col(y) + size(heights, default[1]))
    return items.groupBy(*key).agg((left - pad).alias("x"), (top - pad).alias("y"), (right - left + 2 * pad).alias("width"), (low - top + 2 * pad).alias("height"))


def reading_order(nodes: DataFrame, key: str, x: str, y: str, tie: str, band: float = BAND) -> DataFrame:
    """``place`` of each node: rows from above, each beginning at its uppermost node and ``band`` high, then from the left.

    Where a row begins depends on the row before, so a key's distinct heights, not its nodes, pass one
    fold; the heights of one key must fit a task.
    """
    heights = nodes.where(F.col(y).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(F.col(y).cast("double"))).alias("ys"))

    def fold(batches):
        for batch in batches:
            keys, starts = batch.column(0), []
            for ys in batch.column(1).to_pylist():
                start, out = None, []
                for v in ys:
                    start = v if start is None or v - start > band else start
                    out.append({"y": v, "start": start})
                starts.append(out)
            yield pa.RecordBatch.from_arrays([keys, pa.array(starts, pa.list_(pa.struct([("y", pa.float64()), ("start", pa.float64())])))], ["_key", "rows"])

    kind = nodes.schema[key].dataType.simpleString()
    rows = heights.mapInArrow(fold, f"_key {kind}, rows array<struct<y:double,start:double>>").select(F.col("_key").alias(key), F.inline("rows").alias("_y", "_row"))
    placed = nodes.withColumn("_y", F.col(y).cast("double")).join(rows, [key, "_y"], "left")
    w = Window.partitionBy(key).orderBy(F.col("_row").asc_nulls_last(), x, tie)
    return placed.withColumn("place", F.row_number().over(w)).drop("_y", "_row")
