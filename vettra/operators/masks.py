"""Learned masks in overlapping tiles: blended pixels, and regions that are connected over the seams.

Regions are labelled block by block. Only the marked pixels at the blocks' borders meet,
and the labels that touch there form a graph whose components name the regions; so an
image of any size is spread over tasks, and the result is that of labelling it whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vettra.functions import fixed
from vettra.operators import grids, linkage


def tile_starts(size: int, side: int = fixed.TILE_SIDE, stride: float = fixed.TILE_STRIDE) -> list[int]:
    """Where tiles begin along an axis: every stride, and one that ends with the image."""
    starts = list(range(0, max(1, size - side + 1), int(side * stride)))
    return starts if starts[-1] == max(0, size - side) else [*starts, max(0, size - side)]


def blended(tiles: DataFrame, key: str, gate: float = fixed.TILE_GATE) -> DataFrame:
    """(key, y, x, p): the mean over all tiles that cover a pixel; tiles whose class probability is below the gate count as zero.

    tiles: (key, y0, x0, width, certainty, mask), masks row by row.
    """
    shown = F.when(F.col("certainty") >= gate, F.col("p")).otherwise(0.0)
    points = tiles.select(key, "y0", "x0", "width", "certainty", F.posexplode("mask").alias("i", "p"))
    at = points.select(key, (F.col("y0") + F.floor(F.col("i") / F.col("width"))).cast("int").alias("y"), (F.col("x0") + F.col("i") % F.col("width")).cast("int").alias("x"), shown.alias("p"))
    return at.groupBy(key, "y", "x").agg(F.avg("p").alias("p"))


def block_labels(marked: DataFrame, key: str, side: int) -> DataFrame:
    """marked pixels (key, y, x, p) with the least (y, x) of their 8-connected group within their block."""
    placed = marked.withColumns({"by": F.floor(F.col("y") / side).cast("int"), "bx": F.floor(F.col("x") / side).cast("int")})

    def label(block: pd.DataFrame) -> pd.DataFrame:
        y, x = block["y"].to_numpy(np.int64), block["x"].to_numpy(np.int64)
        root = grids.label_cells(np.zeros(len(block), np.int64), y, x, diagonal=True)
        return block.assign(root_y=y[root], root_x=x[root])

    return placed.groupBy(key, "by", "bx").applyInPandas(label, f"{key} {dict(marked.dtypes)[key]}, y int, x int, p double, by int, bx int, root_y int, root_x int")


def seams(labelled: DataFrame, key: str, side: int) -> DataFrame:
    """(key, a, b): labels of different blocks that touch, from pixels at the blocks' borders."""
    edge = lambda c: (F.col(c) % side == 0) | (F.col(c) % side == side - 1)
    border = labelled.where(edge("y") | edge("x"))
    label = F.struct("root_y", "root_x")
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))))
    around = border.select(key, "by", "bx", label.alias("a"), "y", "x", F.explode(steps).alias("s")).select(key, "by", "bx", "a", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    other = border.select(key, "y", "x", F.col("by").alias("by2"), F.col("bx").alias("bx2"), label.alias("b"))
    return around.join(other, [key, "y", "x"]).where((F.col("by") != F.col("by2")) | (F.col("bx") != F.col("bx2"))).select(key, "a", "b").distinct()


def mask_regions(points: DataFrame, key: str, at: float = fixed.MASK_AT, least: int = fixed.MASK_AREA, side: int = 256) -> DataFrame:
    """(key, root_y, root_x, n, box, mean): 8-connected groups of at least `least` pixels of (key, y, x, p) with p from `at` on."""
    labelled = linkage.stored(block_labels(points.where(F.col("p") >= at).select(key, "y", "x", "p"), key, side), "labels")
    local = labelled.groupBy(key, "root_y", "root_x").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"), F.sum("p").alias("total"))
    names = linkage.least_reachable(seams(labelled, key, side).select(F.struct(key, "a.*").alias("a"), F.struct(key, "b.*").alias("b")))
    own = F.struct(key, "root_y", "root_x")
    named = local.withColumn("node", own).join(names, "node", "left").withColumn("root", F.coalesce("least", "node"))
    found = named.groupBy("root").agg(F.sum("n").alias("n"), F.min("y0").alias("y0"), F.min("x0").alias("x0"), F.max("y1").alias("y1"), F.max("x1").alias("x1"), F.sum("total").alias("total"))
    return found.where(F.col("n") >= least).select("root.*", "n", "y0", "x0", "y1", "x1", (F.col("total") / F.col("n")).alias("mean"))

