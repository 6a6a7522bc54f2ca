"""Copied regions inside an image: blocks that look alike, shifts that many of them share, and pixels that agree in content and noise.

Overlapping blocks are described by their low cosine coefficients, in coarse steps. Blocks
of one description are compared with the next few of it in page order, so a texture that
fills the page gives each block a few partners and no more. Blocks without structure are
left out before. Matches vote for their shift; the pairs of a shift with enough votes are
confirmed by their pixels, which are fetched for these pairs only.

Images are cut into tiles that overlap by what a block or window reaches over the border,
so a task holds a tile and not an image.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vettra.functions import fixed

#: Side of a described block, coefficients of each axis, their step, and the least deviation of a block with structure.
BLOCK, COEFFICIENTS, STEP, STRUCTURE = 16, 3, 8.0, 4.0
TILE = 128


def tiled(pixels: DataFrame, key: str, side: int, reach: int) -> DataFrame:
    """Pixels with each tile (ty, tx) that has them, in itself or in the `reach` rows and columns behind its end."""
    places = lambda c: F.filter(F.array(F.floor(F.col(c) / side).cast("int"), F.when(F.col(c) % side < reach, F.floor(F.col(c) / side).cast("int") - 1)), lambda t: t.isNotNull() & (t >= 0))
    return pixels.withColumn("ty", F.explode(places("y"))).withColumn("tx", F.explode(places("x"))).select(key, "ty", "tx", "y", "x", "v")


def raster(tile: pa.Table) -> tuple[np.ndarray, int, int]:
    """(array, top, left) of a tile's pixels; nan where there are none."""
    y, x, v = (tile[c].to_numpy() for c in ("y", "x", "v"))
    top, left = int(y.min()), int(x.min())
    out = np.full((int(y.max()) - top + 1, int(x.max()) - left + 1), np.nan)
    out[y - top, x - left] = v
    return out, top, left


def cosine_basis(block: int, n: int) -> np.ndarray:
    """n * n basis images of the orthonormal cosine transform, the lowest frequencies of each axis."""
    k, i = np.arange(n)[:, None], np.arange(block)[None, :]
    one = np.cos(np.pi * (2 * i + 1) * k / (2 * block)) * np.where(k == 0, np.sqrt(1 / block), np.sqrt(2 / block))
    return np.einsum("ui,vj->uvij", one, one).reshape(n * n, block, block)


def descriptions(pixels: DataFrame, key: str, block: int = BLOCK, step: float = STEP, structure: float = STRUCTURE, side: int = TILE) -> DataFrame:
    """(key, y, x, band, code): the quantised coefficients of every block with structure, in two bands half a step apart."""
    kind = dict(pixels.dtypes)[key]
    basis = cosine_basis(block, COEFFICIENTS)

    def describe(group: tuple, tile: pa.Table) -> pa.Table:
        k, ty, tx = group
        image, top, left = raster(tile)
        schema = pa.schema([(key, tile.schema.field(key).type), ("y", pa.int32()), ("x", pa.int32()), ("band", pa.int32()), ("code", pa.list_(pa.int32()))])
        if min(image.shape) < block:
            return schema.empty_table()
        blocks = np.lib.stride_tricks.sliding_window_view(image, (block, block))
        inside = blocks[: max(0, (ty.as_py() + 1) * side - top), : max(0, (tx.as_py() + 1) * side - left)]  # blocks that begin in the tile itself
        deviation = inside.std(axis=(2, 3))
        y, x = np.nonzero(deviation >= structure)  # not where pixels are missing: nan
        found = np.einsum("nij,kij->nk", inside[y, x], basis) / step
        codes = np.concatenate([np.floor(found), np.floor(found + 0.5)]).astype(np.int32)
        n = len(y)
        return pa.table([pa.array([k.as_py()] * (2 * n), schema[0].type), pa.array(np.tile(y + top, 2), pa.int32()), pa.array(np.tile(x + left, 2), pa.int32()), pa.array(np.repeat([0, 1], n), pa.int32()), pa.array(list(codes), pa.list_(pa.int32()))], schema=schema)

    return tiled(pixels, key, side, block - 1).groupBy(key, "ty", "tx").applyInArrow(describe, f"{key} {kind}, y int, x int, band int, code array<int>")


def matches(described: DataFrame, key: str, neighbours: int = fixed.CLONE_NEIGHBOURS, least: float = fixed.CLONE_SHIFT) -> DataFrame:
    """(key, y1, x1, y2, x2) of blocks with one description, each with the next few in page order, at least so far apart."""
    w = Window.partitionBy(key, "band", "code").orderBy("y", "x")
    after = F.array(*(F.lead(F.struct("y", "x"), i).over(w) for i in range(1, neighbours + 1)))
    pairs = described.withColumn("after", after).select(key, F.col("y").alias("y1"), F.col("x").alias("x1"), F.explode(F.array_compact("after")).alias("o"))
    far = F.hypot(F.col("o.y") - F.col("y1"), F.col("o.x") - F.col("x1")) >= least
    return pairs.where(far).select(key, "y1", "x1", F.col("o.y").alias("y2"), F.col("o.x").alias("x2")).distinct()


def voted(pairs: DataFrame, key: str, least: int = fixed.CLONE_MATCHES, coarse: float = 8.0) -> DataFrame:
    """The pairs whose shift, in steps of `coarse`, enough pairs of the image share, with that shift (sy, sx)."""
    shifted = pairs.withColumns({"sy": F.round((F.col("y2") - F.col("y1")) / coarse).cast("int"), "sx": F.round((F.col("x2") - F.col("x1")) / coarse).cast("int")})
    shifts = shifted.groupBy(key, "sy", "sx").agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= least)
    return shifted.join(shifts.drop("votes"), [key, "sy", "sx"])


def edge_preserving(images: np.ndarray, radius: int = 2, near: float = 5.0, similar: float = 40.0) -> np.ndarray:
    """Bilateral filter of a stack of images: means over a disc, weighted by distance and by likeness to the centre."""
    n, h, w = images.shape
    padded = np.pad(images, ((0, 0), (radius, radius), (radius, radius)), mode="edge")
    total, weight = np.zeros_like(images), np.zeros_like(images)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if dy * dy + dx * dx <= radius * radius:
                other = padded[:, radius + dy : radius + dy + h, radius + dx : radius + dx + w]
                share = np.exp(-(dy * dy + dx * dx) / (2 * near * near) - (other - images) ** 2 / (2 * similar * similar))
                total, weight = total + share * other, weight + share
    return total / weight


def windows(points: DataFrame, pixels: DataFrame, key: str, reach: int, side: int = TILE) -> DataFrame:
    """(key, y, x, content, noise): the square of 2 * reach pixels around each point, and what an edge-preserving filter takes from it.

    Points whose square leaves the image have none.
    """
    kind = dict(pixels.dtypes)[key]
    place = lambda c: F.floor(F.greatest(F.col(c) - reach, F.lit(0)) / side).cast("int")
    at = points.select(key, "y", "x", place("y").alias("ty"), place("x").alias("tx"))

    def cut(asked: pa.Table, tile: pa.Table) -> pa.Table:
        schema = pa.schema([(key, asked.schema.field(key).type), ("y", pa.int32()), ("x", pa.int32()), ("content", pa.list_(pa.float64())), ("noise", pa.list_(pa.float64()))])
        if not asked.num_rows or not tile.num_rows:
            return schema.empty_table()
        image, top, left = raster(tile)
        y, x = (asked[c].to_numpy() - d - reach for c, d in (("y", top), ("x", left)))
        fits = (y >= 0) & (x >= 0) & (y + 2 * reach <= image.shape[0]) & (x + 2 * reach <= image.shape[1])
        asked, y, x = asked.filter(pa.array(fits)), y[fits], x[fits]
        if not len(y):
            return schema.empty_table()
        content = np.lib.stride_tricks.sliding_window_view(image, (2 * reach, 2 * reach))[y, x]
        flat = lambda a: pa.array(list(a.reshape(len(a), -1)), pa.list_(pa.float64()))
        return pa.table([asked[key], asked["y"].cast(pa.int32()), asked["x"].cast(pa.int32()), flat(content), flat(content - edge_preserving(content))], schema=schema)

    tiles = tiled(pixels, key, side, 2 * reach - 1)
    return at.groupBy(key, "ty", "tx").cogroup(tiles.groupBy(key, "ty", "tx")).applyInArrow(cut, f"{key} {kind}, y int, x int, content array<double>, noise array<double>")


def correlations(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    p, q = np.array(a.tolist()), np.array(b.tolist())
    p, q = p - p.mean(axis=1, keepdims=True), q - q.mean(axis=1, keepdims=True)
    return pd.Series((p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)) + 1e-6))


def alike(a: str, b: str) -> Column:
    """Normalised cross-correlation of two arrays."""
    return F.pandas_udf(correlations, "double")(a, b)


def confirmed(pairs: DataFrame, pixels: DataFrame, key: str, block: int, content: float, noise: float, reach: int, side: int) -> DataFrame:
    """The pairs around whose centres both the content and the noise correlate."""
    centred = pairs.withColumns({f"c{c}{i}": F.col(f"{c}{i}") + block // 2 for c in "yx" for i in (1, 2)})
    points = centred.select(key, F.col("cy1").alias("y"), F.col("cx1").alias("x")).union(centred.select(key, "cy2", "cx2")).distinct()
    found = windows(points, pixels, key, reach, side)
    of = lambda i: found.select(key, F.col("y").alias(f"cy{i}"), F.col("x").alias(f"cx{i}"), F.col("content").alias(f"p{i}"), F.col("noise").alias(f"q{i}"))
    both = centred.join(of(1), [key, "cy1", "cx1"]).join(of(2), [key, "cy2", "cx2"])
    return both.where((alike("p1", "p2") >= content) & (alike("q1", "q2") >= noise)).select(pairs.columns)


def copied_regions(
    pixels: DataFrame, key: str, block: int = BLOCK, step: float = STEP, structure: float = STRUCTURE, neighbours: int = fixed.CLONE_NEIGHBOURS, shift: float = fixed.CLONE_SHIFT, least: int = fixed.CLONE_MATCHES,
    content: float = fixed.CLONE_CONTENT, noise: float = fixed.CLONE_NOISE, reach: int = fixed.CLONE_REACH, most: float = fixed.CLONE_MOST, side: int = TILE,
) -> DataFrame:
    """(key, sy, sx, n, box of the copy, strength) of pixel rows (key, y, x, v): compact groups of confirmed pairs of one shift.

    Groups that spread over more than `most` of the image, on either end, are repeated text and no copies.
    """
    pairs = voted(matches(descriptions(pixels, key, block, step, structure, side), key, neighbours, shift), key, least)
    sure = confirmed(pairs, pixels, key, block, content, noise, reach, side)
    ends = [f(c).alias(n) for n, f, c in ((f"{a}{c}{i}", f, f"{c}{i}") for a, f in (("lo_", F.min), ("hi_", F.max)) for c in "yx" for i in (1, 2))]
    size = pixels.groupBy(key).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    group = sure.groupBy(key, "sy", "sx").agg(F.count(F.lit(1)).alias("n"), *ends).where(F.col("n") >= least).join(size, key)
    area = lambda i: (F.col(f"hi_y{i}") - F.col(f"lo_y{i}")) * (F.col(f"hi_x{i}") - F.col(f"lo_x{i}"))
    compact = group.where((area(1) <= most * F.col("h") * F.col("w")) & (area(2) <= most * F.col("h") * F.col("w")))
    return compact.select(
        key, "sy", "sx", "n", F.col("lo_y2").alias("y0"), F.col("lo_x2").alias("x0"), F.least(F.col("hi_y2") + block, "h").alias("y1"), F.least(F.col("hi_x2") + block, "w").alias("x1"),
        F.round(F.least(F.lit(1.0), F.col("n") / (3 * least)), 3).alias("strength"),
    )
