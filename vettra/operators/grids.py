"""Block grids of images: robust outliers, connected cells, boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells(vectors: DataFrame, key: str, vector: str, side: int) -> DataFrame:
    """(key, gy, gx, v): a vector of side * side values as a grid."""
    return vectors.select(key, F.posexplode(vector).alias("i", "v")).select(key, F.floor(F.col("i") / side).cast("int").alias("gy"), (F.col("i") % side).alias("gx"), F.col("v").cast("double").alias("v"))


def outliers(grid: DataFrame, key: str, factor: float = 6.0) -> DataFrame:
    """Cells above median + factor * 1.4826 * (MAD + 1e-6) of their image."""
    mid = grid.groupBy(key).agg(F.median("v").alias("med"))
    with_mid = grid.join(mid, key)
    mad = with_mid.groupBy(key).agg(F.median(F.abs(F.col("v") - F.col("med"))).alias("mad"))
    return with_mid.join(mad, key).where(F.col("v") > F.col("med") + factor * 1.4826 * (F.col("mad") + 1e-6)).select(key, "gy", "gx", "v")


def label_cells(image: np.ndarray, y: np.ndarray, x: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """For each distinct cell (image, y, x), the number of the least cell of its 4-connected group (8-connected with `diagonal`), in order of (image, y, x)."""
    order = np.lexsort((x, y, image))
    image, y, x = image[order], y[order], x[order]
    root = np.arange(len(order))
    right = np.flatnonzero((image[1:] == image[:-1]) & (y[1:] == y[:-1]) & (x[1:] == x[:-1] + 1))
    width = int(x.max() - x.min() + 3) if len(x) else 1
    code = (image.astype(np.int64) * (int(y.max() - y.min() + 3) if len(y) else 1) + (y - y.min() if len(y) else y)) * width + (x - x.min() if len(x) else x)
    a, b = [right], [right + 1]
    for step in (width, width - 1, width + 1) if diagonal else (width,):  # down, and down to either side
        below = np.searchsorted(code, code + step)
        down = np.flatnonzero((below < len(code)) & (code[np.minimum(below, len(code) - 1)] == code + step)) if len(code) else right
        a, b = [*a, down], [*b, below[down]]
    a, b = np.concatenate(a), np.concatenate(b)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    out = np.empty(len(order), np.int64)
    out[order] = order[root]
    return out


def labelled(marked: DataFrame, key: str) -> DataFrame:
    """(key, gy, gx, root_y, root_x): each marked cell with the least (gy, gx) of its 4-connected group; images are labelled many at a time."""
    images = marked.groupBy(key).agg(F.collect_set(F.struct("gy", "gx")).alias("cells"))  # a grid's cells

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            counts = rows["cells"].map(len).to_numpy(np.int64)
            flat = [c for cells in rows["cells"] for c in cells]
            y, x = np.array([c["gy"] for c in flat], np.int64), np.array([c["gx"] for c in flat], np.int64)
            root = label_cells(np.repeat(np.arange(len(rows)), counts), y, x)
            yield pd.DataFrame({key: np.repeat(rows[key].to_numpy(), counts), "gy": y, "gx": x, "root_y": y[root], "root_x": x[root]})

    return images.mapInPandas(label, f"{key} {dict(marked.dtypes)[key]}, gy int, gx int, root_y int, root_x int")


def box() -> list[Column]:
    """The bounding box of a group of cells, as aggregates."""
    return [f(c).alias(n) for n, f, c in (("y0", F.min, "gy"), ("x0", F.min, "gx"), ("y1", F.max, "gy"), ("x1", F.max, "gx"))]


def components(marked: DataFrame, key: str) -> DataFrame:
    """(key, root, n, box): 4-connected groups of marked cells of each image, named by their least (gy, gx)."""
    return labelled(marked, key).groupBy(key, "root_y", "root_x").agg(F.count(F.lit(1)).cast("int").alias("n"), *box())


def peaks(cells: DataFrame, key: str, reach: int, least: float) -> DataFrame:
    """(key, place, gy, gx, v): cells of at least `least` that no cell within `reach` rows and columns exceeds, numbered from the highest.

    Of equal neighbours the first by (gy, gx) stands. cells: (key, gy, gx, v); missing cells hide nothing.
    """
    rank = F.struct("v", (-F.col("gy")).alias("y"), (-F.col("gx")).alias("x"))
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    around = cells.select(key, "gy", "gx", rank.alias("r"), F.explode(steps).alias("dy")).select(key, "gy", "gx", "r", "dy", F.explode(steps).alias("dx"))
    seen = around.groupBy(key, (F.col("gy") + F.col("dy")).alias("gy"), (F.col("gx") + F.col("dx")).alias("gx")).agg(F.max("r").alias("top"))
    top = cells.join(seen, [key, "gy", "gx"]).where((rank == F.col("top")) & (F.col("v") >= least))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("v"), "gy", "gx"))
    return top.select(key, place.alias("place"), "gy", "gx", "v")


def spectrum_peaks(signals: DataFrame, key: str, values: str, limit: int = 28, window: int = 2) -> DataFrame:
    """(key, place, bin, level): peaks of a windowed log spectrum, each hiding its neighbours."""

    def peaks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for k, v in zip(rows[key], rows[values], strict=True):
                x = np.asarray(v, float)
                level = 20 * np.log10(np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x)))) + 1e-9)
                level[:window] = -np.inf
                for place in range(min(limit, len(level))):
                    at = int(level.argmax())
                    if not np.isfinite(level[at]):
                        break
                    out.append((k, place, at, float(level[at])))
                    level[max(0, at - window) : at + window + 1] = -np.inf
            yield pd.DataFrame(out, columns=[key, "place", "bin", "level"])

    return signals.select(key, values).mapInPandas(peaks, f"{key} {dict(signals.dtypes)[key]}, place int, bin int, level double")
