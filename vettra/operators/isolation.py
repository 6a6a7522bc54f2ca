"""Isolation forest on executors: a subsample for each tree by hash, one group a tree, trees as node rows.

Nothing but the finished nodes, whose number is bounded by trees and subsample, comes to
the driver, from where it is broadcast for scoring.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, TREES, CONTAMINATION = 256, 200, 0.05
NODES = "tree int, node int, feature int, at double, below int, above int, path double"
#: Nodes that may be broadcast: about 50 MB of them.
MOST_NODES = 1_000_000
#: Hashes are drawn below this.
SPACE = 2**31


def mean_path(n: float) -> float:
    """The mean path of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def subsamples(rows: DataFrame, key: str, trees: int, sample: int, seed: int) -> DataFrame:
    """Each row with every tree (and its draw there) whose threshold its hash falls below: half as many again as a tree needs."""
    n = rows.count()
    bound = SPACE if n <= 2 * sample else int(SPACE * min(1.0, (1.5 * sample + 50) / n))
    draw = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, key), F.lit(SPACE))
    drawn = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), draw(t).alias("draw"))), lambda s: s["draw"] < bound)
    return rows.select("*", F.explode(drawn).alias("s")).select("*", "s.tree", "s.draw").drop("s")


def grown(x: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple]:
    """(node, feature, at, below, above, path) of a tree over the rows x, the root first; leaves have a path only."""
    nodes: list[tuple] = []

    def grow(rows: np.ndarray, d: int) -> int:
        me = len(nodes)
        nodes.append((me, None, None, None, None, d + mean_path(len(rows))))
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        if d < depth and len(rows) > 1 and (low < high).any():
            c = int(rng.choice(np.flatnonzero(low < high)))
            at = float(rng.uniform(low[c], high[c]))
            left = rows[:, c] < at
            nodes[me] = (me, c, at, grow(rows[left], d + 1), grow(rows[~left], d + 1), None)
        return me

    grow(x, 0)
    return nodes


def fitted(rows: DataFrame, key: str, columns: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """The trees' nodes (NODES), each tree grown on `sample` rows at most, in a group of its own; rows with nulls are left out."""
    kept = rows.select(key, *(F.col(c).cast("double").alias(c) for c in columns)).dropna()

    def grow(tree: pd.DataFrame) -> pd.DataFrame:
        number = int(tree["tree"].iloc[0])
        own = tree.sort_values(["draw", key]).head(sample)[columns].to_numpy(float)
        depth = math.ceil(math.log2(max(2, len(own))))
        out = pd.DataFrame(grown(own, np.random.default_rng([seed, number]), depth), columns=["node", "feature", "at", "below", "above", "path"])
        out = out.astype({c: "Int32" for c in ("feature", "below", "above")})
        out.insert(0, "tree", number)
        return out

    return subsamples(kept, key, trees, sample, seed).groupBy("tree").applyInPandas(grow, NODES)


def scored(df: DataFrame, key: str, columns: list[str], nodes: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(key, score): 2 to the power of minus the mean path over the mean path of a subsample; null without trees or with null features."""
    found = nodes.limit(MOST_NODES + 1).collect()
    if len(found) > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes: fit fewer trees or smaller samples")
    forest: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r.tree, r.node)):
        forest.setdefault(r.tree, []).append(r)
    arrays = [tuple(np.array([getattr(r, c) if getattr(r, c) is not None else -1 for r in tree]) for c in ("feature", "at", "below", "above", "path")) for tree in forest.values()]
    shared = df.sparkSession.sparkContext.broadcast(arrays)
    normal = mean_path(sample) or 1.0

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x, total = part[columns].to_numpy(float), np.zeros(len(part))
            for feature, at, below, above, path in shared.value:
                node = np.zeros(len(x), np.int64)
                while (inner := np.flatnonzero(feature[node] >= 0)).size:
                    here = node[inner]
                    node[inner] = np.where(x[inner, feature[here].astype(np.int64)] < at[here], below[here], above[here])
                total += path[node]
            score = 2.0 ** (-total / max(1, len(shared.value)) / normal)
            missing = np.isnan(x).any(axis=1) | (not shared.value)
            yield pd.DataFrame({key: part[key], "score": np.where(missing, np.nan, score)})

    out = df.select(key, *(F.col(c).cast("double").alias(c) for c in columns)).mapInPandas(walk, f"{key} {dict(df.dtypes)[key]}, score double")
    return out.select(key, F.nanvl("score", F.lit(None).cast("double")).alias("score"))


def offset(scores: DataFrame, contamination: float = CONTAMINATION) -> Column:
    """The score that a share of the rows exceeds; scores count to six places, so that what is held stays bounded."""
    return scores.agg(F.percentile(F.round("score", 6), F.lit(1 - contamination)).alias("o")).scalar()


def anomaly(score: Column, cut: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + score - F.coalesce(cut, F.lit(0.5))))


def isolation(df: DataFrame, key: str, columns: list[str], trees: int = TREES, seed: int = 42, fit_on: Column | None = None, contamination: float = CONTAMINATION, sample: int = SAMPLE) -> DataFrame:
    """(key, score, anomaly): a forest fitted on the rows that `fit_on` holds for; anomaly is 0.5 plus the score above that of the most isolated fitted rows, clipped to 0 to 1."""
    base = df if fit_on is None else df.where(fit_on)
    size = max(1, min(sample, base.count()))
    scores = scored(df, key, columns, fitted(base, key, columns, trees, sample, seed), size)
    cut = offset(scores.join(base.select(key), key, "left_semi"), contamination)
    return scores.select(key, "score", anomaly(F.col("score"), cut).alias("anomaly"))
