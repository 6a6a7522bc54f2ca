"""Operator 5, exact top-k search over quantised vectors by block-at-a-time pruning.

Rows, sorted by id, form blocks (ranges of ids) that keep a forward index (the rows'
integer vectors) and each dimension's largest and smallest value. A block's bound for a
query is the sum over dimensions of the larger of query value times maximum or minimum.
A task holds one bounded group of queries and one bounded shard of blocks; each query
visits the blocks from the highest bound down and stops when a bound falls below its
k-th score. With several shards the blocks' largest and smallest values alone, a hundredth
of their bytes, meet all queries first. Queries whose highest bound is that of one block are
grouped, and that block gives each a k-th score to start from; then a block is sent only to
the groups in which some query's bound for it reaches that query's score. The shards' lists are then merged. Every query
meets every row unless a bound excludes the row's block, so results are exact.

Defined results: vectors that are null or hold null or non-finite components, and rows
without id, take no part; shorter vectors count as padded with zeros; a query never finds
rows of its own id; equal queries repeated count once; repeated candidate rows count each;
ties go to the smaller id; fewer than k candidates are all returned; an empty table, or one
without queries, gives an empty result; vectors may have any length; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vettra.llm.common import table, written

BLOCK_ROWS = 1024
SHARD_ROWS = 16_384
QUERY_GROUP = 1024
#: Shards whose blocks' outlines meet a group of queries in one task.
SUMMARY_SHARDS = 256
NONE = np.iinfo(np.int64).min


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v): rows that take part, quantised."""
    finite = F.forall(F.col(vector), lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector)).alias("v"))


def matrix(rows: list, width: int = 0) -> np.ndarray:
    width = max([width, *(len(r) for r in rows)])
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def packed(m: np.ndarray) -> tuple[bytes, int]:
    """A matrix of whole numbers in the fewest bytes a number that hold it, and that number of bytes."""
    top = int(np.abs(m).max(initial=0))
    kind = np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64
    return m.astype(kind).tobytes(), np.dtype(kind).itemsize


def unpacked(raw: bytes, width: int, size: int) -> np.ndarray:
    return np.frombuffer(raw, f"i{size}").reshape(-1, width).astype(np.int64)


def blocks_of(most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Makes blocks of at most so many consecutive ids with their forward index, and the largest and smallest value of each dimension."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for a in range(0, len(part), most):
                ids, m = part["id"].to_numpy(np.int64)[a : a + most], matrix(list(part["v"].iloc[a : a + most]), 1)
                forward, size = packed(m)
                ends = np.stack([m.max(axis=0), m.min(axis=0)]).tobytes()
                yield pd.DataFrame({"first": [int(ids[0])], "ids": [ids.tobytes()], "width": [m.shape[1]], "size": [size], "forward": [forward], "ends": [ends]})

    return cut


def bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The highest score that each query can have with a row between the smallest and largest values of each block."""
    return np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T


def top_k(query_ids: np.ndarray, queries: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of each query's k best rows in these blocks; rows below the query's floor may be left out."""
    width = max([queries.shape[1], *(m.shape[1] for _, m in blocks)])
    pad = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
    queries, blocks = pad(queries), [(ids, pad(m)) for ids, m in blocks]
    large = max(int(np.abs(queries).max(initial=0)) * max(int(np.abs(m).max(initial=0)) for _, m in blocks) * max(width, 1), 1)
    kind = np.float64 if large < 2**53 else np.int64  # floats are exact, and faster, as long as sums fit
    q = queries.astype(kind)
    forward = [m.astype(kind) for _, m in blocks]
    most, least = (np.stack([f(m, axis=0) for m in forward]) for f in (np.max, np.min))
    bound = bounds(q, most, least)
    order = np.argsort(-bound, axis=1, kind="stable")
    low = kind(-np.inf) if kind is np.float64 else NONE
    kth = np.full(len(q), low) if floors is None else np.where(floors == NONE, low, floors.astype(kind))
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind))
    for turn in range(len(blocks)):
        block = order[:, turn]
        active = np.flatnonzero(bound[np.arange(len(q)), block] >= kth)
        if not len(active):
            break
        found = [best]
        for b in np.unique(block[active]):
            who, ids = active[block[active] == b], blocks[b][0]
            score = q[who] @ forward[b].T
            score[ids[None, :] == query_ids[who][:, None]] = low
            floor = kth[who]
            if score.shape[1] > k:
                floor = np.maximum(floor, np.partition(score, -k, axis=1)[:, -k])
            i, j = np.nonzero((score >= floor[:, None]) & (score > low))
            found.append((who[i], ids[j], score[i, j]))
        n, ids, score = (np.concatenate(x) for x in zip(*found, strict=True))
        rank = np.lexsort((ids, -score, n))
        n, ids, score = n[rank], ids[rank], score[rank]
        place = np.arange(len(n)) - np.searchsorted(n, n)
        keep = place < k
        best = n[keep], ids[keep], score[keep]
        full = place == k - 1
        kth[n[full]] = np.maximum(kth[n[full]], score[full])
    return best


def all_of(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def outline_bounds(qs: pd.DataFrame, bs: pd.DataFrame) -> np.ndarray:
    """The bound of each block, from its outline, for each query."""
    width = max(int(bs["width"].max()), *(len(v) for v in qs["v"]))
    ends = np.zeros((2, len(bs), width), np.int64)
    for i, (raw, w) in enumerate(zip(bs["ends"], bs["width"], strict=True)):
        ends[:, i, :w] = np.frombuffer(raw, np.int64).reshape(2, w)
    q = matrix(list(qs["v"]), width)
    if float(np.abs(ends).max(initial=0)) * float(np.abs(q).max(initial=0)) * width >= 2**62:
        q, ends = q.astype(object), ends.astype(object)  # whole numbers of any size
    return bounds(q, *ends)


def meeting(asked: DataFrame, blocks: DataFrame, shards: int, met, schema: str) -> DataFrame:
    """met(queries, outlines) for each group of queries and each part of the blocks' outlines."""
    parts = -(-shards // SUMMARY_SHARDS)
    groups = asked.groupBy(F.col("group").alias("to")).agg(F.count(F.lit(1)))  # a row a group
    outlines = blocks.select("block", "width", "ends", F.pmod("block", F.lit(parts)).cast("long").alias("part")).crossJoin(groups.select(F.col("to").alias("group")))
    both = asked.select("*", all_of(parts).alias("part")).groupBy("group", "part").cogroup(outlines.groupBy("group", "part"))
    return both.applyInPandas(lambda qs, bs: met(qs, bs) if len(qs) and len(bs) else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")}), schema)


def regrouped(asked: DataFrame, blocks: DataFrame, groups: int, shards: int) -> DataFrame:
    """asked with the block of each query's highest bound (near), and groups of queries that share it, so that a group needs few blocks; large groups are split."""

    def highest(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
        b = outline_bounds(qs, bs)
        at = b.argmax(axis=1)
        return pd.DataFrame({"qk": qs["qk"], "bound": b[np.arange(len(qs)), at].astype(float), "block": bs["block"].to_numpy()[at]})

    best = meeting(asked, blocks, shards, highest, "qk long, bound double, block long")
    near = best.groupBy("qk").agg(F.max_by("block", F.struct("bound", "block")).alias("near"))
    placed = written(asked.join(near, "qk", "left").withColumn("place", F.pmod(F.xxhash64("near"), F.lit(4 * groups)).cast("long")), "search-places")
    sizes = placed.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / QUERY_GROUP).alias("n"))  # four rows a group
    split = F.pmod(F.xxhash64(F.lit(3), "qk"), F.col("n"))
    return placed.join(sizes, "place").select((F.col("place") * 1_000_000 + split).alias("group"), "id", "v", "qk", "floor", "near")


def in_reach(asked: DataFrame, blocks: DataFrame, shards: int) -> DataFrame:
    """(group, block): the blocks whose bound reaches the floor of some query of a group, from their outlines alone."""

    def reached(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
        hit = (outline_bounds(qs, bs) >= qs["floor"].to_numpy(np.int64)[:, None]).any(axis=0)
        return pd.DataFrame({"group": int(qs["group"].iloc[0]), "block": bs["block"][hit]})

    return meeting(asked, blocks, shards, reached, "group long, block long").distinct()  # equal blocks have one number


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of `vectors` for each row of `queries`."""
    rows = usable(vectors, id_col, vector)
    asked = usable(queries, id_col, vector).distinct()
    groups = max(1, -(-asked.count() // QUERY_GROUP))
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    made = rows.repartitionByRange("id", F.xxhash64("v")).sortWithinPartitions("id").mapInPandas(blocks_of(BLOCK_ROWS), "first long, ids binary, width int, size int, forward binary, ends binary")
    blocks = made.withColumns({"block": F.xxhash64("first", "ids", "forward"), "shard": F.pmod(F.xxhash64("first", "ids"), F.lit(shards)).cast("long")})
    asked = asked.select(F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("long").alias("group"), "id", "v", F.xxhash64("id", "v").alias("qk"))

    def task(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(bs):
            return pd.DataFrame({"query_id": [], "qk": [], "vec_id": [], "score": []})
        at = [(np.frombuffer(i, np.int64), unpacked(m, w, z)) for i, m, w, z in zip(bs["ids"], bs["forward"], bs["width"], bs["size"], strict=True)]
        n, ids, score = top_k(qs["id"].to_numpy(np.int64), matrix(list(qs["v"])), at, k, qs["floor"].to_numpy(np.int64))
        return pd.DataFrame({"query_id": qs["id"].to_numpy()[n], "qk": qs["qk"].to_numpy()[n], "vec_id": ids, "score": score.astype(np.int64)})

    def lists(asked: DataFrame, blocks: DataFrame) -> DataFrame:
        sent = blocks.select("group", "shard", "ids", "width", "size", "forward")
        return asked.groupBy("group", "shard").cogroup(sent.groupBy("group", "shard")).applyInPandas(task, "query_id long, qk long, vec_id long, score long")

    best = Window.partitionBy("query_id", "qk").orderBy(F.desc("score"), "vec_id")
    asked = asked.withColumn("floor", F.lit(NONE))
    if shards > 1:
        # a first round over the block with its highest bound gives each query a k-th score, which the bounds of others must reach
        blocks = written(blocks, "search-blocks")
        asked = written(regrouped(asked, blocks, groups, shards), "search-groups")
        near = asked.groupBy(F.col("group").alias("to"), F.col("near").alias("block")).agg(F.count(F.lit(1))).select(F.col("to").alias("group"), "block")
        zero = F.lit(0).cast("long")
        first = lists(asked.withColumn("shard", zero), blocks.join(near, "block").withColumn("shard", zero)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        seeds = first.groupBy("query_id", "qk").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("seed")).where(F.col("n") == k)
        asked = asked.join(seeds, (F.col("id") == F.col("query_id")) & asked.qk.eqNullSafe(seeds.qk), "left").select("group", "id", "v", asked.qk, F.coalesce("seed", "floor").alias("floor"))
        asked = written(asked, "search-queries")
        found = lists(asked.withColumn("shard", all_of(shards)), blocks.join(in_reach(asked, blocks, shards), "block"))
    else:
        found = lists(asked.withColumn("shard", F.lit(0).cast("long")), blocks.withColumn("group", all_of(groups)))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all embeddings for each whose vec_id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
