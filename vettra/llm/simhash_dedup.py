"""Operator 4, SimHash near-dedup: binary-trie self-join of fingerprints.

Fingerprints are majority bits over the XXH64 of word shingles. Equal fingerprints
collapse first, so copies cost nothing. Two fingerprints within 3 bits agree on one of
four 16-bit blocks, so the trie is rotated to lead with each block in turn: its first
levels allow no differing bit, and every subtree below them is searched on its own. A
subtree with more than HEAVY fingerprints is divided further by a block of the rest, and
again. Inside a subtree, pairs of nodes descend together, level by level: a pair that takes
different children adds one to its differing bits and is dropped above the budget; small
pairs of nodes are compared bit by bit. Each task returns a spanning forest of its links,
never all pairs, and the components of all links are found in joins.

Defined results: a null or empty text, or one without words, has fingerprint zero, linked
like any other; long texts are hashed whole; repeated rows share their component; null ids take part in links, but are
never a component's id (null if there is no other); ties do not arise; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vettra.llm.common import row_key, table, written
from vettra.llm.components import connected_components

BUDGET = 3
HEAVY = 50_000
BUFFER_ROWS = 100_000
LEAF_PAIRS = 16
FRONTIER = 200_000
SHINGLES_AT_ONCE = 50_000


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of a whole text."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, SHINGLES_AT_ONCE):
        part = words[a : a + SHINGLES_AT_ONCE + width - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64)
        for k in range(64):
            ones[k] += np.count_nonzero(h & np.uint64(1 << k))
    bits = sum(1 << k for k in range(64) if 2 * ones[k] > n)
    return bits - (1 << 64) if bits >> 63 else bits


def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each index's component under links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def trie_links(subtree: np.ndarray, prints: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of linked fingerprints, from a joint descent of node pairs.

    Both arrays are sorted by (subtree, print); a node is a range of them at a depth.
    """
    bounds = np.flatnonzero(np.r_[True, subtree[1:] != subtree[:-1], True])
    lo, hi = bounds[:-1], bounds[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    ones: dict[int, np.ndarray] = {}
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while stack:
        depth, lo1, hi1, lo2, hi2, err = stack.pop()
        if len(lo1) > FRONTIER:  # depth first in slices, so that memory stays bounded
            stack.append((depth, *(x[FRONTIER:] for x in (lo1, hi1, lo2, hi2, err))))
            lo1, hi1, lo2, hi2, err = (x[:FRONTIER] for x in (lo1, hi1, lo2, hi2, err))
        leaf = (hi1 - lo1) * (hi2 - lo2) <= LEAF_PAIRS
        if depth == 64:
            leaf[:] = True
        if leaf.any():
            n1, n2 = (hi1 - lo1)[leaf], (hi2 - lo2)[leaf]
            size = n1 * n2
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            a, b = np.repeat(lo1[leaf], size) + at // np.repeat(n2, size), np.repeat(lo2[leaf], size) + at % np.repeat(n2, size)
            near = (a < b) & (np.bitwise_count(prints[a] ^ prints[b]) <= budget)
            found_a.append(a[near])
            found_b.append(b[near])
        lo1, hi1, lo2, hi2, err = (x[~leaf] for x in (lo1, hi1, lo2, hi2, err))
        if not len(lo1):
            continue
        if depth not in ones:
            ones[depth] = np.r_[0, np.cumsum((prints >> np.uint64(63 - depth)) & np.uint64(1)).astype(np.int64)]
        mid1, mid2 = hi1 - (ones[depth][hi1] - ones[depth][lo1]), hi2 - (ones[depth][hi2] - ones[depth][lo2])
        same = lo1 == lo2
        parts = [
            (lo1, mid1, lo2, mid2, err), (mid1, hi1, mid2, hi2, err),
            (lo1, mid1, mid2, hi2, err + 1), *[tuple(x[~same] for x in (mid1, hi1, lo2, mid2, err + 1))],
        ]
        lo1, hi1, lo2, hi2, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (err <= budget) & (hi1 > lo1) & (hi2 > lo2) & ~((lo1 == lo2) & (hi1 - lo1 == 1))
        if keep.any():
            stack.append((depth + 1, *(x[keep] for x in (lo1, hi1, lo2, hi2, err))))
    return np.concatenate(found_a), np.concatenate(found_b)


def subtree_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning forests of the links inside subtrees; rows come sorted by subtree, which may span batches."""

    def forest(rows: pd.DataFrame) -> pd.DataFrame:
        subtree, rest, prints = (rows[c].to_numpy(np.int64) for c in ("subtree", "rest", "fp"))
        rest = rest.view(np.uint64)
        order = np.lexsort((rest, subtree))
        a, b = trie_links(subtree[order], rest[order])
        fp = prints[order]
        real = np.bitwise_count(fp.view(np.uint64)[a] ^ fp.view(np.uint64)[b]) <= BUDGET  # numbers of subtrees are hashes
        root = local_roots(len(order), a[real], b[real])
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"u": fp[moved], "v": fp[root[moved]]})

    held: list[pd.DataFrame] = []
    size = 0
    for rows in batches:
        if len(rows):
            held.append(rows)
            size += len(rows)
        if size >= BUFFER_ROWS:
            rows = pd.concat(held, ignore_index=True)
            last = int(np.searchsorted(rows["subtree"].to_numpy(), rows["subtree"].iloc[-1]))  # the last subtree may go on
            if last:
                yield forest(rows.iloc[:last])
            held, size = [rows.iloc[last:]], len(rows) - last
    if size:
        yield forest(pd.concat(held, ignore_index=True))


def below(subtree: Column, rest: Column, width: int, left: int) -> Column:
    """(subtree, rest) for each block of `width` bits of the `left` bits that lead `rest`: rest loses the block."""
    out = []
    for i in range(left // width):
        before, after = width * i, width * (i + 1)
        block = F.shiftrightunsigned(rest, 64 - after).bitwiseAND(F.lit((1 << width) - 1))
        lead = F.shiftleft(F.shiftrightunsigned(rest, 64 - before), 64 - before) if before else F.lit(0).cast("long")
        tail = F.shiftrightunsigned(F.shiftleft(rest, after), before) if after < 64 else F.lit(0).cast("long")
        out.append(F.struct(F.xxhash64(subtree, F.lit(i), block).alias("subtree"), lead.bitwiseOR(tail).alias("rest")))
    return F.array(*out)


def near_links(prints: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(u, v): links that span the components of distinct fingerprints `fp` within BUDGET bits.

    Two fingerprints within 3 bits agree on one of four blocks of the bits that a subtree
    has left: 16 bits at the top, then, in heavy subtrees, 12 and 9 of what is left. Below
    that, a subtree's fingerprints share 37 bits and are searched whatever their number.
    """
    left, done = 64, None
    rows = prints.select("fp", F.explode(below(F.lit(0).cast("long"), F.col("fp"), 16, left)).alias("x")).select("fp", "x.subtree", "x.rest")
    for width in (12, 9):
        left -= left // 4
        big = written(rows.groupBy("subtree").count().where(F.col("count") > heavy).select("subtree"), "heavy")
        if not big.count():
            break
        light = rows.join(big, "subtree", "left_anti")
        done = light if done is None else done.unionByName(light)
        rows = rows.join(big, "subtree", "left_semi").select("fp", F.explode(below(F.col("subtree"), F.col("rest"), width, left)).alias("x")).select("fp", "x.subtree", "x.rest")
    rows = rows if done is None else done.unionByName(rows)
    return rows.select("subtree", "rest", "fp").repartition("subtree").sortWithinPartitions("subtree").mapInPandas(subtree_links, "u long, v long")


def near_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, rk1, rk2, fp, root, component_id) of each row: fp is the signed fingerprint, root the least one of its component.

    Only root tells components apart: component_id is null in every component without an
    id, and one id on different texts can be the least of several components.
    """
    udf = F.pandas_udf(fingerprints, "long")
    base = written(docs.select(F.col(id_col).alias("id"), *row_key(F.col(id_col), F.col(text)), udf(F.col(text)).alias("fp")), "fingerprints")
    prints = written(base.groupBy("fp").agg(F.min("id").alias("low")), "distinct-fingerprints")
    roots = connected_components(near_links(prints))
    rooted = written(prints.join(roots, prints.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "roots")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select("fp", "root", "component_id")
    return base.join(named, "fp").select("id", "rk1", "rk2", "fp", "root", "component_id")


def dedup_near(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: the least id's first row by hash (null ids last), with all columns of docs."""
    found = near_components(docs, id_col, text)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rk1", "rk2")).alias("k")).select("k.rk1", "k.rk2")
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), *row_key(docs[id_col], docs[text]))
    kept = rows.join(best, ["rk1", "rk2"], "left_semi")
    copies = Window.partitionBy("rk1", "rk2").orderBy(F.xxhash64("row"))  # repeated rows of one id and text
    return kept.withColumn("n", F.row_number().over(copies)).where("n = 1").select("row.*")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
