"""Operator 3, sharding: a hierarchical weighted hash tree over regions, racks and shards.

A row descends from the root: at each level it draws one score for each child,
``-ln(u) / weight`` with u uniform from MD5 of (salt, child's path, key), and takes the
child with the smallest score. A child whose weight grows only gains rows, and one whose
weight shrinks only loses rows, so movement stays within the subtrees whose weights
changed; a shard that is added as a region of its own takes rows only into itself.

Only built-in functions are used. No row is gathered in one task: slots are row numbers
in small hash buckets plus the counts of the buckets before.

Defined results: a null key draws as the text ``null``; a null text has size 1 and CRC
zero; long texts are read whole; an empty table gives an empty result; repeated rows each get
a slot of their own; of equal draws the path first in order wins;
other columns of the input (also ones named like the results) are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vettra.llm.common import table, written

#: Leading hex digits of a row's order key that name its slot bucket (16**4 buckets).
BUCKET_DIGITS = 4
#: Shards of the regular tree that growth starts from.
BASE_SHARDS = 16


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def regular_tree(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> list[Shard]:
    """Equal shards, filled rack by rack and region by region."""
    return [Shard(f"r{i // (per_rack * racks_per_region)}", f"k{i // per_rack % racks_per_region}", i) for i in range(shards)]


def grown_tree(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard as a region of its own: no other subtree's weight changes."""
    n = max(s.shard for s in tree) + 1
    return [*tree, Shard(f"grown{n}", "k0", n, weight)]


def sized_tree(shards: int) -> list[Shard]:
    """The one tree for a number of shards: regular up to BASE_SHARDS, and each further shard a region of its own.

    So the key and the number decide alone, and from BASE_SHARDS on each step to one more shard moves rows into that shard only.
    """
    tree = regular_tree(min(shards, BASE_SHARDS))
    while len(tree) < shards:
        tree = grown_tree(tree)
    return tree


def levels(tree: list[Shard]) -> list[list[tuple[str, str, float]]]:
    """(parent's path, path, weight) of the nodes of each level; a node weighs what its shards weigh together."""
    out = []
    for depth in (1, 2, 3):
        weights: dict[tuple[str, str], float] = {}
        for s in tree:
            parts = ("", s.region, s.rack, f"s{s.shard}")
            at = ("/".join(parts[:depth]), "/".join(parts[: depth + 1]))
            weights[at] = weights.get(at, 0.0) + s.weight
        out.append([(parent, path, w) for (parent, path), w in weights.items()])
    return out


def descend(rows: DataFrame, key: str, tree: list[Shard], out: str) -> DataFrame:
    """rows with the column `out`: the shard of `key`, by the least draw at each level (ties: the first by path)."""
    at = F.lit("")
    for level in levels(tree):
        at = F.transform(F.array(at), chooser(key, level))[0]  # bound once, not drawn again for each child
    return rows.withColumn(out, F.regexp_extract(at, "/s([0-9]+)$", 1).cast("int"))


def chooser(key: str, level: list[tuple[str, str, float]]) -> Callable[[Column], Column]:
    nodes = F.array(*(F.struct(F.lit(p).alias("parent"), F.lit(c).alias("path"), F.lit(float(w)).alias("weight")) for p, c, w in level))

    def choose(parent: Column) -> Column:
        below = F.filter(nodes, lambda n: n["parent"] == parent)
        return F.array_min(F.transform(below, lambda n: F.struct(draw(F.col(key), n["path"], n["weight"]).alias("score"), n["path"].alias("path"))))["path"]

    return choose


def draw(key: Column, path: Column, weight: Column) -> Column:
    """-ln(u)/weight, u in (0, 1) from 52 bits of MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(path, F.lit(":"), key).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / F.lit(float(2**52))) / weight


def assign_shards(rows: DataFrame, key: str, text: str, tree: list[Shard], grown: list[Shard]) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) of every row; slots are gapless from 0 in each shard, in the order of MD5 of key and text."""
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    t = F.coalesce(F.col(text), F.lit(""))
    base = rows.select(
        F.col(key),
        (F.octet_length(t) + F.lit(1)).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.md5(F.concat(k, F.lit(":"), t).cast("binary")).alias("__order"),
        k.alias("__k"),
        F.substring(F.md5(F.concat(k, F.lit(":"), t).cast("binary")), 1, BUCKET_DIGITS).alias("__bucket"),
    )
    base = written(descend(descend(base, "__k", tree, "shard"), "__k", grown, "grown_shard").drop("__k"), "shards")  # texts are read once
    counts = base.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("shard", "__bucket").orderBy("__order", F.col(key).asc_nulls_first())
    return (
        base.withColumn("__rn", F.row_number().over(within))
        .join(starts, ["shard", "__bucket"])
        .select(key, "size", "text_crc32", "shard", (F.col("__start") + F.col("__rn") - 1).cast("long").alias("slot"), "grown_shard")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards by the law `key`."""
    out = assign_shards(table(spark, sf_dir, "documents"), "doc_id", "text", sized_tree(16), sized_tree(17))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql_descend(tree: list[Shard]) -> str:
    """The same descent as one correlated subquery for each level."""
    at = "''"
    for level in levels(tree):
        nodes = ", ".join(f"{{'parent': '{p}', 'path': '{c}', 'weight': {float(w)!r}::DOUBLE}}" for p, c, w in level)
        score = f"-ln((('0x' || substr(md5(n.path || ':' || k), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(2**52)!r}) / n.weight"
        at = f"list_min(list_transform(list_filter([{nodes}], lambda n: n.parent = {at}), lambda n: {{'score': {score}, 'path': n.path}})).path"
    return f"regexp_extract({at}, '/s([0-9]+)$', 1)::INTEGER"


ORACLE_SQL = f"""
WITH bits AS (
  SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
         lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS t
  FROM range(256) r(i)),
crc AS (SELECT list(t ORDER BY i) AS tab FROM bits),
base AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents),
placed AS (
  SELECT doc_id, (strlen(t) + 1)::BIGINT AS size, t, k, md5(k || ':' || t) AS o,
         {_sql_descend(sized_tree(16))} AS shard, {_sql_descend(sized_tree(17))} AS grown_shard
  FROM base)
SELECT doc_id, size,
       xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, strlen(t) + 1),
             lambda i: ('0x' || substr(hex(encode(t)), (2 * i - 1)::BIGINT, 2))::UBIGINT)),
           lambda c, b: xor(tab[(xor(c, b) & 255)::BIGINT + 1], c >> 8)), 4294967295::UBIGINT)::BIGINT AS text_crc32,
       'key' AS law, shard::INTEGER AS shard,
       (row_number() OVER (PARTITION BY shard ORDER BY o, doc_id NULLS FIRST) - 1)::BIGINT AS slot,
       grown_shard::INTEGER AS grown_shard
FROM placed, crc
"""
