"""Operator 11, Merkle manifest: a forest of hash trees with eight children a node, one tree a group, and a tree over their roots.

A leaf is the hash of a row's fields. Leaves of a group ascend by key; every 8 consecutive
nodes (the last run: fewer, even one) become their parent until one is left, the group's
subroot. The subroots, by group, are the leaves of the top tree in the same way.

How rows get their places: the leaves, without texts, are range-partitioned and sorted by
(group, key, leaf) and written; a place in the group is a row's place in its partition plus
the counts of the partitions before, which is one small row for each (partition, group).

How trees are built: 8**CHUNK_LEVELS consecutive leaves of a group are a chunk and are
hashed in one task, which emits one node; so many consecutive nodes of these again. What is
left are the elements of a sparse forest, a commutative monoid (`Forest`): a fragment holds
nodes by (tree, level, index), and whenever all siblings of a run are there, whose number
follows from the tree's size, the run becomes its parent. Partitions fold their nodes to
fragments, and treeReduce merges these to the root. Fragments may meet in any order, so lost
and repeated tasks change nothing. Proofs go down the same way: each node learns the runs
above it, from the forest and then from its own chunk, and each chunk of leaves meets the
one row of its node.

What the driver and the broadcast hold: a node for each 16,777,216 leaves, one for each
group, and an eighth more; rows never. Groups are meant to be few (languages, sources); a
large group is spread over its chunks.

Defined results: null fields hash as ``-``. A null key sorts first and a null group comes
first. Rows with the same key follow their leaves; equal rows have equal leaves, and each
has a place and a proof of its own. Empty texts are fields of length zero, long ones are
hashed whole. An empty table gives an empty result. Only the named columns are read, so
others may have any name.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vettra.llm.common import ascii_lower, table, written

ARITY = 8
#: Levels of a tree that one task hashes at once: 8**4 = 4,096 nodes.
CHUNK_LEVELS = 4
#: Leaves that a range partition is meant to hold, and the most partitions.
ROWS_PER_TASK, MOST_TASKS = 65_536, 20_000
#: The tree over the subroots.
TOP = -1

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: Iterable[bytes]) -> bytes:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def height(n: int) -> int:
    """Levels above the leaves of a tree with n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def width(n: int, level: int) -> int:
    """Nodes on a level of a tree with n leaves."""
    return -(-n // ARITY**level)


@dataclass
class Forest:
    """A fragment: unresolved nodes by (tree, level, index), and the runs that were resolved in it.

    `groups` is the number of group trees, `sizes` the leaves of each tree seen. The empty
    fragment is the identity of `merge`, which is associative and commutative.
    """

    groups: int
    nodes: dict[tuple[int, int, int], bytes] = field(default_factory=dict)
    runs: dict[tuple[int, int, int], tuple[bytes, ...]] = field(default_factory=dict)
    sizes: dict[int, int] = field(default_factory=dict)
    subroots: dict[int, bytes] = field(default_factory=dict)
    root: bytes | None = None

    def add(self, tree: int, n: int, level: int, index: int, node: bytes) -> None:
        """Puts a node in, and resolves what it completes."""
        if tree != TOP:
            self.sizes[tree] = n
        while True:
            if level == height(n):
                if tree == TOP:
                    self.root = node
                    return
                self.subroots[tree] = node
                tree, n, level, index = TOP, self.groups, 0, tree
                continue
            self.nodes[tree, level, index] = node
            run = index // ARITY
            first = run * ARITY
            places = [(tree, level, i) for i in range(first, min(first + ARITY, width(n, level)))]
            if not all(p in self.nodes for p in places):
                return
            children = tuple(self.nodes.pop(p) for p in places)
            self.runs[tree, level, run] = children
            level, index, node = level + 1, run, digest(children)

    def merge(self, other: Forest) -> Forest:
        """Both fragments as one; the smaller one's nodes go into the larger."""
        big, small = (self, other) if len(self.nodes) >= len(other.nodes) else (other, self)
        big.runs |= small.runs
        big.sizes |= small.sizes
        big.subroots |= small.subroots
        big.root = big.root or small.root
        for (tree, level, index), node in small.nodes.items():
            big.add(tree, self.groups if tree == TOP else big.sizes[tree], level, index, node)
        return big

    def above(self, tree: int, level: int, index: int) -> Iterator[tuple[tuple[bytes, ...], int]]:
        """(children, own place) of each run on the way from a node to the root."""
        while True:
            n = self.groups if tree == TOP else self.sizes[tree]
            if level == height(n):
                if tree == TOP:
                    return
                tree, level, index = TOP, 0, tree
                continue
            yield self.runs[tree, level, index // ARITY], index % ARITY
            level, index = level + 1, index // ARITY


def encoded(value: Column, kind: str) -> Column:
    """A field as bytes to hash: ``-`` if null, else its UTF-8 length, ``:`` and itself."""
    text = value if kind == "string" else value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(df: DataFrame, fields: Iterable[str], swapped: dict[str, Column] | None = None) -> Column:
    """The leaf of each row, with some fields' values swapped for others."""
    kinds, swapped = dict(df.dtypes), swapped or {}
    return F.sha2(F.concat(*(encoded(swapped.get(f, F.col(f"`{f}`")), kinds[f]) for f in fields)).cast("binary"), 256)


def placed(leaves: DataFrame) -> DataFrame:
    """leaves (key, grp, leaf, …) with tree (the group's place), i (the leaf's place in it) and n (leaves of the group)."""
    stored = written(leaves.withColumn("u", F.monotonically_increasing_id()), "leaves")  # texts are read once
    tasks = min(MOST_TASKS, max(1, math.ceil(stored.count() / ROWS_PER_TASK)))
    order = [F.asc_nulls_first("grp"), F.asc_nulls_first("key"), F.asc("leaf"), F.asc("u")]  # u parts equal rows
    ranged = stored.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    ordered = written(ranged.drop("u").withColumn("at", F.monotonically_increasing_id()), "ordered-leaves").withColumn("part", F.shiftright("at", 33))
    runs = ordered.groupBy("part", "grp").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    of = Window.partitionBy("grp")
    before = of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"before": F.coalesce(F.sum("rows").over(before), F.lit(0)), "n": F.sum("rows").over(of)})
    names = runs.select("grp").distinct().select("grp", (F.row_number().over(Window.orderBy(F.asc_nulls_first("grp"))) - 1).alias("tree"))  # a row a group
    runs = runs.alias("r").join(names.alias("t"), F.col("r.grp").eqNullSafe(F.col("t.grp"))).select("r.*", "t.tree")
    runs = runs.select(F.col("part").alias("p"), F.col("grp").alias("g"), "first", "before", "n", "tree")
    both = ordered.join(runs, (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")))
    return both.select(*leaves.columns, F.col("tree").cast("long").alias("tree"), (F.col("at") - F.col("first") + F.col("before")).alias("i"), "n")


def climbed(nodes: list[bytes], n: int, level: int, most: int) -> list[list[bytes]]:
    """The levels of a chunk, from its nodes on a level of a tree with n leaves, `most` levels up or to the tree's top."""
    levels = [nodes]
    for _ in range(min(most, height(n) - level)):
        below = levels[-1]
        levels.append([digest(below[j : j + ARITY]) for j in range(0, len(below), ARITY)])
    return levels


def as_bytes(column: pa.ChunkedArray) -> list[bytes]:
    return [x if isinstance(x, bytes) else x.encode() for x in column.to_pylist()]


def chunk_of(i: str, levels: int) -> Column:
    return F.floor(F.col(i) / ARITY**levels).cast("long").alias("chunk")


NODES = "tree long, n long, level long, i long, node binary"


def summits(rows: DataFrame, chunk_levels: int) -> DataFrame:
    """The node over each chunk of nodes (tree, n, level, i, node); finished trees keep theirs."""

    def top(key: tuple, chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("i")
        (tree, index), n, level = (k.as_py() for k in key), chunk["n"][0].as_py(), chunk["level"][0].as_py()
        levels = climbed(as_bytes(chunk["node"]), n, level, chunk_levels)
        return pa.table({"tree": [tree], "n": [n], "level": [level + len(levels) - 1], "i": [index], "node": [levels[-1][0]]})

    return rows.select("tree", chunk_of("i", chunk_levels), "n", "level", "i", "node").groupBy("tree", "chunk").applyInArrow(top, NODES)


def as_nodes(rows: DataFrame) -> DataFrame:
    return rows.select("tree", "n", F.lit(0).cast("long").alias("level"), "i", F.col("leaf").cast("binary").alias("node"))


def forest(rows: DataFrame, chunk_levels: int = CHUNK_LEVELS) -> tuple[DataFrame, Forest]:
    """(nodes over chunks of placed leaves, the merged forest above chunks of these)."""
    nodes = written(summits(as_nodes(rows), chunk_levels), "manifest-nodes")
    groups = nodes.agg(F.coalesce(F.max("tree") + 1, F.lit(0))).first()[0]

    def fragment(part: Iterator) -> Iterator[Forest]:
        found = Forest(groups)
        for x in part:
            found.add(x["tree"], x["n"], x["level"], x["i"], bytes(x["node"]))
        yield found

    if not groups:
        return nodes, Forest(0)
    return nodes, summits(nodes, chunk_levels).rdd.mapPartitions(fragment).treeReduce(Forest.merge, depth=3)


def ways(nodes: DataFrame, found: Forest, chunk_levels: int) -> DataFrame:
    """Of each node over a chunk of leaves, the siblings before and after it in every run up to the root."""
    shared = nodes.sparkSession.sparkContext.broadcast(found)  # see the module's bound

    def lead(key: tuple, chunk: pa.Table) -> pa.Table:
        (tree, index), whole, chunk = (k.as_py() for k in key), shared.value, chunk.sort_by("i")
        level = chunk["level"][0].as_py()
        levels = climbed(as_bytes(chunk["node"]), chunk["n"][0].as_py(), level, chunk_levels)
        above = [(b"".join(run[:own]), b"".join(run[own + 1 :])) for run, own in whole.above(tree, level + len(levels) - 1, index)]
        before, after = [], []
        for j in range(len(levels[0])):
            way = []
            for nodes_ in levels[:-1]:
                first = j - j % ARITY
                way.append((b"".join(nodes_[first:j]), b"".join(nodes_[j + 1 : first + ARITY])))
                j //= ARITY
            before.append([b for b, _ in way + above])
            after.append([a for _, a in way + above])
        kind = pa.list_(pa.binary())
        return pa.table({"tree": chunk["tree"], "chunk": chunk["i"], "before": pa.array(before, kind), "after": pa.array(after, kind), "subroot": [whole.subroots[tree].decode()] * len(before), "root": [whole.root.decode()] * len(before)})

    schema = "tree long, chunk long, before array<binary>, after array<binary>, subroot string, root string"
    return nodes.select("tree", chunk_of("i", chunk_levels), "n", "level", "i", "node").groupBy("tree", "chunk").applyInArrow(lead, schema)


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(rows: DataFrame, nodes: DataFrame, found: Forest, claimed: str, chunk_levels: int = CHUNK_LEVELS) -> DataFrame:
    """Of every placed leaf its roots, the hash of its siblings up to the root, and the root that its claimed leaf folds to with them."""

    def prove(chunk: pa.Table, way: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("i")
        levels = climbed(as_bytes(chunk["leaf"]), chunk["n"][0].as_py(), 0, chunk_levels)
        upper = list(zip(way["before"][0].as_py(), way["after"][0].as_py(), strict=True))
        rest = [b"".join(x for run in upper for x in run)]  # the siblings above each node of a level
        for level in reversed(levels[:-1]):
            rest = [b"".join((*level[j - j % ARITY : j], *level[j + 1 : j - j % ARITY + ARITY], rest[j // ARITY])) for j in range(len(level))]
        folded = []
        for j, node in enumerate(as_bytes(chunk["claimed"])):
            for level in levels[:-1]:
                first = j - j % ARITY
                node = digest((*level[first:j], node, *level[j + 1 : first + ARITY]))
                j //= ARITY
            for before, after in upper:
                node = digest((before, node, after))
            folded.append(node.decode())
        n, root = len(folded), way["root"][0].as_py()
        return pa.table({
            "doc_id": chunk["key"], "leaf": chunk["leaf"], "subroot": [way["subroot"][0].as_py()] * n, "root": [root] * n,
            "proof_sha256": [hashlib.sha256(r).hexdigest() for r in rest], "folded_root": folded, "verified": [f == root for f in folded],
        })

    leaves = rows.select("tree", chunk_of("i", chunk_levels), "n", "i", "key", "leaf", F.col(claimed).alias("claimed"))
    return leaves.groupBy("tree", "chunk").cogroup(ways(nodes, found, chunk_levels).groupBy("tree", "chunk")).applyInArrow(prove, PROOFS)


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: Iterable[str] = FIELDS, claimed: Column | None = None, chunk_levels: int = CHUNK_LEVELS) -> tuple[DataFrame, DataFrame, Forest]:
    """(placed leaves, nodes over their chunks, forest) of a table: the leaves are written with key, group, leaf and the claimed leaf (by default the leaf itself)."""
    own = leaf(docs, fields)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").alias("grp"), own.alias("leaf"), (own if claimed is None else claimed).alias("claimed"))
    rows = placed(rows)
    return rows, *forest(rows, chunk_levels)


def subroots(rows: DataFrame, found: Forest) -> DataFrame:
    """The manifest to publish: (grp, leaves, subroot, root) of every group."""
    known = rows.sparkSession.createDataFrame([(t, s.decode(), found.root.decode()) for t, s in found.subroots.items()], "tree long, subroot string, root string")
    return rows.groupBy("tree", "grp").agg(F.count(F.lit(1)).alias("leaves")).join(known, "tree").select("grp", "leaves", "subroot", "root")


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row whose text is lower-cased where 3 divides the CRC-32 of its id; a row without id is left alone."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit & (F.col("text") != ascii_lower(F.col("text"))), leaf(docs, FIELDS, {"text": ascii_lower(F.col("text"))})).otherwise(leaf(docs, FIELDS))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether its text, tampered with in a third of them, still folds to the root."""
    docs = table(spark, sf_dir, "documents")
    rows, nodes, found = manifest(docs, claimed=tampered(docs))
    return proofs(rows, nodes, found, "claimed")


#: Levels of a tree that the SQL unrolls: up to 8**8 documents a language and languages.
SQL_LEVELS = 8


def _sql_tree(name: str, leaves: str, by: str) -> str:
    """CTEs {name}0 … {name}L of (by, i, n, d) and {name}up of (by, i, siblings) for the leaves of the CTE `leaves`."""
    key = f"{by}, " if by else ""
    out = [f"{name}0 AS (SELECT {key}i, n, d FROM {leaves})"]
    for k in range(1, SQL_LEVELS + 1):
        out.append(
            f"""{name}{k} AS (SELECT {key}i // 8 AS i, any_value((n + 7) // 8) AS n, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d
  FROM {name}{k - 1} GROUP BY {key}i // 8)"""
        )
    part = f"OVER (PARTITION BY {key}i // 8 ORDER BY i ROWS BETWEEN"
    agg = lambda frame, name: f"CASE WHEN n = 1 THEN '' ELSE coalesce(string_agg(d, '') {part} {frame}), '') END AS {name}"
    for k in range(SQL_LEVELS):  # a node's siblings on a level: those before (b), after (a) and both (s)
        out.append(f"{name}s{k} AS (SELECT *, b || a AS s FROM (SELECT {key}i, n, {agg('UNBOUNDED PRECEDING AND 1 PRECEDING', 'b')}, {agg('1 FOLLOWING AND UNBOUNDED FOLLOWING', 'a')} FROM {name}{k}))")
    return ",\n".join(out)


def oracle_sql() -> str:
    field_ = lambda c, v=None: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({v or c + '::VARCHAR'})::VARCHAR || ':' || {v or c + '::VARCHAR'} END"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf_of = lambda text=None: "sha256(" + " || ".join(field_(c, text if c == "text" else None) for c in FIELDS) + ")"
    chain = ["f0 AS (SELECT p.doc_id, p.leaf, p.lang, p.i, g.i AS gi, p.claimed AS folded, '' AS proof FROM p JOIN g ON g.lang IS NOT DISTINCT FROM p.lang)"]
    for k in range(2 * SQL_LEVELS):  # a CTE a level: first the group's tree, then the top one
        level = k % SQL_LEVELS
        s, on = (f"ls{level}", f"s.lang IS NOT DISTINCT FROM f.lang AND s.i = f.i // {8**level}") if k < SQL_LEVELS else (f"ts{level}", f"s.i = f.gi // {8**level}")
        chain.append(f"f{k + 1} AS (SELECT doc_id, leaf, f.lang, f.i, gi, CASE WHEN s.n = 1 THEN folded ELSE sha256(s.b || folded || s.a) END AS folded, proof || s.s AS proof FROM f{k} f JOIN {s} s ON {on})")
    return f"""
WITH bits AS (
  SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
         lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS t
  FROM range(256) r(i)),
crc AS (SELECT list(t ORDER BY i) AS tab FROM bits),
marked AS (SELECT *, coalesce(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k::BIGINT, 1))::UBIGINT)),
           lambda c, b: xor(tab[(xor(c, b) & 255)::BIGINT + 1], c >> 8)), 4294967295::UBIGINT) % 3 = 0, false) AS hit FROM documents, crc),
leaves AS (SELECT doc_id, lang, {leaf_of()} AS leaf, CASE WHEN hit AND text IS NOT NULL THEN {leaf_of(lower)} ELSE {leaf_of()} END AS claimed FROM marked),
p AS (SELECT doc_id, lang, leaf, claimed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
l_leaves AS (SELECT lang, i, n, leaf AS d FROM p),
{_sql_tree('l', 'l_leaves', 'lang')},
g AS (SELECT lang, d AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM l{SQL_LEVELS}),
t_leaves AS (SELECT i, n, subroot AS d FROM g),
{_sql_tree('t', 't_leaves', '')},
{",".join(chain)}
SELECT doc_id, leaf, subroot, r.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.d AS verified
FROM f{2 * SQL_LEVELS} f JOIN g ON g.lang IS NOT DISTINCT FROM f.lang, t{SQL_LEVELS} r"""
