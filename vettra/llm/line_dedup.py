"""Operator 1, line dedup: lines that many documents share are removed from all of them.

Distinct line hashes, with the number of documents that hold each, are dealt into shards.
Each shard becomes a minimal perfect hash (levels of bit arrays; a key's index is the rank
of its bit) over two arrays: a 64-bit fingerprint and a saturating count. Documents send
only hashes and line numbers to the shards and probe the arrays there; lines are never
joined. Line numbers of hits come back by document.

Hot lines: keys that hold at least 1/HOT_SHARE of all (document, line) pairs, so HOT_SHARE
keys at most, form one small shard of their own that is copied to HOT_COPIES places at
least. The other keys are dealt evenly, so that their shards have much the same number of
probes. A shard is copied to one place for each PROBES_PER_PLACE of its probes, which are
spread over its places by row and line. Shards stream through a task row by row, so that no
group has to fit in memory. Only the hashes of hot keys are broadcast.

Defined results: null or empty text is one empty line; a key shorter than ``min_chars``
code points never counts; each row is a document, repeated rows too; equal rows get equal
results; null ids are kept; ties do not arise; texts of any length are split and hashed whole;
an empty table gives an empty result; other columns are ignored (op1) or kept (dedup_lines).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vettra.llm.common import ascii_lower, row_key, table, written

KEYS_PER_SHARD = 25_000
HOT_SHARE = 25_000
HOT_COPIES = 64
PROBES_PER_PLACE = 5_000
MAX_COPIES = 1 << 20
COUNT_MAX = 65_535
STRIP = " \t\n\u000b\f\r"


def mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of two 64-bit hashes for one level."""
    with np.errstate(over="ignore"):
        x = a ^ (b * np.uint64(2 * level + 1) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1))
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash over distinct (h1, h2) with fingerprint (h2) and count arrays."""

    def __init__(self, sizes: list[int], bits: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        self.sizes, self.bits, self.prints, self.counts = sizes, bits, prints, counts
        self.rank = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> PerfectHash:
        sizes, parts, left = [], [], np.arange(len(h1))
        placed = np.full(len(h1), -1, np.int64)
        start = 0
        while len(left):
            m = max(1, 2 * len(left))
            at = (mix(h1[left], h2[left], len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m)[at] == 1
            bits = np.zeros(m, bool)
            bits[at[alone]] = True
            placed[left[alone]] = start + at[alone]
            left = left[~alone]
            sizes.append(m)
            parts.append(bits)
            start += m
        out = cls(sizes, np.concatenate(parts) if parts else np.zeros(0, bool), h2[:0], n[:0])
        index = out.rank[placed]
        out.prints, out.counts = np.empty_like(h2), np.empty(len(n), np.uint16)
        out.prints[index] = h2
        out.counts[index] = np.minimum(n, COUNT_MAX)
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.sizes), *self.sizes, len(self.prints)], "<u8")
        return head.tobytes() + np.packbits(self.bits).tobytes() + self.prints.astype("<u8").tobytes() + self.counts.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        levels = int(np.frombuffer(raw, "<u8", 1)[0])
        head = np.frombuffer(raw, "<u8", levels + 2)
        sizes, n, at = [int(x) for x in head[1:-1]], int(head[-1]), 8 * (levels + 2)
        width = (sum(sizes) + 7) // 8
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, width, at))[: sum(sizes)].astype(bool)
        return cls(sizes, bits, np.frombuffer(raw, "<u8", n, at + width), np.frombuffer(raw, "<u2", n, at + width + 8 * n))

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The count of each key; 0 where the fingerprint differs or no level has the key."""
        out, left, start = np.zeros(len(h1), np.int64), np.arange(len(h1)), 0
        for level, m in enumerate(self.sizes):
            if not len(left):
                break
            at = start + (mix(h1[left], h2[left], level) % np.uint64(m)).astype(np.int64)
            found = self.bits[at]
            index = self.rank[at[found]]
            out[left[found]] = np.where(self.prints[index] == h2[left[found]], self.counts[index], 0)
            left, start = left[~found], start + m
        return out


def line_keys(text: Column) -> Column:
    """The key of each line: A-Z lower-cased, white space stripped at both ends."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: ascii_lower(F.btrim(x, F.lit(STRIP))))


def hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def line_hashes(docs: DataFrame, id_col: str, text: str, min_chars: int) -> DataFrame:
    """(rk1, rk2, hs) of each row: the hashes of its lines' keys in order, null for keys that are too short. Written, so that texts are split and hashed once."""
    counted = F.transform("keys", lambda x: F.when(F.char_length(x) >= min_chars, hashes(x)))
    split = docs.select(*row_key(F.col(id_col), F.col(text)), line_keys(F.col(text)).alias("keys"))
    return written(split.select("rk1", "rk2", counted.alias("hs")), "line-hashes")


@dataclass
class LineIndex:
    """(shard, blob) rows; the hot keys (h1, h2), whose shard is -1; the number of other shards; and the copies of either kind of shard."""

    blobs: DataFrame
    hot: DataFrame
    shards: int
    hot_copies: int
    copies: int


def line_index(hashed: DataFrame) -> LineIndex:
    each = hashed.select(F.explode(F.array_distinct(F.array_compact("hs"))).alias("h"))
    counts = written(each.groupBy("h.h1", "h.h2").agg(F.count(F.lit(1)).alias("n")), "line-counts")
    distinct, pairs = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    is_hot = (F.col("n") > 1) & (F.col("n") * HOT_SHARE >= max(pairs, 1))  # at most HOT_SHARE keys can have so large a share
    hot = counts.where(is_hot).select("h1", "h2")
    hot_keys, hot_pairs = counts.where(is_hot).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, -(-(distinct - hot_keys) // KEYS_PER_SHARD))
    places = lambda probes, least: min(MAX_COPIES, max(least, -(-probes // PROBES_PER_PLACE)))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "blob": [PerfectHash.build(h1, h2, rows["n"].to_numpy()).to_bytes()]})

    shard = F.when(is_hot, F.lit(-1)).otherwise(F.pmod("h1", F.lit(shards)))
    blobs = counts.select(shard.cast("long").alias("shard"), "h1", "h2", "n").groupBy("shard").applyInPandas(build, "shard long, blob binary")
    return LineIndex(blobs, hot, shards, places(hot_pairs, HOT_COPIES), places(-(-(pairs - hot_pairs) // shards), 1))


def shared_lines(docs: DataFrame, id_col: str, text: str, min_docs: int, min_chars: int) -> DataFrame:
    """(rk1, rk2, dropped): numbers of the lines, from 0, whose key at least min_docs documents hold."""
    if not 1 <= min_docs <= COUNT_MAX:
        raise ValueError(f"min_docs must be from 1 to {COUNT_MAX}")
    hashed = line_hashes(docs, id_col, text, min_chars)
    index = line_index(hashed)
    h = hashed.select("rk1", "rk2", F.posexplode("hs").alias("line", "h")).where("h IS NOT NULL").select("rk1", "rk2", "line", "h.h1", "h.h2")
    h = h.join(F.broadcast(index.hot.withColumn("hot", F.lit(True))), ["h1", "h2"], "left")  # HOT_SHARE rows at most
    shard = F.when(F.col("hot"), F.lit(-1)).otherwise(F.pmod("h1", F.lit(index.shards))).cast("long")
    copies = lambda s: F.when(s == -1, F.lit(index.hot_copies)).otherwise(F.lit(index.copies)).cast("long")
    place = shard * MAX_COPIES + F.pmod(F.xxhash64("rk1", "line"), copies(shard))
    probes = h.select(place.alias("place"), F.lit(1).alias("kind"), "rk1", "rk2", "line", "h1", "h2", F.lit(None).cast("binary").alias("blob"))
    zero, first = F.lit(0).cast("long"), F.col("shard") * MAX_COPIES
    places = F.explode(F.sequence(first, first + copies(F.col("shard")) - 1)).alias("place")
    blobs = index.blobs.select(places, F.lit(0).alias("kind"), zero.alias("rk1"), zero.alias("rk2"), F.lit(0).alias("line"), zero.alias("h1"), zero.alias("h2"), "blob")

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, arrays = None, None
        for rows in batches:
            place, kind = rows["place"].to_numpy(), rows["kind"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (kind[1:] != kind[:-1])])
            for a, b in zip(cuts, np.r_[cuts[1:], len(rows)], strict=True):
                if kind[a] == 0:
                    here, arrays = place[a], PerfectHash.from_bytes(rows["blob"].iloc[a])
                    continue
                if here != place[a]:
                    continue  # no key of this place was indexed
                part = rows.iloc[a:b]
                n = arrays.count(part["h1"].to_numpy(np.int64).view(np.uint64), part["h2"].to_numpy(np.int64).view(np.uint64))
                yield part.loc[n >= min_docs, ["rk1", "rk2", "line"]]

    dealt = probes.unionByName(blobs).repartition("place").sortWithinPartitions("place", "kind")
    hits = dealt.mapInPandas(probe, "rk1 long, rk2 long, line int")
    return hits.groupBy("rk1", "rk2").agg(F.collect_set("line").alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs as a struct ``row``, with ``kept`` (text without the shared lines), n_lines, n_dropped and the ``dropped`` line numbers."""
    dropped = shared_lines(docs, id_col, text, min_docs, min_chars)
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), *row_key(docs[id_col], docs[text])).join(dropped, ["rk1", "rk2"], "left").select("row", "dropped")

    # rows without shared lines stay in the JVM
    clean = rows.where(F.col("dropped").isNull()).select(
        "row", F.coalesce(f"row.{text}", F.lit("")).alias("kept"), F.size(F.split(F.coalesce(f"row.{text}", F.lit("")), "\n", -1)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), "dropped"
    )
    strip_one = F.pandas_udf(_strip, "struct<kept string, n_lines long, n_dropped long>")
    cut = rows.where(F.col("dropped").isNotNull()).select("row", strip_one(F.col(f"row.{text}"), "dropped").alias("x"), "dropped").select("row", "x.kept", "x.n_lines", "x.n_dropped", "dropped")
    return clean.unionByName(cut)


def _strip(text: pd.Series, dropped: pd.Series) -> pd.DataFrame:
    out = []
    for value, gone in zip(text, dropped, strict=True):
        lines, gone = (value or "").split("\n"), {int(x) for x in gone}
        out.append(("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return pd.DataFrame(out, columns=["kept", "n_lines", "n_dropped"])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, rn, u.i AS i, u.line AS line,
         translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, row_number() OVER () AS rn, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(ls) AS line, unnest(range(len(ls))) AS i) u),
bad AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rn) >= 10),
marked AS (SELECT lines.*, bad.key IS NOT NULL AS gone FROM lines LEFT JOIN bad USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rn, doc_id
"""
