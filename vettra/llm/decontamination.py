"""Operator 2, benchmark decontamination by winnowing.

For items of at least SPAN words, each text keeps the least hash (the rightmost of ties)
of every W consecutive k-grams, with k + W - 1 = SPAN: any SPAN words that a document
shares with an item hold W whole k-grams, so both keep the same one. Shorter items are one
window of n words; for each such n, all n-grams are kept. Kept hashes of documents that
pass a Bloom filter of fixed size over the items' hashes are joined with the items' by
hash; a hash that many documents hold is spread over SALTS tasks, with the items' side, which
is small beside the documents', copied. Each side carries the hashes of the words around its k-gram as far as a window can
reach, so the join extends a hit to both sides without the texts: the longest common run
counts if it is at least a window long.

Defined results: null or wordless documents have no words and are clean; items without
words or without id take no part; items that share an id count as one; repeated documents
repeat their result; an empty benchmark leaves all clean, an empty table of documents gives an
empty result; texts of any length are taken whole; ties do not arise; other columns are ignored (op2)
or kept (decontaminate).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vettra.llm.common import row_key, table, written

SPAN, GRAM = 13, 8
BLOOM_BITS = 1 << 24
SALTS = 32
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
CANDIDATE = "struct<fp: long, n: int, at: long, near: binary>"


def word_hashes(text: str | None) -> np.ndarray:
    import xxhash

    words = WORD.findall((text or "").encode("utf-8", "replace").lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, k: int, n: int) -> np.ndarray:
    """A hash of each k consecutive words, for windows of n words."""
    m = len(words) - k + 1
    if m < 1:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(m, n, np.uint64)
        for j in range(k):
            h = (h ^ words[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return h


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of each window's least hash, the rightmost of equal ones."""
    if window == 1 or len(h) < window:
        return np.arange(len(h) if window == 1 else 0)
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(view)) + window - 1 - view[:, ::-1].argmin(axis=1))


def kept_grams(words: np.ndarray, spans: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, hashes) for each window length n."""
    for n in spans:
        k = GRAM if n == SPAN else n
        if len(words) >= n:
            h = gram_hashes(words, k, n)
            at = winnow(h, n - k + 1)
            yield n, at, h[at]


def surroundings(words: np.ndarray, n: int, at: np.ndarray, pad: int) -> list[bytes]:
    """Word hashes from n - k before each k-gram to n - k behind it; `pad` beyond the text."""
    k = GRAM if n == SPAN else n
    wide = np.concatenate([np.full(n - k, pad, np.uint64), words, np.full(n - k, pad, np.uint64)])
    return [wide[a : a + 2 * n - k].tobytes() for a in at]


def bloom_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(8)) % np.uint64(BLOOM_BITS), (h >> np.uint64(36)) % np.uint64(BLOOM_BITS)


def item_grams(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, fp, n, near) of the items' kept k-grams."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for item, t in zip(rows["item_id"], rows["text"], strict=True):
                words = word_hashes(t)
                for n, at, h in kept_grams(words, [min(len(words), SPAN)] if len(words) else []):
                    out += [(item, int(x), n, near) for x, near in zip(h.view(np.int64), surroundings(words, n, at, 2), strict=True)]
            yield pd.DataFrame(out, columns=["item_id", "fp", "n", "near"])

    rows = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text"))
    return rows.mapInPandas(task, "item_id string, fp long, n int, near binary").distinct()


def bloom_filter(grams: DataFrame) -> np.ndarray:
    """BLOOM_BITS bits over all fp, put together by Spark; the driver gets BLOOM_BITS / 64 words at most."""
    first = F.pmod(F.shiftrightunsigned("fp", 8), F.lit(BLOOM_BITS))
    second = F.pmod(F.shiftrightunsigned("fp", 36), F.lit(BLOOM_BITS))
    bits = grams.select(F.explode(F.array(first, second)).alias("b"))
    words = bits.groupBy(F.floor(F.col("b") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("v"))
    out = np.zeros(BLOOM_BITS // 64, np.int64)
    found = words.toPandas()
    out[found["w"].to_numpy(np.int64)] = found["v"].to_numpy(np.int64)
    return out.view(np.uint64)


def hit_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, rk1, rk2, n_words) of each document, and (rk1, rk2, item_id, a, b): words a to b-1 are the longest run around a hit of the item."""
    spark = docs.sparkSession
    grams = written(item_grams(items, item_id, item_text), "benchmark-grams")
    spans = sorted(r.n for r in grams.select("n").distinct().collect())  # 1 to SPAN
    bloom = spark.sparkContext.broadcast(bloom_filter(grams))

    def candidates(texts: pd.Series) -> pd.DataFrame:
        bits, out = bloom.value, []
        for t in texts:
            words, found = word_hashes(t), []
            for n, at, h in kept_grams(words, spans):
                x, y = bloom_places(h)
                near = ((bits[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & (bits[(y >> np.uint64(6)).astype(np.int64)] >> (y & np.uint64(63))) & np.uint64(1)).astype(bool)
                at, h = at[near], h[near]
                found += [{"fp": int(f), "n": n, "at": int(a), "near": s} for f, a, s in zip(h.view(np.int64), at, surroundings(words, n, at, 1), strict=True)]
            out.append((len(words), found))
        return pd.DataFrame(out, columns=["n_words", "found"])

    udf = F.pandas_udf(candidates, f"n_words long, found array<{CANDIDATE}>")
    base = written(docs.select(F.col(id_col).alias("id"), *row_key(F.col(id_col), F.col(text)), udf(F.col(text)).alias("x")).select("id", "rk1", "rk2", "x.n_words", "x.found"), "candidates")
    salt = F.pmod(F.xxhash64("rk1", "rk2", "c.at"), F.lit(SALTS)).cast("int").alias("salt")
    asked = base.select("rk1", "rk2", F.explode("found").alias("c")).select("rk1", "rk2", "c.fp", "c.n", "c.at", F.col("c.near").alias("doc_near"), salt)
    # items that hold the same words around a k-gram are compared once
    contexts = grams.groupBy("fp", "n", "near").agg(F.collect_set("item_id").alias("items"))
    pairs = asked.join(contexts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["fp", "n", "salt"])

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for n, part in rows.groupby("n"):
                k = GRAM if n == SPAN else n
                same = np.stack([np.frombuffer(x, np.uint64) for x in part["doc_near"]]) == np.stack([np.frombuffer(x, np.uint64) for x in part["near"]])
                r = n - k
                left = np.cumprod(same[:, :r][:, ::-1], axis=1).sum(axis=1) if r else np.zeros(len(part), np.int64)
                right = np.cumprod(same[:, r + k :], axis=1).sum(axis=1) if r else np.zeros(len(part), np.int64)
                ok = same[:, r : r + k].all(axis=1) & (left + k + right >= n)
                at = part["at"].to_numpy(np.int64)
                yield part.assign(a=at - left, b=at + k + right).loc[ok, ["rk1", "rk2", "items", "a", "b"]]

    found = pairs.select("rk1", "rk2", "items", "n", "at", "doc_near", "near").mapInPandas(extend, "rk1 long, rk2 long, items array<string>, a long, b long")
    hits = found.select("rk1", "rk2", F.explode("items").alias("item_id"), "a", "b")
    return base.select("id", "rk1", "rk2", "n_words"), hits


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """(id, rk1, rk2, n_words, n_hit, items, contaminated): `items` is the sorted array of item ids, as strings, whose windows occur."""
    base, hits = hit_spans(docs, items, id_col, text, **names)
    spans = hits.groupBy("rk1", "rk2").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    zero = F.lit(0).cast("long")
    covered = F.aggregate(
        "spans",
        F.struct(zero.alias("n"), zero.alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(zero, x["b"] - F.greatest(x["a"], s["end"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")),
    )["n"]
    counted = spans.select("rk1", "rk2", covered.alias("n_hit"), "items")
    n_hit = F.coalesce("n_hit", zero)
    return base.join(counted, ["rk1", "rk2"], "left").select(
        "id", "rk1", "rk2", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated")
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = contamination(docs, items, id_col, text).where("contaminated").select("rk1", "rk2").distinct()
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), *row_key(docs[id_col], docs[text]))
    return rows.join(bad, ["rk1", "rk2"], "left_anti").select("row.*")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item, w, least({SPAN}, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
docs AS (SELECT row_number() OVER () AS rn, doc_id, {_WORDS} AS w FROM documents),
asked AS (SELECT rn, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT rn, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT rn, n, i, item FROM asked JOIN windows USING (n, win)),
hit AS (SELECT rn, count(DISTINCT place) AS n_hit FROM (SELECT rn, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT rn, i, n FROM found)) GROUP BY rn),
named AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rn, item FROM found) GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM docs LEFT JOIN hit USING (rn) LEFT JOIN named USING (rn)
"""
