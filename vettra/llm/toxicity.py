"""Operator 7, toxicity by compression distance between two zstandard dictionaries.

Training counts, over labelled documents with distinct texts, in how many toxic and
ordinary ones each word occurs. Two raw-content dictionaries of the same size share the
neutral words, most frequent last; one ends with the words typical of toxic text, the
other with those typical of ordinary text (log-likelihood ratio above LLR), so that a
window's lengths under the two differ only by what tells the classes apart.

A window is one word with the blanks around it, compressed between a constant lead-in and
end that both dictionaries hold: zstandard would store so short a window raw without the
first, and would not search its last bytes without the second. A text's
features are how many windows, in number and as a rate, are shorter by 3 to 7 bytes or
more with the toxic dictionary; a logistic regression turns them into a probability.

The windows are single words, and the dictionaries lists of a class's words, because
longer windows of running text and dictionaries that zstandard trains itself were measured
and find far fewer toxic documents (README).

Training takes at most TRAIN_DOCS labelled documents, chosen by a hash of the id, one row of
each id; the driver gets at most DICTIONARY_WORDS words of each kind and one row of features for each
training document. Scoring covers whole texts; a bounded cache keeps words' differences.

Defined results: null text scores as empty text; without both classes among the training
rows every score is 0; conflicting labels of one id count as toxic; null labels are
ignored; texts of any length are scored whole; scores have no ties to break; rows are
independent, so repeated rows repeat their result; an empty table gives an empty result;
other columns are ignored (op7) or kept (classify).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vettra.llm.common import ascii_lower, table, written

DICTIONARY_BYTES = 16 * 1024
DICTIONARY_WORDS = 8000
LLR = 15.0
FRAME_BYTES = 24  # of the lead-in and of the end
STEPS = (3, 4, 5, 6, 7)
TRAIN_DOCS = 20_000
CACHE_WORDS = 300_000
WORD = re.compile(rb"[a-z\x80-\xff]+")
THRESHOLD = 0.7


class WordDistance:
    """Bytes by which the toxic dictionary compresses a word's window better than the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes, frame: bytes):
        import zstandard as z

        self.lead, self.end, self.cache = frame[:FRAME_BYTES], frame[FRAME_BYTES:], {}
        params = z.ZstdCompressionParameters(
            strategy=z.STRATEGY_LAZY2, window_log=17, chain_log=18, hash_log=18, search_log=6, min_match=4, target_length=16,
            write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS,
        )
        made = []
        for content in (ordinary, toxic):
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            made.append(z.ZstdCompressor(dict_data=d, compression_params=params).compress)
        self.ordinary, self.toxic = made

    def distances(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").encode("utf-8", "replace").lower())
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        for w in set(words).difference(self.cache):
            x = b"%b %b %b" % (self.lead, w, self.end)
            self.cache[w] = len(self.ordinary(x)) - len(self.toxic(x))
        return np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))


def features(distances: np.ndarray) -> list[float]:
    n, out = max(1, len(distances)), [1.0]
    for step in STEPS:
        c = int((distances >= step).sum())
        out += [math.log1p(c), math.log1p(200 * c / n)]
    return [*out, math.log1p(len(distances))]


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    frame: bytes
    weights: list[float] | None

    def scorer(self) -> Callable[[pd.Series], pd.Series]:
        def score(texts: pd.Series) -> pd.Series:
            if self.weights is None:
                return pd.Series(np.zeros(len(texts)))
            known, w = WordDistance(self.ordinary, self.toxic, self.frame), np.array(self.weights)
            return pd.Series([1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(features(known.distances(t)), w)))))) for t in texts])

        return score


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.3) -> np.ndarray:
    """Newton's method; the intercept is not shrunk."""
    w, shrink = np.zeros(x.shape[1]), l2 * np.r_[0, np.ones(x.shape[1] - 1)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9), x.T @ (p - y) + shrink * w)
    return w


def word_counts(sample: DataFrame) -> DataFrame:
    """(word, toxic, ordinary, llr): documents with distinct texts that hold each word; llr is positive for toxic words."""
    words = F.array_distinct(F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(r"([a-z\x{80}-\x{10ffff}]+)"), 1))
    distinct = sample.groupBy(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(7), "text").alias("g")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in distinct.groupBy("toxic").count().collect()}
    n1, n0 = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    counts = distinct.select(F.explode(words).alias("word"), "toxic").groupBy("word").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    counts = counts.where((F.col("a") + F.col("b") >= 3) & (F.length("word") > 1))
    p = (F.col("a") + F.col("b")) / (n1 + n0)

    def term(k: Column, n: float) -> Column:
        rest = F.lit(n) - k
        return F.when(k > 0, k * F.ln(k / n / p)).otherwise(0.0) + F.when(rest > 0, rest * F.ln((rest / n) / (1 - p))).otherwise(0.0)

    g = 2 * (term(F.col("a"), n1) + term(F.col("b"), n0))
    return counts.where(p < 1).select("word", "a", "b", F.when(F.col("a") / n1 > F.col("b") / n0, g).otherwise(-g).alias("llr"))


def tail(words: list[str], size: int) -> bytes:
    """The last words that fit, blank-separated: zstandard reaches the end of a dictionary with the shortest offsets."""
    out, n = [], 0
    for w in (w.encode() for w in reversed(words)):
        n += len(w) + 1
        if n > size:
            break
        out.append(w)
    return b"".join(w + b" " for w in reversed(out))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text", toxic: str = "toxic") -> ToxicityModel:
    """A model from labelled rows of `docs`; `learn` is a condition on the id."""
    known = labels.where(F.coalesce(learn, F.lit(False)) & F.col(toxic).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(toxic).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    # one row of each id, so that the bound on ids bounds what the driver gets
    sample = written(rows.groupBy("id", "toxic").agg(F.min_by("text", F.coalesce(F.xxhash64("text"), F.lit(0))).alias("text")).select("id", "text", "toxic"), "toxicity-sample")
    if sample.select("toxic").distinct().count() < 2:
        return ToxicityModel(b"", b"", b"", None)
    counts = written(word_counts(sample), "word-counts")
    top = lambda df, *order: [r.word for r in df.orderBy(*order, "word").limit(DICTIONARY_WORDS).select("word").collect()][::-1]
    neutral = top(counts.where(F.abs("llr") <= LLR), F.desc(F.col("a") + F.col("b")))
    marks = [tail(top(counts.where(c), o), DICTIONARY_BYTES // 4) for c, o in ((F.col("llr") < -LLR, F.asc("llr")), (F.col("llr") > LLR, F.desc("llr")))]
    base = b" " + tail(neutral, DICTIONARY_BYTES * 3 // 4)
    width = max(map(len, marks))
    fill = tail(neutral[: len(neutral) // 2], width).rjust(width)
    middle = base[len(base) // 2 :]
    frame = middle[:FRAME_BYTES] + middle[4 * FRAME_BYTES :][:FRAME_BYTES]
    # the last bytes of a dictionary are not searched either
    ordinary, toxic_end = (base + fill[: width - len(m)] + m + frame for m in marks)
    model = ToxicityModel(ordinary, toxic_end, frame, None)

    def measured(texts: pd.Series) -> pd.Series:
        known = WordDistance(model.ordinary, model.toxic, model.frame)
        return pd.Series([features(known.distances(t)) for t in texts])

    rows = sample.select("id", "toxic", F.pandas_udf(measured, "array<double>")("text").alias("x")).toPandas().sort_values("id")
    model.weights = logistic(np.array(rows["x"].tolist()), rows["toxic"].to_numpy(float)).tolist()
    return model


def classify(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """(row, score, predicted): each row as a struct with its toxicity."""
    score = F.pandas_udf(model.scorer(), "double")
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    return docs.select(row, score(docs[text]).alias("score")).select("row", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def learnable(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 != 1, F.lit(True))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), learnable(F.col("doc_id")))
    return classify(docs, model).select("row.doc_id", (~learnable(F.col("row.doc_id"))).alias("held_out"), "score", "predicted")
