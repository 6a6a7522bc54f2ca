"""Operator 10, language ID: a convolutional network over bytes, trained in numpy.

A text's UTF-8 bytes (A-Z lower-cased) are cut into windows of WINDOW bytes, the last one
padded with zeros. Filters of several widths slide over a window; a filter is a table of
one weight for each offset and byte value. Each filter's rectified maximum over the window
goes through a softmax layer. A document's probabilities are the means over all its
windows, weighted by their bytes. Windows of many texts go through the network together.

Training takes at most DOCS_PER_LANG labelled documents for each language, chosen by a
hash of the id, and WINDOWS_PER_DOC windows of each; the windows, a few MB, are fitted on
the driver. Prediction covers whole texts on the executors.

Defined results: null text or text without any letter is ``und`` with score 0; with no
labelled row, everything is ``und``; of equal probabilities the language first in order
wins; long texts are windowed whole; an empty table gives an empty result; null ids count as not held out and their text may train; rows are independent, so repeated rows repeat their result; other columns are kept
by ``identify`` unless it is told to select.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vettra.llm.common import table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DOCS_PER_LANG = 600
WINDOWS_PER_DOC = 4
EPOCHS = 12
CHUNK = 128  # windows in one forward pass
WAITING = 4096  # windows of one batch of texts
UNKNOWN = "und"


def windows(text: str) -> np.ndarray:
    """(n, WINDOW) bytes of the whole text, the last row padded with zeros."""
    raw = text.encode("utf-8", "replace").lower()
    n = -(-len(raw) // WINDOW)
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


@dataclass
class ByteConvNet:
    langs: list[str]
    tables: list[np.ndarray] = field(default_factory=list)  # for each width: (width, 256, FILTERS)
    weights: np.ndarray | None = None  # (len(WIDTHS) * FILTERS, langs)
    bias: np.ndarray | None = None

    def convolve(self, x: np.ndarray, table: np.ndarray) -> np.ndarray:
        width, length = len(table), x.shape[1] - len(table) + 1
        out = table[0].take(x[:, :length], axis=0)
        for j in range(1, width):
            out += table[j].take(x[:, j : j + length], axis=0)
        return out

    def pooled(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.maximum(self.convolve(x, t).max(axis=1), 0) for t in self.tables], axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = [np.zeros((0, len(self.langs)), np.float32)]
        for a in range(0, len(x), CHUNK):
            z = self.pooled(x[a : a + CHUNK]) @ self.weights + self.bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(e / e.sum(axis=1, keepdims=True))
        return np.concatenate(out)


def train(x: np.ndarray, y: np.ndarray, langs: list[str], seed: int = 1) -> ByteConvNet:
    """Adam over minibatches; the gradient of a maximum goes to its place only."""
    rng = np.random.default_rng(seed)
    net = ByteConvNet(langs, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS])
    net.weights = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
    net.bias = np.zeros(len(langs), np.float32)
    params = [*net.tables, net.weights, net.bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(order), 64):
            at = order[a : a + 64]
            bx, n = x[at], len(at)
            places, tops = [], []
            for t in net.tables:
                out = net.convolve(bx, t)
                place = out.argmax(axis=1)
                places.append(place)
                tops.append(np.take_along_axis(out, place[:, None, :], axis=1)[:, 0])
            h = np.concatenate(tops, axis=1)
            hidden = np.maximum(h, 0)
            z = hidden @ net.weights + net.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y[at]] -= 1
            p /= n
            back = (p @ net.weights.T) * (h > 0)
            grads = []
            for k, (t, place) in enumerate(zip(net.tables, places, strict=True)):
                g, part = np.zeros_like(t), back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(len(t)):
                    byte = np.take_along_axis(bx, place + j, axis=1)
                    np.add.at(g[j], (byte, np.arange(FILTERS)[None, :].repeat(n, 0)), part)
                grads.append(g)
            grads += [hidden.T @ p, p.sum(axis=0)]
            step += 1
            for i, (param, g) in enumerate(zip(params, grads, strict=True)):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                param -= 0.01 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return net


def chosen_ids(labelled: DataFrame) -> DataFrame:
    """(id, lang) of the DOCS_PER_LANG least draws of each language, a draw being a hash of the id.

    Draws beyond twice the share that a language needs go first, so that no task gets all
    rows of a common language.
    """
    draw = F.xxhash64("id")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))  # a row for each language
    share = F.least(F.lit(1.0), F.lit(2.0 * DOCS_PER_LANG) / F.col("size"))
    few = labelled.join(F.broadcast(sizes), "lang").where((draw / F.lit(2.0**64) + 0.5) <= share).select("id", "lang", draw.alias("draw")).distinct()
    order = Window.partitionBy("lang").orderBy("draw", "id")
    return few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= DOCS_PER_LANG).select("id", "lang")


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> ByteConvNet | None:
    """A network from the rows where `learn` holds and the language is known; None without any.

    Rows labelled ``und`` don't train, nor do chosen documents without text. Of rows that
    share id and language, one trains.
    """
    labelled = docs.where(F.coalesce(learn, F.lit(False)) & F.col(lang).isNotNull() & (F.col(lang) != UNKNOWN))
    labelled = labelled.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for t, y in zip(rows["text"], rows["lang"], strict=True):
                x = windows(t)
                at = np.unique(np.linspace(0, max(0, len(x) - 2), WINDOWS_PER_DOC).astype(int))
                out += [(y, x[k].tobytes()) for k in at]
            yield pd.DataFrame(out, columns=["lang", "window"])

    ids = F.broadcast(chosen_ids(labelled))  # DOCS_PER_LANG for each language at most
    same = F.col("id").eqNullSafe(F.col("chosen"))
    texts = labelled.join(ids.select(F.col("id").alias("chosen"), F.col("lang").alias("of")), same & (F.col("lang") == F.col("of")), "left_semi")
    texts = texts.where(F.length("text") > 0).groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = texts.mapInPandas(sample, "lang string, window binary").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values(["lang", "window"])
    langs = sorted(rows["lang"].unique())
    return train(np.stack([np.frombuffer(w, np.uint8) for w in rows["window"]]), np.array([langs.index(x) for x in rows["lang"]]), langs)


def predictor(net: ByteConvNet | None) -> Callable[[pd.Series], pd.DataFrame]:
    """Predicts a batch of texts: the windows of many texts go through the network together."""

    def predict(texts: pd.Series) -> pd.DataFrame:
        import regex

        letter = regex.compile(r"\p{L}")
        langs, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if not held:
                return
            at, cuts = [i for i, _ in held], np.cumsum([0, *(len(x) for _, x in held)])
            x = np.concatenate([x for _, x in held])
            size = np.full(len(x), WINDOW, np.float64)
            ends = cuts[1:] - 1
            size[ends] = np.count_nonzero(x[ends], axis=1)
            total = np.add.reduceat(net.probabilities(x) * size[:, None], cuts[:-1], axis=0)
            mean = total / np.add.reduceat(size, cuts[:-1])[:, None]
            best = mean.argmax(axis=1)
            langs[at], scores[at] = np.array(net.langs, object)[best], np.minimum(1.0, mean[np.arange(len(best)), best])
            held.clear()

        waiting = 0
        for i, t in enumerate(texts):
            if net is not None and t is not None and letter.search(t):
                held.append((i, windows(t)))
                waiting += len(held[-1][1])
                if waiting >= WAITING:
                    flush()
                    waiting = 0
        flush()
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict


def identify(docs: DataFrame, net: ByteConvNet | None, text: str = "text") -> DataFrame:
    """(row, lang_pred, score): each row as a struct with its predicted language."""
    udf = F.pandas_udf(predictor(net), "lang_pred string, score double")
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    return docs.select(row, udf(docs[text]).alias("p")).select("row", "p.lang_pred", "p.score")


def lettered(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text has a letter: what a network would not call ``und``."""

    def has_letter(texts: pd.Series) -> pd.Series:
        import regex

        letter = regex.compile(r"\p{L}")
        return pd.Series([t is not None and letter.search(t) is not None for t in texts], dtype=bool)

    return docs.where(F.pandas_udf(has_letter, "boolean")(docs[text]))


def remainder(id_col: Column, by: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(id_col.cast("string").cast("binary")) % by


def learnable(id_col: Column) -> Column:
    return F.coalesce(remainder(id_col, 4) != 2, F.lit(True))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs, learnable(F.col("doc_id")))
    out = identify(docs.select("doc_id", "text"), net)
    return out.select("row.doc_id", (~learnable(F.col("row.doc_id"))).alias("held_out"), "lang_pred", "score")
