"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and, but
for the last, returns the columns of documents. Texts that line dedup shortens get a new
n_chars. Rows with nulls, empty texts or repeated ids go through like any other.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vettra.llm import decontamination, language_id, line_dedup, sentencepiece_codec, simhash_dedup
from vettra.llm.common import drop, table, written

PIECES = os.environ.get("VETTRA_PIECE_MODEL", "")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents without a recognisable language (no letters, or null text) go.

    Where no learnable row has a language there is no network, and by itself no text is
    ``und`` for that: null and letterless texts go, all others stay.
    """
    net = language_id.fit(docs, language_id.learnable(F.col("doc_id")))
    if net is None:
        return language_id.lettered(docs)
    return language_id.identify(docs, net).where(F.col("lang_pred") != language_id.UNKNOWN).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: lines that 10 or more documents share go."""
    out = line_dedup.dedup_lines(docs)
    kept = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return out.select(*(kept.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each group of near copies stays."""
    return simhash_dedup.dedup_near(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents contaminated by the benchmark go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: (doc_id, n_ids, ids_sha256, decoded_sha256, round_trip) of every document left."""
    path = PIECES
    if not path:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece_codec.digests(sentencepiece_codec.encode_documents(docs.select("doc_id", "text"), path))


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding", encoded),
]

#: SQL has no convolutional network, XXH64 or SentencePiece; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if name != STAGES[0][0]:
            drop(before)  # a stage's table is read by the next stage only
    return STAGES[-1][1](spark, docs, sf_dir)
