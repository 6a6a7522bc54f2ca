"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vettra.sources.shared import drop, fresh_path, shared_dir, written

__all__ = ["ascii_lower", "drop", "fresh_path", "row_key", "shared_dir", "small_batches", "table", "written"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else as it is. ASCII texts take the way of lower(), which is faster than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(*cols: Column) -> list[Column]:
    """Two 64-bit hashes over whole values, null-aware: equal rows have equal keys. Columns rk1 and rk2."""
    parts = [x for c in cols for x in (c.isNull(), c)]
    return [F.xxhash64(*parts).alias("rk1"), F.xxhash64(F.lit(7), *parts).alias("rk2")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, for operators whose workers hold several forms of each text at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
