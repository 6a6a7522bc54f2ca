"""Order-dependent selections inside a packet, as windows over (packet, ordinal)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def one_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in this order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def last_per_type(docs: DataFrame) -> DataFrame:
    """The last document of each type, at the place of the type's first one."""
    w = Window.partitionBy("packet_id", "doc_type")
    return one_per(docs.withColumn("position", F.min("ordinal").over(w)), ["packet_id", "doc_type"], F.desc("ordinal"))


def against_first(docs: DataFrame, value: str) -> DataFrame:
    """Documents whose value differs from the packet's first non-null one (column ``reference``)."""
    w = Window.partitionBy("packet_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return docs.withColumn("reference", F.first(value, ignorenulls=True).over(w)).where(F.col(value) != F.col("reference"))


def first_values(docs: DataFrame, **values) -> DataFrame:
    """One row a packet: the first non-null of each expression in document order (null last)."""
    return docs.groupBy("packet_id").agg(*(F.min_by(v, F.when(v.isNotNull(), F.col("ordinal"))).alias(n) for n, v in values.items()))


def top_n(df: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    """n rows of each key, numbered from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
