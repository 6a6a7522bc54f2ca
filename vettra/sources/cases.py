"""The tables of submitted cases, and submission into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vettra.operators import evidence as ev
from vettra.sources.versions import Store

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "timestamp": T.TimestampType()}


def _table(ddl: str) -> T.StructType:
    columns = [c.split() for c in ddl.split(", ")]
    return T.StructType([T.StructField(c[0], _TYPES[c[1]], c[2:] != ["not", "null"]) for c in columns])


#: Table definitions; columns that came later are nullable and may be missing in older parts.
TABLES = {
    "users": _table("id string not null, email string not null, role string not null, created_at timestamp"),
    "cases": _table("id string not null, user_id string not null, purpose string, status string, trust_score double, action string, decision string, verification string, loan_amount double, tenure_months int"),
    "case_docs": _table("id string not null, case_id string not null, filename string not null, doc_type string, fields string, kyc string"),
}
KEYS = {"users": ("id",), "cases": ("id",), "case_docs": ("case_id",)}


def store(spark: SparkSession, folder: str, name: str) -> Store:
    return Store(spark, f"{folder}/{name}", KEYS[name])


def shaped(df: DataFrame, name: str) -> DataFrame:
    """df with the table's columns in order, nulls for those it lacks; the job fails where a required one is null."""
    schema = TABLES[name]
    out = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
    required = [F.col(f.name).isNotNull() for f in schema if not f.nullable]
    fine = required[0]
    for r in required[1:]:
        fine = fine & r
    return out.where(F.assert_true(fine, F.lit(f"a required column of {name} is null")).isNull())


def submit(spark: SparkSession, folder: str, decisions: DataFrame, docs: DataFrame, token: str) -> None:
    """Stores decided packets as cases with their documents; submitted again, a packet's case and documents are replaced.

    decisions: (packet_id, user_id, purpose, trust_score, action, decision, verification, loan_amount, tenure_months).
    docs: (packet_id, filename, doc_type, fields, kyc).
    """
    case = ev.row_id("case", F.lit("packet"), "packet_id")
    store(spark, folder, "case_docs").replace(shaped(docs.withColumns({"case_id": case, "id": ev.row_id("cd", "packet_id", "filename")}), "case_docs"), token)
    store(spark, folder, "cases").replace(shaped(decisions.withColumns({"id": case, "status": F.lit("completed")}), "cases"), token)  # a case is there once its documents are
