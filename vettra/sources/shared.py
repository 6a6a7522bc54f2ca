"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode a temporary folder where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="vettra-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Paths given out inside `scratch` blocks, the innermost last.
_OWNED: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OWNED:
        _OWNED[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Owns the intermediate tables of the queries in its block and deletes them at its end: read or write results inside."""
    _OWNED.append([])
    try:
        yield
    finally:
        for path in _OWNED.pop():
            delete(spark, path)


def written(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, outlives executors, and is read instead of planned anew."""
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(*partitions).parquet(path)
    columns = [f for f in df.schema if f.name not in partitions] + [f for f in df.schema if f.name in partitions]
    found = df.sparkSession.read.schema(type(df.schema)(columns)).parquet(path).select(*df.columns)
    found.written_to = path
    return found


def written_parts(parts: dict[str, DataFrame], column: str, name: str) -> DataFrame:
    """The parts' rows with their names as a column, each written on its own under its name: nothing is sorted for the writing, and readers of some parts skip the others."""
    first = next(iter(parts.values()))
    path = fresh_path(first.sparkSession, name)
    for part, df in parts.items():
        df.write.parquet(f"{path}/{column}={part}")
    found = first.sparkSession.read.schema(type(first.schema)([*first.schema, *type(first.schema)().add(column, "string")])).parquet(path)
    found.written_to = path
    return found


def drop(df: DataFrame) -> None:
    """Deletes what `written` wrote for df, once nothing reads it any more."""
    delete(df.sparkSession, df.written_to)


def delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
