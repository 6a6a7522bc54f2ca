"""Tables in versions: Parquet parts, and for each version a manifest of the parts that belong to it.

A commit writes its parts to a folder of their own and then creates the next manifest,
which fails if another commit made it first; the commit is then made anew on top of that
one. So readers see whole versions only, older versions stay readable while newer ones are
written, and what lost or repeated tasks leave behind belongs to no version. A commit
carries a token: made twice (by a driver that was restarted, say), it counts once.

Rows are bucketed by a hash of the key columns, and a replacement rewrites the buckets it
touches. Later parts may have more columns; earlier rows have nulls there.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16


@dataclass
class Version:
    number: int = 0
    token: str = ""
    parts: list[dict] = field(default_factory=list)  # path, bucket and schema of each

    def schema(self) -> T.StructType:
        """The columns of all parts, in the order in which they came."""
        seen: dict[str, T.StructField] = {}
        for p in self.parts:
            for f in T.StructType.fromJson(p["schema"]):
                seen.setdefault(f.name, T.StructField(f.name, f.dataType, True))
        return T.StructType(list(seen.values()))


@dataclass
class Store:
    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int = BUCKETS

    def _fs(self):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(context._jsc.hadoopConfiguration()), context._jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        fs, path = self._fs()
        folder = path(f"{self.path}/_versions")
        return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def version(self, number: int | None = None) -> Version:
        """A version by number, the newest by default; version 0 is empty."""
        known = self.versions()
        number = known[-1] if number is None and known else number or 0
        if not number:
            return Version()
        fs, path = self._fs()
        source = fs.open(path(f"{self.path}/_versions/{number:08}.json"))
        try:
            return Version(**json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")))
        finally:
            source.close()

    def read(self, number: int | None = None, empty: T.StructType | None = None) -> DataFrame:
        """The rows of a version. A table that was never written has the schema `empty`, or no columns."""
        v = self.version(number)
        return self._rows(v.parts, v.schema() if v.parts else empty or T.StructType())

    def _rows(self, parts: list[dict], schema: T.StructType) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p['path']}" for p in parts))

    def _written(self, df: DataFrame) -> list[dict]:
        """df's rows as parts, one for each bucket that has some."""
        folder = f"data/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        # a bucket goes to several tasks, a key to one of them; ranges would make the rows once more, to sample them
        slices = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        df.withColumn("__bucket", bucket).repartition("__bucket", F.pmod(F.xxhash64(F.lit(1), *self.keys), F.lit(slices))).write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        fs, path = self._fs()
        found = [s.getPath().getName() for s in fs.listStatus(path(f"{self.path}/{folder}"))]
        schema = json.loads(df.schema.json())
        return [{"path": f"{folder}/{n}", "bucket": int(n.split("=")[1]), "schema": schema} for n in sorted(found) if n.startswith("__bucket=")]

    def _created(self, v: Version) -> bool:
        """Whether this commit made the manifest, and no other before it."""
        fs, path = self._fs()
        try:
            out = fs.create(path(f"{self.path}/_versions/{v.number:08}.json"), False)
        except Exception as e:
            if fs.exists(path(f"{self.path}/_versions/{v.number:08}.json")):
                return False
            raise e
        out.write(bytearray(json.dumps(v.__dict__).encode()))
        out.close()
        return True

    def _committed(self, token: str) -> int | None:
        return next((n for n in reversed(self.versions()) if self.version(n).token == token), None)

    def append(self, df: DataFrame, token: str) -> int:
        """Adds rows; returns the version that has them."""
        parts = None
        while (done := self._committed(token)) is None:
            parts = self._written(df) if parts is None else parts
            last = self.version()
            if self._created(Version(last.number + 1, token, last.parts + parts)):
                return last.number + 1
        return done

    def replace(self, df: DataFrame, token: str) -> int:
        """Puts df's rows in the place of all rows with their keys; returns the version that has them."""
        while (done := self._committed(token)) is None:
            last = self.version()
            bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
            touched = {r[0] for r in df.select(bucket).distinct().collect()}  # a number of buckets at most
            old = [p for p in last.parts if p["bucket"] in touched]
            kept = self._rows(old, last.schema()).join(df.select(*self.keys).distinct(), list(self.keys), "left_anti") if old else None
            rows = df if kept is None else kept.unionByName(df, allowMissingColumns=True)
            parts = [p for p in last.parts if p["bucket"] not in touched] + self._written(rows)
            if self._created(Version(last.number + 1, token, parts)):
                return last.number + 1
        return done

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the newest versions and the folders that these don't need; returns how many folders went."""
        fs, path = self._fs()
        known = self.versions()
        needed = {p["path"].split("/")[1] for n in known[-keep:] for p in self.version(n).parts}
        gone = [s.getPath() for s in fs.listStatus(path(f"{self.path}/data")) if s.getPath().getName() not in needed] if known else []
        for n in known[:-keep]:
            fs.delete(path(f"{self.path}/_versions/{n:08}.json"), False)
        for p in gone:
            fs.delete(p, True)
        return len(gone)
