"""Versioned tables: whole versions, retried and competing commits, replaced keys, grown schemas, cleaning up."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vettra.sources import cases, shared
from vettra.sources.versions import Store


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_versions_stay_readable(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), ("k",), buckets=4)
    empty = T.StructType([T.StructField("k", T.LongType())])
    assert store.read(empty=empty).count() == 0 and store.versions() == []
    one = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "k long, v string")
    assert store.append(one, "a") == 1
    two = spark.createDataFrame([(3, "new", 1), (3, "newer", 2), (99, "more", 3)], "k long, v string, added int")
    assert store.replace(two, "b") == 2
    assert rows(store.read(1)) == rows(one)
    want = [(i, f"v{i}", None) for i in range(20) if i != 3] + [(3, "new", 1), (3, "newer", 2), (99, "more", 3)]
    assert rows(store.read()) == sorted(want, key=str)
    old, new = store.version(1).parts, store.version(2).parts
    assert sum(p in old for p in new) >= 2  # buckets that no new key falls into are kept as they are
    assert store.vacuum() >= 0 and store.versions() == [2] and rows(store.read()) == sorted(want, key=str)


def test_a_commit_counts_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), ("k",))
    df = spark.createDataFrame([(1, "x")], "k long, v string")
    assert store.append(df, "a") == store.append(df, "a") == 1
    assert store.replace(df, "b") == store.replace(df, "b") == 2 and store.read().count() == 1
    assert store.append(df, "a") == 1 and store.read().count() == 1


def test_competing_commits(spark, tmp_path, monkeypatch):
    store, other = (Store(spark, str(tmp_path / "t"), ("k",)) for _ in range(2))
    df = lambda k: spark.createDataFrame([(k, f"by {k}")], "k long, v string")
    store.append(df(0), "base")
    written = Store._written
    raced = []

    def late(self, frame):
        parts = written(self, frame)
        if self is store and not raced:
            raced.append(other.replace(df(7), "other"))  # another writer is faster
        return parts

    monkeypatch.setattr(Store, "_written", late)
    assert store.replace(df(5), "mine") == 3 and raced == [2]
    assert rows(store.read()) == [(0, "by 0"), (5, "by 5"), (7, "by 7")] and rows(store.read(2)) == [(0, "by 0"), (7, "by 7")]
    raced.clear()
    assert store.append(df(8), "mine too") == 5 or raced


def test_parts_without_a_manifest_are_in_no_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), ("k",))
    df = spark.createDataFrame([(1, "x")], "k long, v string")
    store.append(df, "a")
    store._written(df)  # a driver that died before its manifest
    assert store.read().count() == 1 and store.vacuum() == 1 and store.read().count() == 1


def test_submitted_again(spark, tmp_path):
    decision = lambda trust: spark.createDataFrame([(1, "u", "kyc", trust, "approve", "{}", "{}", 5.0, 60)], "packet_id long, user_id string, purpose string, trust_score double, action string, decision string, verification string, loan_amount double, tenure_months int")
    docs = lambda *names: spark.createDataFrame([(1, n, "pan") for n in names], "packet_id long, filename string, doc_type string")
    cases.submit(spark, str(tmp_path), decision(80.0), docs("a", "b", "c"), "1")
    cases.submit(spark, str(tmp_path), decision(20.0), docs("a"), "2")
    case, doc = (cases.store(spark, str(tmp_path), n).read() for n in ("cases", "case_docs"))
    assert [(r.trust_score, r.status) for r in case.collect()] == [(20.0, "completed")]
    assert [(r.filename, r.fields) for r in doc.collect()] == [("a", None)] and doc.first().case_id == case.first().id
    with pytest.raises(Exception, match="required column"):
        cases.shaped(spark.createDataFrame([("x", None)], "id string, user_id string"), "cases").collect()


def test_scratch_deletes_what_queries_left(spark):
    with shared.scratch(spark):
        a = shared.written(spark.range(5), "kept")
        assert a.count() == 5
    assert not os.path.exists(a.written_to.removeprefix("file:"))


def test_graph_plans(spark):
    """Clusters count without multiplying rows, the latest edges need one exchange, and replays read edges that are written."""
    from vettra.operators import linkage
    from vettra.plans import scoring

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    e = spark.createDataFrame([(1, "property", "p"), (2, "property", "p"), (3, "property", "q"), (1, "pan", "a"), (2, "pan", "b"), (3, "pan", "a")], "app_id long, kind string, value string")
    found = linkage.clusters(e, "property")
    assert "Expand" not in plan(found) and [tuple(r) for r in found.collect()] == [("p", 2, 2)]
    latest = linkage.latest_edges(e.withColumn("version", F.lit(1)).unionByName(e.where("app_id = 1 AND kind = 'pan'").withColumn("version", F.lit(2))))
    assert plan(latest).count("Exchange hashpartitioning") == 1 and sorted((r.app_id, r.kind) for r in latest.collect()) == [(1, "pan"), (2, "pan"), (2, "property"), (3, "pan"), (3, "property")]
    assert "lineitem" not in plan(scoring.graph_upsert_idempotent(spark, "/root/testdata/sf0.001"))


def test_rows_are_made_once_for_a_commit(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    store = Store(spark, str(tmp_path / "t"), ("k",))
    store.append(spark.range(100).withColumnRenamed("id", "k").mapInPandas(counted, "k long"), "one")
    assert made.value == 100 and store.read().count() == 100
