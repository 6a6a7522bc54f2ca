"""Operators on small hand-made packets."""

import pytest
from pyspark.sql import functions as F

from vettra.operators import documents as docs_ops, isolation
from vettra.operators import evaluation, grids, linkage, ordered, underwriting
from vettra.operators import evidence as ev
from vettra.sources import tables


def evidence(spark, *rows):
    df = spark.createDataFrame([("P", i, *r) for i, r in enumerate(rows)], "packet_id string, doc_id long, category string, severity string, title string, location string, confidence double")
    return ev.concatenated([df])


def test_critical_ceiling_and_actions(spark):
    def decide(model, *rows):
        return ev.decided(ev.channels(evidence(spark, *rows)), F.lit(model), F.lit(0.0)).first()

    assert decide(0.0, ("semantic", "critical", "t", "l", 0.9)).trust == 25.0
    assert decide(0.0, ("semantic", "critical", "t", "l", 0.9)).action == "freeze"
    assert decide(0.0, ("semantic", "low", "t", "l", 0.9)).action == "approve"
    assert decide(1.0, ("model", "high", "t", "l", 0.9)).action == "manual_review"


def test_chain_dedupes_keep_first_and_orders_stably(spark):
    rows = [("semantic", "medium", "a", "x", 0.9), ("semantic", "medium", "a", "x", 0.5), ("forensic", "high", "b", "x", 0.8), ("semantic", "medium", "c", "x", 0.9)]
    chain = ev.ordered(ev.deduped(evidence(spark, *rows))).orderBy("place").collect()
    assert [(r.title, r.confidence) for r in chain] == [("b", 0.8), ("a", 0.9), ("c", 0.9)]


def test_fold_makes_a_softened_case_freeze(spark):
    d = ev.decided(ev.channels(evidence(spark, ("model", "high", "t", "l", 0.9))), F.lit(1.0), F.lit(1.0))
    assert d.first().trust == 40.0 and d.first().action == "manual_review"
    out = ev.folded(d, F.lit(6.0)).first()
    assert (out.final_trust, out.final_action) == (34.0, "freeze")


def test_last_and_first_documents(spark):
    d = spark.createDataFrame([("P", 1, "a", "x"), ("P", 2, "b", None), ("P", 3, "a", "y")], "packet_id string, ordinal int, doc_type string, v string")
    assert {(r.doc_type, r.ordinal, r.position) for r in ordered.last_per_type(d).collect()} == {("a", 3, 1), ("b", 2, 2)}
    assert [(r.ordinal, r.reference) for r in ordered.against_first(d, "v").collect()] == [(3, "x")]


EDGES = [(i, "property", "SY-1") for i in range(4)] + [(i, "pan", f"p{i}") for i in range(4)] + [(i, "template", "T") for i in range(4)] + [(i, "employer", "E") for i in range(2)] + [(i, "pan", f"p{i}") for i in range(4, 12)]


def test_clusters_and_hubs(spark):
    e = spark.createDataFrame(EDGES, "app_id long, kind string, value string")
    assert linkage.threshold(e).first().threshold == 6
    r = linkage.clusters(e, "property").first()
    assert (r.value, r.n_apps, r.n_applicants) == ("SY-1", 4, 4)
    ring = linkage.clusters(e, "employer").join(linkage.shared_templates(e, "employer"), "value").first()
    assert (ring.n_apps, ring.n_templates) == (2, 1)
    hub = e.unionByName(spark.createDataFrame([(i, "property", "SY-1") for i in range(4, 12)], e.schema))
    assert linkage.clusters(hub, "property").count() == 0  # twelve applications exceed the threshold


def test_upsert_is_idempotent(spark):
    e = spark.createDataFrame(EDGES, "app_id long, kind string, value string")
    once = linkage.latest_edges(e.withColumn("version", F.lit(1)))
    twice = linkage.latest_edges(e.withColumn("version", F.lit(1)).unionByName(e.withColumn("version", F.lit(2))))
    assert set(once.collect()) == set(twice.collect()) == set(e.collect())


def test_subgraph_is_capped(spark):
    rows = [(i, "property", "S") for i in range(3)] + [(0, "employer", f"e{k}") for k in range(50)]
    nodes, among = linkage.neighbourhood(spark.createDataFrame(rows, "app_id long, kind string, value string"), 0)
    assert nodes.count() == 30 and among.where("app_id <> 0").count() == 0


@pytest.mark.parametrize("amount, months, verdict", [(1.5e6, 60, "ELIGIBLE"), (9e6, 36, "DECLINE"), (None, 60, "INFO")])
def test_affordability(spark, amount, months, verdict):
    df = spark.createDataFrame([(amount, 80000.0)], "amount double, net double")
    assert underwriting.affordability(df, F.col("amount"), F.col("net"), F.lit(months)).first().verdict == verdict


def test_completeness(spark):
    p = spark.createDataFrame([("A",)], "packet_id string")
    have = spark.createDataFrame([("A", "pan"), ("A", "form16")], "packet_id string, slot string")
    assert [r.slot for r in underwriting.missing_slots(p, have, "salaried_loan").orderBy("place").collect()] == ["aadhaar", "address_proof", "salary_slip", "bank_statement"]


def test_classifier_ties_and_floor(spark):
    d = spark.createDataFrame([(1, "SALARY SLIP net pay"), (2, "company"), (3, None), (4, "bank statement sale deed")], "k long, text string")
    got = {r.k: (r.doc_type, r.confidence) for r in docs_ops.classify(d, "k", "text").collect()}
    assert got == {1: ("salary_slip", 0.667), 2: ("other", 0.0), 3: ("other", 0.0), 4: ("bank_statement", 0.286)}


def test_components_and_outliers(spark):
    m = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 2, 2), (1, 1, 1), (2, 5, 5)], "k long, gy int, gx int")
    got = {(r.k, r.root_y, r.root_x, r.n) for r in grids.components(m, "k").collect()}
    assert got == {(1, 0, 0, 3), (1, 2, 2, 1), (2, 5, 5, 1)}
    v = spark.createDataFrame([(1, [1.0, 1.1, 0.9, 50.0])], "k long, v array<double>")
    assert [(r.gy, r.gx) for r in grids.outliers(grids.cells(v, "k", "v", 2), "k").collect()] == [(1, 1)]


def test_confusion_guards_zero(spark):
    r = evaluation.confusion(spark.createDataFrame([(False, False)], "t boolean, p boolean"), "t", "p").first()
    assert (r.tp, r.tn, r.prec, r.recall, r.accuracy) == (0, 1, None, None, 1.0)


def test_constant_columns_stay_unscaled(spark):
    df = spark.createDataFrame([(0.0, True), (0.0, True), (5.0, False)], "x double, clean boolean")
    assert sorted(r.x_z for r in evaluation.scaled(df, ["x"], F.col("clean")).collect()) == [0.0, 0.0, 5.0]


def test_isolation_ranks_the_outlier_first(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(200)] + [(999, 100.0, -80.0)], "k long, a double, b double")
    assert isolation.isolation(df, "k", ["a", "b"]).orderBy(F.desc("score")).first().k == 999


def test_sources_round_trip(spark, tmp_path):
    path = str(tmp_path / "edges")
    schema = "app_id long, kind string, value string"
    empty = spark.createDataFrame([], schema).schema
    assert tables.load_or_empty(spark, path, empty).count() == 0
    tables.append(spark.createDataFrame(EDGES[:3], schema), path)
    tables.append(spark.createDataFrame([(9, "pan", "x", 1)], schema + ", added int"), path)
    assert tables.load_merged(spark, path).count() == 4 and "added" in tables.load_merged(spark, path).columns
    (tmp_path / "m.json").write_text('{"id": "P1", "created_at": "2024-01-01", "submitted_at": "2024-01-02", "documents": [{"path": "a.pdf"}, {"path": "b.pdf"}]}')
    got = tables.packets(spark, str(tmp_path / "m.json")).select("ordinal", F.col("document.path").alias("path"))
    files = spark.createDataFrame([("a.pdf",)], "path string")
    assert [r.path for r in tables.existing_documents(got, files).collect()] == ["a.pdf"]
    (tmp_path / "l.json").write_text('{"P1": {"label": "fraud", "fraud_types": ["x"]}, "P2": {"label": "clean"}}')
    assert {(r.packet_id, r.label.label) for r in tables.labels(spark, str(tmp_path / "l.json")).collect()} == {("P1", "fraud"), ("P2", "clean")}


def test_registry(spark):
    reg = spark.createDataFrame([("a", None, [("S1", 5.0)]), ("b", "closed", [])], "pan string, status string, charges array<struct<property_id: string, amount: double>>")
    keys = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "pan string")
    assert {(r.pan, r.found, r.verified_status) for r in tables.verify(keys, reg, "pan").collect()} == {("a", True, "active"), ("b", True, "closed"), ("c", False, "not_found"), (None, False, "not_found")}
    assert [r.pan for r in tables.charges_on(reg, "pan", "charges", F.lit("S1")).collect()] == ["a"]


def test_spectrum_peaks_takes_all_peaks_within_the_budget(spark):
    import math

    from vettra.plans import catalogue

    sf = "/root/testdata/sf0.001"
    vectors = {r.vec_id: [float(x) for x in r.embedding] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").limit(40).collect()}
    got = {}
    for r in catalogue.QUERIES["spectrum_peaks"](spark, sf).where(F.col("vec_id").isin(list(vectors))).orderBy("vec_id", "place").collect():
        got.setdefault(r.vec_id, []).append((r.place, r.bin, r.level))
    for k, v in vectors.items():
        n, mean = len(v), sum(v) / len(v)
        x = [(a - mean) * (0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1))) for i, a in enumerate(v)]
        level = {}
        for b in range(2, n // 2 + 1):
            re, im = (sum(a * f(2 * math.pi * b * i / n) for i, a in enumerate(x)) for f in (math.cos, math.sin))
            level[b] = 20 * math.log10(math.hypot(re, im) + 1e-9)
        want = []
        while level and len(want) < 28:
            at = max(level, key=lambda b: (level[b], -b))
            want.append((len(want), at, pytest.approx(level[at], abs=1e-3)))
            level = {b: z for b, z in level.items() if abs(b - at) > 2}
        assert got[k] == want and len(want) > 4


def test_mask_cells_of_every_page(spark):
    from vettra.plans import catalogue

    sf = "/root/testdata/sf0.001"
    cells = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey").collect():
        a, b = cells.setdefault(r.l_orderkey, (set(), set()))
        p, s = r.l_partkey, r.l_suppkey
        a.update((x, y) for x in range(s % 40, s % 40 + 20) for y in range(p % 40, p % 40 + 10))
        b.update((x, y) for x in range(p % 50, p % 50 + 12) for y in range(s % 50, s % 50 + 6))
    got = {r.page: r.iou for r in catalogue.QUERIES["mask_cells_iou_all"](spark, sf).collect()}
    assert got == {k: pytest.approx(len(a & b) / len(a | b), abs=1e-6) for k, (a, b) in cells.items()}
    assert max(got) >= 300
