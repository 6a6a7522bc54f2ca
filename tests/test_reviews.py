"""Structural and grid findings, review helpers and scalars on small cases and against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vettra.functions import scalars
from vettra.operators import documents, evaluation, faces, forensics, grids, isolation, packets, review
from vettra.operators import evidence as ev
from vettra.sources import models, tables


def value(spark, column, **literals):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in literals.items())).select(column.alias("x")).first().x


def test_account_masks_equal_ten_passes(spark):
    import re

    texts = ["1" * n for n in range(3, 22)] + ["a123456789 123456789a", "123456789,1234567890123-98765432109876543", "x 000123456789 y 12345678", "", "1234567890123456789 123456789"]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.mask_accounts(F.col("t")).alias("x")).collect()]
    for t, g in zip(texts, got):
        for n in range(9, 19):
            t = re.sub(rf"(?a)\b\d{{{n - 4}}}(\d{{4}})\b", "*" * (n - 4) + r"\1", t)
        assert g == t


@pytest.mark.parametrize("text", ["15-Jan-24", "15 January 2024", "15/01/24", "on 15 Jan 2024"])
def test_more_date_spellings(spark, text):
    assert value(spark, scalars.parse_date(F.col("t")), t=text) == "2024-01-15"


def test_named_two_digit_years_pivot(spark):
    assert value(spark, scalars.parse_date(F.col("t")), t="15-Jan-70") == "1970-01-15" and value(spark, scalars.parse_date(F.col("t")), t="15-Foo-70") is None


def test_check_digits(spark):
    assert value(spark, scalars.verhoeff_digit(F.col("t")), t="236") == 3 and value(spark, scalars.verhoeff_digit(F.col("t")), t="x") is None


def test_iso_money_and_hosts(spark):
    assert value(spark, F.date_format(scalars.parse_iso(F.col("t")), "yyyy-MM-dd HH:mm"), t="2024-01-15T10:00:00+05:30") == "2024-01-15 04:30"
    assert value(spark, scalars.parse_iso(F.col("t")), t="soon") is None
    assert value(spark, scalars.money_text(F.col("t")), t=1234567.9) == "Rs. 1,234,567"
    assert value(spark, scalars.host_of(F.col("t")), t="http://me:pw@Site1.Example:80/x") == "site1.example"


def test_redacted_mapping(spark):
    kind = T.StructType().add("name", "string").add("pan", "string").add("n", T.IntegerType()).add("property_id", T.IntegerType()).add("more", T.ArrayType(T.StructType().add("address", "string").add("note", "string"))).add("m", T.MapType(T.StringType(), T.StringType()))
    df = spark.createDataFrame([(("Asha", "ABCPV1234D", 5, 7, [("x", "acct 123456789012"), (None, None)], {"owner_name": "Bo", "k": "SY-12/3B"}),), (None,)], T.StructType().add("v", kind))
    one, none = (r.x for r in df.select(scalars.redact_mapping(F.col("v"), kind).alias("x")).collect())
    assert none is None and (one.name, one.pan, one.n, one.property_id) == ("A***", "AB*******D", 5, "***")
    assert [tuple(x) for x in one.more] == [("*", "acct ********9012"), (None, None)] and one.m == {"owner_name": "B*", "k": "SY-***"}


def test_box_iou_against_cells(spark):
    rng = np.random.default_rng(2)
    rows, want = [], []
    box = lambda: (lambda x, y: (x, y, x + int(rng.integers(0, 9)), y + int(rng.integers(0, 9))))(*map(int, rng.integers(0, 20, 2)))
    for i in range(60):
        a, b = ([tuple(map(float, box())) for _ in range(rng.integers(0, 6))] for _ in range(2))
        cells = [{(x, y) for x0, y0, x1, y1 in s for x in range(int(x0), int(x1)) for y in range(int(y0), int(y1))} for s in (a, b)]
        rows.append((i, a, b))
        want.append(round(len(cells[0] & cells[1]) / len(cells[0] | cells[1]), 6) if cells[0] | cells[1] else 0.0)
    kind = "array<struct<x0: double, y0: double, x1: double, y1: double>>"
    got = evaluation.box_iou(spark.createDataFrame(rows, f"k int, a {kind}, b {kind}"), "k", "a", "b").orderBy("k").collect()
    assert [r.iou for r in got] == pytest.approx(want, abs=1e-6)
    assert evaluation.box_iou(spark.createDataFrame([(1, [(0.0, 0.0, 2.0, 2.0)], None)], f"k int, a {kind}, b {kind}"), "k", "a", "b").first().iou == 0


def test_near_names_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    names = ["".join(rng.choice(list("ab"), rng.integers(0, 5))) for _ in range(80)] + [None]
    rows = [(i, int(rng.integers(0, 2)), n) for i, n in enumerate(names)]

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    want = {(i, j) for i, g, a in rows for j, h, b in rows if i < j and g == h and a is not None and b is not None and near(a, b)}
    got = documents.near_names(spark.createDataFrame(rows, "k int, g int, n string"), "g", "k", "n").collect()
    name = {i: n for i, _, n in rows}
    members = lambda g, k: [i for i, h, n in rows if h == g and n == name[k]]
    assert len(got) == len({(r.a, r.b) for r in got}) and all((r.n_a, r.n_b) == (len(members(r.g, r.a)), len(members(r.g, r.b))) for r in got)
    assert {(min(i, j), max(i, j)) for r in got for i in members(r.g, r.a) for j in members(r.g, r.b) if i != j} == want  # no pair of rows is lost


def test_labels_against_a_search():
    rng = np.random.default_rng(4)
    for _ in range(60):
        cells = list({tuple(map(int, c)) for c in rng.integers(0, [3, 6, 6], (rng.integers(0, 60), 3))})
        root = grids.label_cells(*(np.array([c[k] for c in cells], np.int64) for k in range(3)))
        for i, c in enumerate(cells):
            group, edge = {c}, [c]
            while edge:
                m, y, x = edge.pop()
                for n in ((m, y - 1, x), (m, y + 1, x), (m, y, x - 1), (m, y, x + 1)):
                    if n in cells and n not in group:
                        group.add(n)
                        edge.append(n)
            assert cells[root[i]] == min(group)


def plain_path(nodes, row):
    """The path of a row through a tree's node rows, by hand."""
    at = nodes[0]
    while at.path is None:
        at = nodes[at.below if row[at.feature] < at["at"] else at.above]
    return at.path


def test_isolation_against_plain_trees(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (50, 2)))] + [(99, 30.0, 30.0), (100, None, 1.0)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    nodes = isolation.fitted(df.where("k < 50"), "k", ["a", "b"], trees=20, sample=32).collect()
    trees = [sorted((n for n in nodes if n.tree == t), key=lambda n: n.node) for t in range(20)]
    assert all(2 * sum(n.path is not None for n in t) == len(t) + 1 and len(t) <= 63 for t in trees)
    found = {r.k: r.score for r in isolation.scored(df, "k", ["a", "b"], spark.createDataFrame(nodes, isolation.NODES), 32).collect()}
    for k, a, b in rows[:-1]:
        assert found[k] == pytest.approx(2 ** -(np.mean([plain_path(t, (a, b)) for t in trees]) / isolation.mean_path(32)))
    assert found[100] is None
    out = {r.k: (r.score, r.anomaly) for r in isolation.isolation(df, "k", ["a", "b"], trees=40, fit_on=F.col("k") < 50).collect()}
    assert max((k for k in out if out[k][0] is not None), key=lambda k: out[k][0]) == 99 and out[99][1] > 0.5
    # the share of fitted rows above one half is the contamination
    assert sum(out[i][1] > 0.5 for i in range(50)) == math.floor(50 * 0.05) + (50 * 0.05 % 1 > 0)
    assert isolation.isolation(df.limit(0), "k", ["a", "b"], trees=3).count() == 0


def test_subsamples_are_bounded_and_differ(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    counts = {r.tree: r["count"] for r in isolation.subsamples(df, "k", 10, 64, 1).groupBy("tree").count().collect()}
    assert len(counts) == 10 and all(64 <= n <= 300 for n in counts.values())
    chosen = isolation.subsamples(df, "k", 2, 64, 1).collect()
    assert {r.k for r in chosen if r.tree == 0} != {r.k for r in chosen if r.tree == 1}


def test_stored_models(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, float(x), float(rng.uniform()), 7.0, int(x > 0)) for i, x in enumerate(rng.normal(0, 1, 200))]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, y int")
    root = str(tmp_path)
    assert models.resolve(spark, root, "risk", "1") is None
    model = models.fit(df, "k", ["a", "b", "c"], "y", F.col("y") == 0, root, "risk", "1", trees=5, forest=10)
    again = models.fit(df.limit(1), "k", ["a"], "y", F.col("y") == 0, root, "risk", "1")
    assert again == model and model.features == ["a", "b", "c"]
    got = {r.k: r for r in models.scores(df, "k", models.resolve(spark, root, "risk", "1")).collect()}
    assert np.mean([(got[k].probability > 0.5) == (y == 1) for k, _, _, _, y in rows]) > 0.95 and all(0 <= r.anomaly <= 1 for r in got.values())
    assert max(models.importances(spark, model), key=models.importances(spark, model).get) == "a"
    models.registry(spark, root).replace(spark.createDataFrame([("risk", "1", "withdrawn", model.folder, ["a"], 1, 0.5)], models.SCHEMA), "withdraw")
    assert models.resolve(spark, root, "risk", "1") is None


def test_fold_report_against_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 3), float(np.round(rng.uniform(), 1)), int(rng.uniform() < 0.4)) for i in range(300)]
    got = {r.fold: r for r in evaluation.fold_report(spark.createDataFrame(rows, "fold int, probability double, y int"), "y").collect()}
    assert set(got) == {0, 1, 2, None}
    for fold, r in got.items():
        s, t = (np.array(x) for x in zip(*((s, y == 1) for f, s, y in rows if fold is None or f == fold)))
        assert r.auc == pytest.approx(np.mean([1.0 if p > q else 0.5 if p == q else 0.0 for p in s[t] for q in s[~t]]), abs=1e-6)
        assert r.n == len(s) and r.accuracy == pytest.approx(np.mean(t == (s >= 0.5)), abs=1e-6) and r.recall_0 == pytest.approx(np.mean(s[~t] < 0.5), abs=1e-6) and r.prec_1 == pytest.approx(np.mean(t[s >= 0.5]), abs=1e-6)


def test_font_findings(spark):
    rows = [(1, 1, i, "x", "Helvetica-Bold", 10.0) for i in range(3)] + [(1, 1, 9, "y", "Times New Roman", 10.0), (1, 2, 1, "x", "Arial", 9.0), (1, 2, 2, "x", "ArialMT", 9.0), (2, 1, 1, "x", "Arial", 9.0), (2, 1, 2, "x", "Georgia", 30.0), (2, 1, 3, " ", "Georgia", 9.0), (3, 1, 1, "x", None, 9.0)]
    got = forensics.font_findings(spark.createDataFrame(rows, "doc int, page int, place int, text string, font string, size double")).collect()
    assert [(r.doc, r.page, r.n) for r in got] == [(1, 1, 1)]


def test_duplicates_order_and_view(spark):
    images = spark.createDataFrame([(1, 1, 5, "a"), (1, 2, 6, "a"), (2, 1, 5, None), (2, 1, 5, None), (3, 1, 1, "a")], "doc int, page int, xref int, sha256 string")
    dup = forensics.duplicate_image_findings(images)
    white = forensics.whitebox_findings(spark.createDataFrame([(1, 2, 1), (1, 2, 2), (1, 3, 1)], "doc int, page int, rect int"))
    eof = forensics.incremental_findings(spark.createDataFrame([(1, 1), (2, 3)], "doc int, eof_count int"))
    out = forensics.document_findings(eof, dup, white)
    assert [(r.doc, r.seq, r.part, r.page, r.n) for r in out.orderBy("doc", "seq").collect()] == [(1, 1, 1, 2, 2), (1, 2, 1, 3, 1), (1, 3, 3, None, 1), (2, 1, 3, None, 1), (2, 2, 4, None, 3)]
    seen = review.packet_view(spark.createDataFrame([(1,), (9,)], "doc int"), out).orderBy("doc").collect()
    assert [tuple(r) for r in seen] == [(1, 2, 2, True), (9, None, 0, False)]


def test_reocr_skips_unreadable_pages(spark):
    hidden = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "c")], "doc int, page int, token string")
    pages = spark.createDataFrame([(1, 1, 40), (1, 2, 39)], "doc int, page int, ocr_chars int")
    assert [(r.page, r.n) for r in forensics.reocr_findings(hidden, pages).collect()] == [(1, 2)]


def test_corroboration(spark):
    box = lambda i, d, r, s, x: (i, d, r, s, float(x), 0.0, float(x + 10), 10.0)
    rows = [box(1, "noise", 1, 0.1, 0), box(1, "ela", 2, 0.9, 5), box(1, "flat_fill", 3, 0.5, 8), box(1, "copy_move", 4, 0.5, 14), box(1, "jpeg_ghost", 5, 0.5, 40), box(2, "noise", 1, 0.5, 0), box(2, "flat_fill", 2, 0.5, 30), box(2, "copy_move", 3, 0.5, 35), box(3, "ela", 1, 0.4, 0)]
    got = forensics.corroborated(spark.createDataFrame(rows, "k int, detector string, region int, strength double, x0 double, y0 double, x1 double, y1 double"), "k").collect()
    assert sorted((r.k, r.detector, r.severity, r.confidence) for r in got) == [(1, "copy_move", "high", 0.8), (1, "noise", "high", 0.7), (2, "flat_fill", "high", 0.55), (2, "noise", "high", 0.6), (3, "ela", "medium", 0.6)]


def test_recapture_needs_four_strong_peaks(spark):
    rows = [(1, i, i, 50.0) for i in range(4)] + [(2, i, i, 50.0) for i in range(3)] + [(2, 4, 4, 43.9)]
    assert [(r.k, r.peaks) for r in forensics.recapture_findings(spark.createDataFrame(rows, "k int, place int, bin int, level double"), "k").collect()] == [(1, 4)]


def grid(spark, rows, *names):
    return spark.createDataFrame([(1, i // 8, i % 8, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "k int, gy int, gx int, " + ", ".join(f"{n} double" for n in names))


def test_noise_and_fill_thresholds(spark):
    sigma = [10.0] * 64
    sigma[0:5] = [1.0] * 5
    got = forensics.noise_regions(grid(spark, sigma, "sigma"), "k", most=0.1).collect()
    assert [(r.n, r.x0, r.x1, r.strength) for r in got] == [(5, 0, 4, 0.8)]
    assert forensics.noise_regions(grid(spark, sigma, "sigma"), "k").count() == 0  # above 2 % of the page
    assert forensics.noise_regions(grid(spark, [x / 10 for x in sigma], "sigma"), "k", most=0.1).count() == 0  # no floor
    assert forensics.noise_regions(grid(spark, [None] * 60 + [9.0] * 4, "sigma"), "k").count() == 0
    blocks = [(240.0, 1.0)] * 64
    blocks[8:14] = [(150.0, 1.0)] * 6
    page = spark.createDataFrame([(1, 0.5, None)], "k int, white_share double, noise_mid double")
    assert [(r.n, r.strength) for r in forensics.fill_regions(grid(spark, blocks, "mean", "std"), page, "k", most=0.1).collect()] == [(6, 1.0)]
    noisy = spark.createDataFrame([(1, 0.5, 3.0)], "k int, white_share double, noise_mid double")
    assert forensics.fill_regions(grid(spark, blocks, "mean", "std"), noisy, "k", most=0.1).count() == 0


def test_review_choices(spark):
    h = spark.createDataFrame([(1, True), (2, False), (3, False)], "k int, localized boolean")
    m = spark.createDataFrame([(1, True), (2, True), (3, False)], "k int, localized boolean")
    assert {r.k: r.source for r in review.escalated(h, m, "k").collect()} == {1: "heuristic", 2: "model", 3: "heuristic"}
    assert value(spark, review.method_of(F.col("d"), F.lit("forensic")), d="qr_pan") == "semantic" and value(spark, review.method_of(F.col("d"), F.lit("x")), d="forgery_model") == "model"
    assert [value(spark, review.kind_of(F.col("n")), n=n) for n in ("My EDITED.jpg", "oridinal 2.png", "x")] == ["edited", "original", None]
    files = spark.createDataFrame([(1, 2, "b.pdf"), (1, 1, "a.pdf")], "packet_id int, ordinal int, filename string")
    f = spark.createDataFrame([(1, "b.pdf and a.pdf", None), (1, None, "in b.pdf"), (1, "c", "d"), (2, "a.pdf", None)], "packet_id int, location string, description string")
    assert sorted(r.filename for r in review.findings_to_files(f, files).collect()) == ["a.pdf", "b.pdf"]
    records = spark.createDataFrame([("f1", "tampered", [1, 2, 3]), ("f2", "clean", None), ("f3", "clean", None), ("f4", "tampered", [])], "file string, label string, boxes array<int>")
    assert {(r.file, r.mode): r["count"] for r in review.patches(records).groupBy("file", "mode").count().collect()} == {("f1", "pos"): 2, ("f2", "neg"): 2, ("f3", "neg"): 2}


def test_attributions(spark):
    rows = [(1, 0.0, 5.0, 1.0), (2, 2.0, 5.0, 1.0), (3, 5.0, 7.0, 9.0)]
    df = spark.createDataFrame(rows, "packet_id int, a double, b double, c double")
    got = packets.attributions(df, F.col("packet_id") < 3, {"a": 0.5, "b": 0.25, "c": 0.0}).where("packet_id = 3").collect()
    # a: clean mean 1, deviation 1 -> 0.5 * 4; b: constant among clean -> 0.25 * 2
    assert [(r["rank"], r.feature, r.share) for r in sorted(got, key=lambda r: r["rank"])] == [(1, "a", 0.8), (2, "b", 0.2)]


def test_model_evidence_texts(spark):
    s = spark.createDataFrame([(1, 0.9, 0.1), (2, 0.6, 0.1), (3, 0.1, 0.1)], "packet_id int, probability double, anomaly double")
    f = spark.createDataFrame([(1, 2, "n_semantic_total"), (1, 1, "doc_count")], "packet_id int, rank int, feature string")
    got = {r.packet_id: r for r in packets.model_evidence(s, f).collect()}
    assert got[1].description == "90% fraud probability by the risk model, mostly by packet document count; number of cross-document inconsistencies." and got[1].severity == "high"
    assert "linked applications" in got[2].description and got[3].description.startswith("10%") and got[3].severity == "info"
    assert tuple(got[2]["values"]) == (0.6, 0.1)
    assert packets.model_evidence(s).where("description LIKE '%linked%'").count() == 2
    shown = spark.createDataFrame([(1, True), (2, True), (3, False)], "packet_id int, has_doc_evidence boolean")
    assert packets.model_evidence(s, None, shown).where("description LIKE '%linked%'").count() == 0


def test_adapters(spark):
    rows = spark.createDataFrame([("a",), ("z",)], "k string")
    firms = spark.createDataFrame([("a", "ACTIVE")], "cin string, status string")
    assert {r.k: r.x for r in tables.look_up(rows, "k", firms, "mca21", "x").collect()} == {"a": True, "z": False}
    charges = spark.createDataFrame([("a", [1])], "pan string, charges array<int>")
    assert {r.k: r.x for r in tables.look_up(rows, "k", charges, "cersai", "x").collect()} == {"a": [1], "z": []}
    assert [r.key for r in tables.available_keys(firms, "mca21").collect()] == ["a"]


def test_sensitive_tokens(spark):
    got = value(spark, forensics.sensitive_money(F.col("t")), t="Rs. 12,345 INR 12345 Rs 999 ₹ 1,000")
    assert got == {"12345": "12,345", "1000": "1,000"}
    assert value(spark, forensics.sensitive_pans(F.col("t")), t="abcpv1234d ABCPV1234D x") == ["ABCPV1234D"]


def test_loading_of_files(spark):
    files = spark.createDataFrame([(1, "a.pdf", False), (2, "b.JPG", None), (3, "c.pdf", True), (4, "d.pdf", False), (5, "e.pdf", False)], "doc int, path string, locked boolean")
    pages = spark.createDataFrame([(1, 2, "short", "seen"), (1, 1, "a page with its own text", None), (2, 1, "ignored since an image", "from pixels"), (3, 1, "a page with its own text", None), (4, 1, None, " \n")], "doc int, page_no int, text string, ocr_text string")
    got = {r.doc: r for r in tables.load_files(files, pages, "doc").collect()}
    assert (got[1].text, got[1].source, got[1].ocr_used, got[1].ok) == ("a page with its own text\nseen", "mixed", True, True)
    assert (got[2].kind, got[2].text, got[2].source, got[2].ok) == ("image", "from pixels", "image-ocr", True)
    assert (got[3].needs_password, got[3].text, got[3].ok) == (True, "", False)
    assert (got[4].source, got[4].ocr_used, got[4].ok) == ("ocr", False, False) and (got[5].n_pages, got[5].ok) == (0, False)
    ocr = spark.createDataFrame([(4, "all of it")], "doc int, ocr_text string")
    assert {r.doc: (r.text, r.source) for r in tables.text_or_ocr(pages, ocr, "doc", "page_no", "text").collect()}[4] == ("all of it", "ocr")


def test_distant_pairs_in_blocks(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(0, 1, (90, 4)).round(3)
    v[7] = 0.0
    rows = [(int(i > 80), i, [float(x) for x in v[i]]) for i in range(90)] + [(3, 200, None), (4, 300, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "g int, k long, v array<double>")
    cos = lambda a, b: 1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-9)
    want = {(g, i, j): pytest.approx(cos(v[i], v[j])) for i in range(90) for j in range(i + 1, 90) if (g := int(i > 80)) == int(j > 80) and cos(v[i], v[j]) > 0.62}
    for block in (7, 1024):
        got = {(r.g, r.a, r.b): r.distance for r in faces.distant_pairs(df, "g", "k", "v", block=block).collect()}
        assert got == want
    assert faces.distant_pairs(df.limit(0), "g", "k", "v").count() == 0


def test_distant_pairs_deal_a_group_to_several_tasks(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(0, 1, (300, 3))
    df = spark.createDataFrame([(1, i, [float(x) for x in v[i]]) for i in range(300)], "g int, k long, v array<float>")
    joins, adaptive = (spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"))
    try:  # a join by exchange, as large tables have it
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = faces.distant_pairs(df, "g", "k", "v", block=50).withColumn("task", F.spark_partition_id())
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    w = v.astype(np.float32).astype(float)
    size = np.sqrt((w * w).sum(axis=1))
    far = np.triu(1 - w @ w.T / (np.outer(size, size) + 1e-9) > 0.62, 1)
    assert {(r.a, r.b) for r in rows} == set(zip(*map(list, np.nonzero(far)))) and len(rows) == far.sum()
    assert len({r.task for r in rows}) > 1


def test_distant_pairs_come_once_where_blocks_stay_empty(spark):
    rng = np.random.default_rng(10)
    v = rng.normal(0, 1, (9, 3)).round(3)
    df = spark.createDataFrame([(1, i, [float(x) for x in v[i]]) for i in range(9)] + [(1, None, [1.0, 0.0, 0.0])], "g int, k long, v array<double>")
    far = lambda i, j: 1 - v[i] @ v[j] / (np.linalg.norm(v[i]) * np.linalg.norm(v[j]) + 1e-9) > 0.62
    want = sorted((i, j) for i in range(9) for j in range(i + 1, 9) if far(i, j))
    for block in (1, 2, 3):  # as many blocks as rows: some are empty
        assert sorted((r.a, r.b) for r in faces.distant_pairs(df, "g", "k", "v", block=block).collect()) == want


def test_distant_pairs_in_runs_are_the_same_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    v = rng.normal(0, 1, (200, 4)).round(3)
    df = spark.createDataFrame([(i // 150, 7 * i % 200, [float(x) for x in v[i]]) for i in range(200)], "g int, k long, v array<double>")
    plain = {(r.g, r.a, r.b, round(r.distance, 6)) for r in faces.distant_pairs(df, "g", "k", "v").collect()}
    for name, n in (("PAIRS", 500), ("RUN", 2000), ("SORTED", 1), ("OUT", 300)):
        monkeypatch.setattr(faces, name, n)
    for block in (40, 1024):
        got = faces.distant_pairs(df, "g", "k", "v", block=block, digits=6, tasks=3).collect()
        assert {tuple(r) for r in got} == plain and len(got) == len(plain)
        assert sum(x.distance > y.distance for x, y in zip(got, got[1:])) < len(got) / 50  # the runs ascend
    assert faces.distant_pairs(df.limit(0), "g", "k", "v", digits=6, tasks=faces.tasks_of(df.limit(0), "g")).count() == 0


def test_written_pairs_take_little_room(spark, tmp_path):
    import __spark_entry__

    rng = np.random.default_rng(12)
    v = rng.normal(0, 1, (2000, 16)).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(x) for x in v[i]], 1) for i in range(2000)], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    __spark_entry__.queries()["embedding_mismatch"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    w = v.astype(float)
    size = np.sqrt((w * w).sum(axis=1))
    distance = 1 - w @ w.T / (np.outer(size, size) + 1e-9)
    i, j = np.nonzero(np.triu(distance > 0.62, 1))
    n, a, b, d = spark.read.parquet(f"{tmp_path}/out").agg(F.count(F.lit(1)), F.sum("a"), F.sum("b"), F.sum("distance")).first()
    assert (n, a, b) == (len(i), i.sum(), j.sum()) and d == pytest.approx(distance[i, j].sum())
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 7 * n


def test_one_finding_for_each_packet(spark):
    row = lambda p, d, sharp, side, place, v: (p, d, sharp, 0.0, 0.0, side, side, place, v)
    rows = [row(1, 1, 9.0, 50.0, 1, [1.0, 0.0]), row(1, 1, 9.0, 60.0, 2, [0.0, 1.0]), row(1, 2, 9.0, 50.0, 1, [1.0, 0.0]), row(1, 3, 9.0, 50.0, 1, [0.1, 1.0]), row(1, 4, 0.5, 90.0, 1, [-1.0, 0.0]), row(2, 5, 9.0, 50.0, 1, [1.0, 0.0]), row(3, 6, 9.0, 50.0, 1, [1.0, 0.0]), row(3, 7, 9.0, 10.0, 1, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "packet_id int, doc_id int, sharpness double, x0 double, y0 double, x1 double, y1 double, place int, embedding array<double>")
    got = faces.face_findings(df, 1.0, 400.0).collect()
    assert [(r.packet_id, r.n_faces, r.n_pairs, r.distance, r.doc_a, r.doc_b) for r in got] == [(1, 3, 2, 1.0, 1, 2)]


def test_every_pair_of_near_rows(spark):
    """Rows of equal names are paired as well as those of near ones, each pair once; null names and other groups have none."""
    rows = [(1, 0, "ab"), (2, 0, "ab"), (3, 0, "ab"), (9, 0, "abc"), (4, 0, "abc"), (5, 1, "ab"), (6, 0, None), (7, 0, None), (8, 0, "zzz")]
    got = documents.near_rows(spark.createDataFrame(rows, "k int, g int, n string"), "g", "k", "n").collect()
    assert sorted((r.a, r.b) for r in got) == [(1, 2), (1, 3), (1, 4), (1, 9), (2, 3), (2, 4), (2, 9), (3, 4), (3, 9), (4, 9)]


def test_every_event_fills_its_slot(spark, tmp_path):
    """A slot is there by any event of its type, whatever its value."""
    from vettra.plans import scoring

    spark.createDataFrame([(1, "a", 10.0), (1, "b", 90.0), (2, "a", 59.0)], "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(map(tuple, scoring.completeness_semi(spark, str(tmp_path)).collect())) == [(1, "a"), (1, "b"), (2, "a")]
    assert sorted(map(tuple, scoring.completeness_anti(spark, str(tmp_path)).collect())) == [(1, "a"), (2, "a"), (2, "b")]


def test_tenths_as_sql_rounds_them(spark):
    """Scores next to a half, over all risks of four places, round as the SQL's doubles do."""
    import duckdb

    got = spark.range(10_001).select(ev.by_tenfold(100 * (1 - F.col("id") / 10_000)).alias("t"), ev.by_tenfold(F.col("id") / 100 - 18.0).alias("u")).collect()
    want = duckdb.sql("SELECT round(100 * (1 - id / 10000::DOUBLE), 1), round(id / 100::DOUBLE - 18::DOUBLE, 1) FROM range(10001) t(id) ORDER BY id").fetchall()
    assert [tuple(r) for r in got] == want
    rows = spark.createDataFrame([(0.6995, False)], "risk double, critical boolean")
    assert rows.select(ev.trust(F.col("risk"), F.col("critical"), ev.by_tenfold).alias("t")).first().t == 30.1


def test_faces_are_chosen_before_their_embeddings(spark, tmp_path):
    """A document's largest face counts even where it has no embedding: the next one doesn't take its place, and only one line a document meets the vectors."""
    import os

    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    from oracle import compare

    from vettra.plans import intake

    for name in os.listdir("/root/testdata/sf0.001"):
        if name != "embeddings.parquet":
            os.symlink(f"/root/testdata/sf0.001/{name}", tmp_path / name)
    e = pq.read_table("/root/testdata/sf0.001/embeddings.parquet")
    away = pc.if_else(pc.equal(pc.bit_wise_and(e["vec_id"], 1), 0), pc.add(e["vec_id"], 1_000_000), e["vec_id"])
    pq.write_table(e.set_column(e.schema.get_field_index("vec_id"), "vec_id", pc.cast(away, pa.int64())), tmp_path / "embeddings.parquet")
    compare(spark, str(tmp_path), intake.QUERIES["face_mismatches"], intake.ORACLE_SQL["face_mismatches"])


def test_folds_are_fitted_side_by_side(spark, monkeypatch):
    import threading

    from pyspark.ml.classification import GBTClassifier

    met, fit = threading.Barrier(2), GBTClassifier.fit

    def waiting(self, *args):
        met.wait(60)  # breaks where one fit waits for the end of another
        return fit(self, *args)

    monkeypatch.setattr(GBTClassifier, "fit", waiting)
    df = spark.createDataFrame([(i, i % 2, float(i % 7), float(i % 2)) for i in range(40)], "k long, label int, a double, b double")
    got = evaluation.cross_validated(df, "k", ["a", "b"], "label", n=2, trees=1).collect()
    assert sorted(r.k for r in got) == list(range(40)) and {r.fold for r in got} == {0, 1}
