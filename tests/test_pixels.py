"""Pixel operators against numpy, checks of evidence, ranking and folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vettra.operators import evaluation, evidence, pixels, review


def images(spark, *arrays):
    return spark.createDataFrame([(i, a.shape[1], [float(v) for v in a.ravel()]) for i, a in enumerate(arrays)], "k int, w int, p array<double>")


def test_block_grid_against_numpy(spark):
    a = np.random.default_rng(1).uniform(0, 255, (37, 50))
    got = {(r.gy, r.gx): (r["mean"], r["std"]) for r in pixels.block_grid(images(spark, a), "k", "w", "p").collect()}
    assert set(got) == {(y, x) for y in range(2) for x in range(3)}
    for (y, x), (m, s) in got.items():
        b = a[y * 16 : y * 16 + 16, x * 16 : x * 16 + 16]
        assert m == pytest.approx(b.mean()) and s == pytest.approx(b.std())


def plain_noise(a, block):
    """Deviation of the residual over flat pixels of each block, from the definition."""
    taps = np.array([1, 4, 6, 4, 1]) / 16
    pad = np.pad(a, 2, mode="edge")
    low = sum(taps[i] * taps[j] * pad[i : i + a.shape[0], j : j + a.shape[1]] for i in range(5) for j in range(5))
    gy, gx = np.gradient(low)
    flat, residual = np.hypot(gx, gy) < 6, a - low
    out = {}
    for y, x in np.ndindex(a.shape[0] // block, a.shape[1] // block):
        here = slice(y * block, (y + 1) * block), slice(x * block, (x + 1) * block)
        k = flat[here]
        out[y, x] = pytest.approx(residual[here][k].std(), abs=1e-6) if k.sum() >= int(0.22 * block * block) else None
    return out


def test_noise_against_numpy(spark):
    rng = np.random.default_rng(2)
    a = 128 + rng.normal(0, 2, (64, 72))
    a[16:32, 16:32] = 128.0
    a[48:, 48:64] = np.indices((16, 16)).sum(axis=0) * 40  # edges all over
    got = {(r.gy, r.gx): r.sigma for r in pixels.noise_grid(pixels.rows(images(spark, a), "k", "w", "p"), "k").collect()}
    assert got == plain_noise(a, 16) and got[3, 3] is None and got[1, 1] < got[0, 0]


def test_image_findings(spark):
    rng = np.random.default_rng(3)
    noisy = 150 + rng.normal(0, 6, (320, 320))
    noisy[32:48, 32:112] = 150.0
    got = pixels.image_findings(images(spark, noisy, np.full((160, 160), 250.0)), "k", "w", "p").collect()
    assert [(r.k, r.detector, r.severity) for r in got] == [(0, "noise", "high")]


def test_correlation_and_boxes(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0], [2.0, 4.0, 8.0], [5.0, 5.0, 5.0])], "a array<double>, b array<double>, c array<double>")
    r = df.select(pixels.correlation(F.col("a"), F.col("b")).alias("x"), pixels.correlation(F.col("a"), F.col("c")).alias("y")).first()
    assert r.x == pytest.approx(1.0, abs=1e-5) and r.y == 0
    box = spark.createDataFrame([(1, -3.0, 1.9, 20.0, 9.0), (1, 0.0, 0.0, 1.0, 1.0)], "k int, x0 double, y0 double, x1 double, y1 double")
    assert pixels.largest_box(box, "k", "x0").first().area == pytest.approx(23 * 7.1)
    got = box.select(pixels.scaled_box(F.struct("x0", "y0", "x1", "y1"), F.lit(2.0), F.lit(1.0), F.lit(30), F.lit(8)).alias("b")).select("b.*").first()
    assert tuple(got) == (0, 1, 30, 8)


def test_evidence_checks(spark):
    rows = spark.createDataFrame([("high", 0.5), ("low", 1.5)], "severity string, confidence double")
    assert evidence.checked(rows.limit(1)).count() == 1
    with pytest.raises(Exception, match="out of range"):
        evidence.checked(rows).collect()
    with pytest.raises(Exception, match="empty chain"):
        evidence.checked_decisions(spark.createDataFrame([(0, 5.0)], "chain int, trust double")).collect()
    ids = [r.x for r in spark.createDataFrame([("a",), ("a",), (None,)], "k string").select(evidence.row_id("ev", "k").alias("x")).collect()]
    assert ids[0] == ids[1] != ids[2] and all(len(i) == 15 and i.startswith("ev_") for i in ids)
    assert spark.range(1).select(evidence.public_entries(F.create_map(F.lit("_raw"), F.lit(1), F.lit("pan"), F.lit(2))).alias("m")).first().m == {"pan": 2}


def test_roc_against_pairs(spark):
    rng = np.random.default_rng(5)
    s, t = np.round(rng.uniform(0, 1, 200), 1), rng.uniform(0, 1, 200) < 0.4
    got = evaluation.roc_report(spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, t)], "s double, t boolean"), "s", "t").first()
    want = np.mean([1.0 if p > n else 0.5 if p == n else 0.0 for p in s[t] for n in s[~t]])
    assert got.auc == pytest.approx(want, abs=1e-6) and got.tp == int((t & (s >= 0.5)).sum()) and got.accuracy == pytest.approx(np.mean(t == (s >= 0.5)), abs=1e-6)


def test_cross_validation_leaves_a_fold_out(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(x), float(rng.uniform()), int(x > 0)) for i, x in enumerate(rng.normal(0, 1, 150))]
    out = evaluation.cross_validated(spark.createDataFrame(rows, "k long, a double, b double, y int"), "k", ["a", "b"], "y", n=3, trees=5)
    got = out.collect()
    assert sorted(r.k for r in got) == list(range(150)) and {r.fold for r in got} == {0, 1, 2}
    assert evaluation.roc_report(out.withColumn("t", F.col("y") == 1), "probability", "t").first().auc > 0.95


def test_editable_fields(spark):
    rows = [("a", "money", "up", "r"), ("b", "logo", "up", "r"), ("c", "text", "none", "r"), ("d", "text", None, "r"), ("e", "pan", "swap", None), ("_balance_column", "money", "up", "r")]
    assert [r.name for r in review.editable(spark.createDataFrame(rows, "name string, kind string, fraud string, rect string")).collect()] == ["a"]
