"""Copied regions, masks over tiles, error levels and ghosts on made images, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vettra.operators import boxes, clones, grids, linkage, masks, pixels
from vettra.plans import catalogue


def points(spark, *images):
    rows = [(k, y, x, float(a[y, x])) for k, a in enumerate(images) for y, x in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, "k int, y int, x int, v double")


def texture(seed, shape):
    return np.random.default_rng(seed).integers(0, 256, shape).astype(float)


def plain_bilateral(a):
    pad, out = np.pad(a, 2, mode="edge"), np.zeros_like(a)
    disc = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if i * i + j * j <= 4]
    for y, x in np.ndindex(a.shape):
        v = [pad[y + 2 + i, x + 2 + j] for i, j in disc]
        s = [np.exp(-(i * i + j * j) / 50 - (u - a[y, x]) ** 2 / 3200) for (i, j), u in zip(disc, v)]
        out[y, x] = np.dot(s, v) / sum(s)
    return out


def plain_copies(a, block, reach, neighbours=3, shift=30, least=10):
    """Descriptions, matches, votes and correlations by loops over all blocks."""
    basis = clones.cosine_basis(block, clones.COEFFICIENTS)
    groups = {}
    for y in range(a.shape[0] - block + 1):
        for x in range(a.shape[1] - block + 1):
            b = a[y : y + block, x : x + block]
            if b.std() >= clones.STRUCTURE:
                c = np.einsum("ij,kij->k", b, basis) / clones.STEP
                for band in (0, 1):
                    groups.setdefault((band, tuple(np.floor(c + band / 2).astype(int))), []).append((y, x))
    pairs = {(p, q) for g in groups.values() for i, p in enumerate(g) for q in g[i + 1 : i + 1 + neighbours] if np.hypot(q[0] - p[0], q[1] - p[1]) >= shift}

    def window(p):
        y, x = p[0] + block // 2 - reach, p[1] + block // 2 - reach
        if y < 0 or x < 0 or y + 2 * reach > a.shape[0] or x + 2 * reach > a.shape[1]:
            return None
        w = a[y : y + 2 * reach, x : x + 2 * reach]
        return w, w - plain_bilateral(w)

    ncc = lambda p, q: ((p - p.mean()) * (q - q.mean())).sum() / (np.sqrt(((p - p.mean()) ** 2).sum()) * np.sqrt(((q - q.mean()) ** 2).sum()) + 1e-6)
    half = lambda v: int(np.floor(abs(v) + 0.5) * np.sign(v))
    bins = {}
    for p, q in pairs:
        bins.setdefault((half((q[0] - p[0]) / 8), half((q[1] - p[1]) / 8)), []).append((p, q))
    out = {}
    for s, ps in bins.items():
        if len(ps) >= least:
            sure = [(p, q) for p, q in ps if (u := window(p)) and (v := window(q)) and ncc(u[0], v[0]) >= 0.92 and ncc(u[1], v[1]) >= 0.30]
            if len(sure) >= least:
                out[s] = (len(sure), min(q[0] for _, q in sure), min(q[1] for _, q in sure))
    return out


def test_copied_regions_against_loops(spark):
    a = texture(1, (70, 90))
    a[45:65, 50:72] = a[3:23, 10:32]
    a[30:40] = 200.0  # flat
    spread = texture(2, (70, 90))
    spread[:, 45:] = spread[:, :45]  # half the page repeats: no compact group
    got = {}
    for side in (16, 128):
        found = clones.copied_regions(points(spark, a, spread), "k", block=8, reach=6, side=side).collect()
        got[side] = sorted((r.k, r.sy, r.sx, r.n, r.y0, r.x0) for r in found)
        assert [r.strength for r in found] == [1.0]
    want = [(0, *s, *v) for s, v in plain_copies(a, 8, 6).items()]
    assert got[16] == got[128] == want and len(want) == 1


def test_same_content_without_the_same_noise_is_no_copy(spark):
    rng = np.random.default_rng(3)
    glyph = 20.0 + np.kron(rng.integers(0, 2, (3, 3)), np.ones((7, 7))) * 200.0
    a = np.full((64, 96), 20.0)
    a[4:25, 6:27] = glyph
    a[38:59, 60:81] = glyph
    own = a + rng.normal(0, 2, a.shape)
    assert clones.copied_regions(points(spark, own), "k", block=8, step=64.0, reach=6, most=0.2).count() == 0
    same = own.copy()
    same[38:59, 60:81] = same[4:25, 6:27]
    assert clones.copied_regions(points(spark, same), "k", block=8, step=64.0, reach=6, most=0.2).count() == 1
    assert clones.copied_regions(points(spark, np.full((40, 40), 9.0)), "k", block=8, reach=6).count() == 0
    assert clones.copied_regions(points(spark, own).limit(0), "k").count() == 0


def plain_regions(a, at, least):
    left = {(y, x) for y, x in np.ndindex(a.shape) if a[y, x] >= at}
    out = []
    while left:
        group, edge = set(), [left.pop()]
        while edge:
            y, x = edge.pop()
            group.add((y, x))
            near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            edge += near
        if len(group) >= least:
            ys, xs = [p[0] for p in group], [p[1] for p in group]
            out.append((*min(group), len(group), min(ys), min(xs), max(ys), max(xs)))
    return sorted(out)


@pytest.mark.parametrize("side", [3, 8, 64])
def test_regions_over_seams_equal_whole_images(spark, side):
    rng = np.random.default_rng(side)
    snake = np.zeros((24, 24))
    snake[::4] = 1
    snake[2::8, :1], snake[6::8, -1:] = 1, 1
    snake[1::8, :1], snake[3::8, :1], snake[5::8, -1:], snake[7::8, -1:] = 1, 1, 1, 1
    images = [rng.random((20, 26)), snake, np.ones((9, 9)), np.zeros((5, 5))]
    df = points(spark, *images).withColumnRenamed("v", "p")
    found = masks.mask_regions(df, "k", at=0.6, least=3, side=side).collect()
    for k, a in enumerate(images):
        assert sorted((r.root_y, r.root_x, r.n, r.y0, r.x0, r.y1, r.x1) for r in found if r.k == k) == plain_regions(a, 0.6, 3)
    assert masks.mask_regions(df.limit(0), "k").count() == 0


def test_blended_tiles(spark):
    assert masks.tile_starts(64, 16) == [0, 12, 24, 36, 48] and masks.tile_starts(10, 16) == [0] and masks.tile_starts(500, 384) == [0, 116]
    rows = [(1, 0, 0, 2, 0.9, [1.0, 0.5, 0.2, 0.4]), (1, 0, 1, 2, 0.2, [1.0, 1.0, 1.0, 1.0])]
    got = {(r.y, r.x): r.p for r in masks.blended(spark.createDataFrame(rows, "k int, y0 int, x0 int, width int, certainty double, mask array<double>"), "k").collect()}
    assert got == {(0, 0): 1.0, (0, 1): 0.25, (0, 2): 0.0, (1, 0): 0.2, (1, 1): 0.2, (1, 2): 0.0}


def test_least_reachable_on_a_long_path(spark):
    order = np.random.default_rng(1).permutation(300).tolist()
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(1000, 1001), (1001, 1000), (2000, 2000)], "a long, b long")
    got = {r.node: r.least for r in linkage.least_reachable(edges).collect()}
    assert got == dict.fromkeys(range(300), 0) | {1000: 1000, 1001: 1000, 2000: 2000}


def test_error_levels_and_ghosts(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 200, (64, 64)).astype(float)
    b = a + rng.integers(-2, 3, a.shape)
    b[16:32, 16:40] += 40
    wide = lambda x: points(spark, x).select("k", "y", "x", F.col("v").alias("r"), F.lit(0.0).alias("g"), F.lit(0.0).alias("b"))
    found = pixels.level_regions(pixels.error_levels(wide(a), wide(b), "k", 8), "k").collect()
    assert [(r.n, r.y0, r.x0, r.y1, r.x1) for r in found] == [(6, 2, 2, 3, 4)] and 0 < found[0].strength <= 1
    assert pixels.level_regions(pixels.error_levels(wide(a), wide(a), "k", 8), "k").count() == 0
    curves = [(1, q, y, x, abs(q - (55 if y == 3 and x < 4 else 85)) / 10) for q in (55, 65, 75, 85, 95) for y in range(6) for x in range(6)] + [(2, q, 0, 0, 1.0) for q in (55, 65)]
    got = pixels.ghost_regions(spark.createDataFrame(curves, "k int, quality int, gy int, gx int, difference double"), "k").collect()
    assert [(r.k, r.n, r.y0, r.x0, r.y1, r.x1, r.quality, r.strength) for r in got] == [(1, 4, 3, 0, 3, 3, 55, 0.4)]


def test_peaks_against_a_search(spark):
    a = np.random.default_rng(6).integers(0, 6, (12, 15)).astype(float)
    cells = points(spark, a).select("k", F.col("y").alias("gy"), F.col("x").alias("gx"), "v")
    want = []
    for y, x in np.ndindex(a.shape):
        near = [(a[i, j], -i, -j) for i in range(max(0, y - 2), min(12, y + 3)) for j in range(max(0, x - 2), min(15, x + 3))]
        if a[y, x] >= 3 and max(near) == (a[y, x], -y, -x):
            want.append((-a[y, x], y, x))
    got = grids.peaks(cells, "k", 2, 3.0).orderBy("place").collect()
    assert [(-r.v, r.gy, r.gx) for r in got] == sorted(want) and [r.place for r in got] == list(range(1, len(want) + 1))


def test_boxes_in_few_held_cells():
    """Areas and cells of boxes, held whole or a few at a time, far apart or not, are those of sets of cells; work is cut inside a group as well."""
    rng = np.random.default_rng(11)
    for far in (1, 4000):
        row = np.sort(rng.integers(0, 7, 60))
        low = rng.integers(0, 12, (60, 2)) * far
        box = np.column_stack([low, low + rng.integers(0, 7, (60, 2))]).astype(float)
        kept = (box[:, 0] < box[:, 2]) & (box[:, 1] < box[:, 3])
        row, box, side = row[kept], box[kept], rng.integers(0, 2, 60)[kept]
        sets = [[{(x, y) for k, (x0, y0, x1, y1) in zip(row, box) if k == i for x in range(int(x0), int(x1)) for y in range(int(y0), int(y1))} for i in range(8)], *(
            [{(x, y) for k, c, (x0, y0, x1, y1) in zip(row, side, box) if k == i and c == s for x in range(int(x0), int(x1)) for y in range(int(y0), int(y1))} for i in range(8)] for s in (0, 1))]
        for held in (1, 10, 10_000_000):
            assert boxes.union_areas(row, box, 8, held).tolist() == [len(s) for s in sets[0]]
            got = list(boxes.shared_cells(*((row[side == s], box[side == s]) for s in (0, 1)), 8, held))
            assert [lo for lo, *_ in got] == [0, *(hi for _, hi, *_ in got[:-1])] and got[-1][1] == 8
            assert np.concatenate([b for _, _, b, _ in got]).tolist() == [len(a & b) for a, b in zip(*sets[1:])]
            assert np.concatenate([e for *_, e in got]).tolist() == [len(a | b) for a, b in zip(*sets[1:])]


def test_masks_meet_in_one_exchange(spark):
    """Boxes are sent, not the cells under them: a page's masks are made where its boxes meet."""
    for name in ("mask_cells_iou", "mask_cells_iou_all"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan
