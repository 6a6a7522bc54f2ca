"""Queries over pixels: embeddings set side by side as images, with copies, recompressed parts and learned masks in them.

Sixty-four vectors of 8 x 8 values make an image of 64 x 64 pixels.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vettra.operators import clones, grids, masks, pixels
from vettra.sources.shared import written
from vettra.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


CTE = {
    "mosaic": """points AS (SELECT vec_id, label, unnest(embedding) AS e, unnest(range(len(embedding))) AS i FROM embeddings),
mosaic AS (SELECT vec_id // 64 AS image, ((vec_id % 64) // 8 * 8 + i // 8)::INTEGER AS y, (vec_id % 8 * 8 + i % 8)::INTEGER AS x, label, greatest(0, least(255, floor(128 + 400 * e::DOUBLE)))::DOUBLE AS v FROM points)""",
}


def mosaic(spark, sf):
    """(image, y, x, label, v) of every pixel."""
    at = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "e"))
    return at.select(
        F.floor(F.col("vec_id") / 64).alias("image"), (F.floor(F.col("vec_id") % 64 / 8) * 8 + F.floor(F.col("i") / 8)).cast("int").alias("y"), (F.col("vec_id") % 8 * 8 + F.col("i") % 8).cast("int").alias("x"),
        "label", F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 400 * F.col("e").cast("double")))).cast("double").alias("v"),
    )


@query(None)
def copied_regions(spark, sf):
    """In every other image the first 16 x 16 pixels are copied 40 rows down and 32 columns on."""
    all_ = written(mosaic(spark, sf).select("image", "y", "x", "v"), "mosaic")
    copy = all_.where("image % 2 = 0 AND y < 16 AND x < 16").select("image", (F.col("y") + 40).alias("y"), (F.col("x") + 32).alias("x"), "v")
    points = all_.join(copy.select("image", "y", "x"), ["image", "y", "x"], "left_anti").unionByName(copy)
    return clones.copied_regions(points, "image", block=8, reach=4)


@query(f"""WITH {CTE['mosaic']}, b AS (SELECT image, y // 4 AS gy, x // 4 AS gx, round(avg(v), 4) AS v FROM mosaic GROUP BY ALL HAVING count(*) = 16),
top AS (SELECT * FROM b a WHERE v >= 140 AND NOT EXISTS (SELECT 1 FROM b o WHERE o.image = a.image AND abs(o.gy - a.gy) <= 2 AND abs(o.gx - a.gx) <= 2 AND (o.v > a.v OR (o.v = a.v AND (o.gy < a.gy OR (o.gy = a.gy AND o.gx < a.gx))))))
SELECT image, row_number() OVER (PARTITION BY image ORDER BY v DESC, gy, gx) AS place, gy, gx, v FROM top""")
def grid_peaks(spark, sf):
    """Blocks that are brighter than all within two rows and columns."""
    blocks = pixels.whole_blocks(mosaic(spark, sf).drop("label"), "image", 4).groupBy("image", "gy", "gx").agg(F.round(F.avg("v"), 4).alias("v"))
    return grids.peaks(blocks, "image", 2, 140.0)


_TILES = masks.tile_starts(64, 16)


@query(f"""WITH RECURSIVE {CTE['mosaic']}, starts AS (SELECT unnest({_TILES}) AS s),
tiles AS (SELECT image, a.s AS y0, b.s AS x0, CASE WHEN any_value(label) FILTER (y = a.s AND x = b.s) >= 2 THEN 1 ELSE 0 END AS gate FROM mosaic, starts a, starts b GROUP BY ALL),
blend AS (SELECT image, y, x, avg(gate * v / 255) AS p FROM mosaic JOIN tiles USING (image) WHERE y BETWEEN y0 AND y0 + 15 AND x BETWEEN x0 AND x0 + 15 GROUP BY ALL),
marked AS (SELECT * FROM blend WHERE p >= 0.65),
reach AS (SELECT image, y, x, y * 100000 + x AS r FROM marked UNION SELECT m.image, m.y, m.x, r.r FROM reach r JOIN marked m ON m.image = r.image AND greatest(abs(m.y - r.y), abs(m.x - r.x)) = 1),
roots AS (SELECT image, y, x, min(r) AS root FROM reach GROUP BY ALL)
SELECT image, (root // 100000)::INTEGER AS root_y, (root % 100000)::INTEGER AS root_x, count(*) AS n, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1, round(avg(p), 6) AS mean FROM roots JOIN marked USING (image, y, x) GROUP BY image, root HAVING count(*) >= 4""")
def mask_regions(spark, sf):
    """Masks of 16 x 16 tiles, a quarter of which overlap, as probabilities of their pixels; the class of a tile is that of its first pixel."""
    points = written(mosaic(spark, sf), "mosaic")
    starts = F.array(*map(F.lit, _TILES))
    of = lambda c: F.filter(starts, lambda s: F.col(c).between(s, s + 15))
    each = points.withColumn("y0", F.explode(of("y"))).withColumn("x0", F.explode(of("x")))
    first = F.max(F.when((F.col("y") == F.col("y0")) & (F.col("x") == F.col("x0")), F.col("label")))
    place = ((F.col("y") - F.col("y0")) * 16 + F.col("x") - F.col("x0")).cast("int")
    held = F.map_from_entries(F.collect_list(F.struct(place.alias("i"), (F.col("v") / 255).alias("p"))))  # a tile's pixels
    rows = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.try_element_at(held, i), F.lit(0.0)))
    tiles = each.groupBy("image", "y0", "x0").agg(F.lit(16).alias("width"), F.when(first >= 2, 0.9).otherwise(0.1).alias("certainty"), rows.alias("mask"))
    found = masks.mask_regions(masks.blended(tiles, "image"), "image", at=0.65, least=4, side=16)
    return found.withColumn("mean", F.round("mean", 6))


#: Error levels: recompression rounds to steps of 8, but where the label is 3 the image was rounded to other steps before.
_AGAIN = "floor(v / 8) * 8"


@query(f"""WITH RECURSIVE {CTE['mosaic']}, channels AS (SELECT image, y, x, label, CASE WHEN label = 3 THEN v ELSE floor(v / 8) * 8 + 1 END AS r, 255 - v AS g FROM mosaic),
energy AS (SELECT image, y, x, greatest(abs(r - floor(r / 8) * 8), CASE WHEN label = 3 THEN 30 ELSE 0 END) AS e FROM channels),
blocks AS (SELECT image, y // 4 AS gy, x // 4 AS gx, avg(e) AS v FROM energy GROUP BY ALL HAVING count(*) = 16),
m AS (SELECT image, median(v) AS med, max(v) AS top FROM blocks GROUP BY 1), d AS (SELECT image, median(abs(v - med)) AS mad FROM blocks JOIN m USING (image) GROUP BY 1),
marked AS (SELECT image, gy, gx, v, greatest(med + 6 * 1.4826 * (mad + 1e-6), 14) AS cut, top FROM blocks JOIN m USING (image) JOIN d USING (image) WHERE v > greatest(med + 6 * 1.4826 * (mad + 1e-6), 14)),
reach AS (SELECT image, gy, gx, gy * 1000 + gx AS r FROM marked UNION SELECT k.image, k.gy, k.gx, r.r FROM reach r JOIN marked k ON k.image = r.image AND abs(k.gy - r.gy) + abs(k.gx - r.gx) = 1),
roots AS (SELECT image, gy, gx, min(r) AS root FROM reach GROUP BY ALL)
SELECT image, (root // 1000)::INTEGER AS root_y, (root % 1000)::INTEGER AS root_x, count(*)::INTEGER AS n, min(gy)::INTEGER AS y0, min(gx)::INTEGER AS x0, max(gy)::INTEGER AS y1, max(gx)::INTEGER AS x1,
  round(greatest(0, least(1, (avg(v) - any_value(cut)) / CASE WHEN any_value(top) = any_value(cut) THEN 1 ELSE any_value(top) - any_value(cut) END)), 3) AS strength FROM roots JOIN marked USING (image, gy, gx) GROUP BY image, root HAVING count(*) >= 3""")
def error_level_regions(spark, sf):
    """An image and its recompression, pixel against pixel in three channels."""
    points = mosaic(spark, sf)
    odd = F.col("label") == 3
    original = points.select("image", "y", "x", "label", F.when(odd, F.col("v")).otherwise(F.floor(F.col("v") / 8) * 8 + 1).cast("double").alias("r"), (255 - F.col("v")).alias("g"), F.lit(0.0).alias("b"))
    again = original.select("image", "y", "x", (F.floor(F.col("r") / 8) * 8).cast("double").alias("r"), "g", F.when(odd, 30.0).otherwise(0.0).alias("b"))
    return pixels.level_regions(pixels.error_levels(original.drop("label"), again, "image", 4), "image")


_STEPS = {55: 45, 65: 35, 75: 25, 85: 15, 95: 5}


@query(f"""WITH RECURSIVE {CTE['mosaic']}, saved AS (SELECT image, y, x, floor(v / CASE WHEN label IN (2, 3) THEN 45 ELSE 15 END) * CASE WHEN label IN (2, 3) THEN 45 ELSE 15 END AS v FROM mosaic),
steps(quality, step) AS (VALUES {', '.join(f'({q}, {s})' for q, s in _STEPS.items())}),
curves AS (SELECT image, y // 4 AS gy, x // 4 AS gx, quality, avg(abs(v - round(v / step) * step)) AS difference FROM saved, steps GROUP BY ALL HAVING count(*) = 16),
best AS (SELECT image, gy, gx, quality AS q FROM curves QUALIFY row_number() OVER (PARTITION BY image, gy, gx ORDER BY difference, quality) = 1),
marked AS (SELECT image, gy, gx, q FROM best JOIN (SELECT image, median(q) AS usual FROM best GROUP BY 1) USING (image) WHERE abs(q - usual) >= 20),
reach AS (SELECT image, gy, gx, gy * 1000 + gx AS r FROM marked UNION SELECT k.image, k.gy, k.gx, r.r FROM reach r JOIN marked k ON k.image = r.image AND abs(k.gy - r.gy) + abs(k.gx - r.gx) = 1),
roots AS (SELECT image, gy, gx, min(r) AS root FROM reach GROUP BY ALL)
SELECT image, (root // 1000)::INTEGER AS root_y, (root % 1000)::INTEGER AS root_x, count(*)::INTEGER AS n, min(gy)::INTEGER AS y0, min(gx)::INTEGER AS x0, max(gy)::INTEGER AS y1, max(gx)::INTEGER AS x1, min(q)::INTEGER AS quality, 0.4::DOUBLE AS strength
FROM roots JOIN marked USING (image, gy, gx) GROUP BY image, root HAVING count(*) >= 3""")
def recompression_ghosts(spark, sf):
    """Blocks that were saved at a lower quality than their image, from their differences to five recompressions."""
    step = F.when(F.col("label").isin(2, 3), 45).otherwise(15)
    saved = mosaic(spark, sf).select("image", "y", "x", (F.floor(F.col("v") / step) * step).cast("double").alias("v"))
    qualities = F.array(*(F.struct(F.lit(q).alias("quality"), F.lit(s).alias("step")) for q, s in _STEPS.items()))
    again = saved.select("image", "y", "x", "v", F.explode(qualities).alias("s"))
    off = F.abs(F.col("v") - F.round(F.col("v") / F.col("s.step")) * F.col("s.step"))
    blocks = pixels.whole_blocks(again.select("image", "y", "x", F.col("s.quality").alias("quality"), off.alias("off")), "image", 4)
    return pixels.ghost_regions(blocks.groupBy("image", "quality", "gy", "gx").agg(F.avg("off").alias("difference")), "image")
