"""Findings from parsed document facts and from block grids of images."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vettra.functions import fixed, scalars
from vettra.operators import grids
from vettra.operators.documents import suspicious_producer


def font_base(font: Column) -> Column:
    """Family of a font: lower case without marks, then without each suffix in turn."""
    out = F.regexp_replace(F.lower(F.coalesce(font, F.lit(""))), "[-_ ]", "")
    for suffix in fixed.FONT_SUFFIXES:
        out = F.regexp_replace(out, f"{suffix}$", "")
    return F.trim(out)


def holds(name: Column, words: tuple[str, ...]) -> Column:
    return F.greatest(*(name.contains(w) for w in words), F.lit(False))


def fact(df: DataFrame, part: int, severity: str, title: str, confidence: float, count: Column | int = 1) -> DataFrame:
    n = F.lit(count) if isinstance(count, int) else count
    return df.select("doc", F.col("page").cast("int").alias("page"), F.lit(part).alias("part"), F.lit(severity).alias("severity"), F.lit(title).alias("title"), F.lit(confidence).alias("confidence"), n.cast("int").alias("n"))


def without_page(df: DataFrame) -> DataFrame:
    return df.withColumn("page", F.lit(None).cast("int"))


def metadata_findings(docs: DataFrame, as_of: Column) -> list[DataFrame]:
    """Authoring tools that issuers don't use, and modification or creation dates that don't fit. docs: (doc, producer, created, modified)."""
    d = without_page(docs)
    gap, ahead = scalars.floor_days(F.col("modified"), F.col("created")), scalars.floor_days(F.col("created"), as_of)
    return [
        fact(d.where(suspicious_producer(F.col("producer"))), -3, "high", "Suspicious PDF producer", 0.90),
        fact(d.where(gap > 30), -2, "medium", "Modified long after creation", 0.80),
        fact(d.where(gap < 0), -1, "high", "Impossible date order", 0.98),
        fact(d.where(ahead > 30), 0, "high", "Created in the future", 0.98),
    ]


def font_findings(spans: DataFrame) -> DataFrame:
    """Pages whose body text (8 to 20 points) has a font that the dominant one doesn't explain.

    spans: (doc, page, place, text, font, size). Ties go to the font met first. n counts the suspect families.
    """
    body = spans.where((F.trim("text") != "") & F.col("size").between(8, 20)).select("doc", "page", "place", font_base(F.col("font")).alias("base"))
    counts = body.groupBy("doc", "page", "base").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("at"))
    w = Window.partitionBy("doc", "page").orderBy(F.desc("n"), "at", "base")
    ranked = counts.withColumn("dominant", F.first("base").over(w)).where(F.col("base") != F.col("dominant"))
    serif = holds(F.col("dominant"), fixed.SANS_WORDS) & holds(F.col("base"), fixed.SERIF_WORDS)
    odd = ~F.col("base").isin(*fixed.BODY_FONTS) & ~F.startswith(F.col("base"), F.substring("dominant", 1, 4))
    return fact(ranked.where(serif | odd).groupBy("doc", "page").agg(F.count(F.lit(1)).alias("k")), 2, "high", "Font inconsistency in body text", 0.85, F.col("k"))


def whitebox_findings(covered: DataFrame) -> DataFrame:
    """From (doc, page, rect), the white rectangles that cover text: one finding a page."""
    return fact(covered.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("k")), 1, "high", "White-box edit detected (covered text)", 0.88, F.col("k"))


def duplicate_image_findings(images: DataFrame) -> DataFrame:
    """Documents with one content on several images, or one image twice on a page. images: (doc, page, xref, sha256)."""
    content = images.where(F.col("sha256").isNotNull()).groupBy("doc", "sha256").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc")
    twice = images.groupBy("doc", "page", "xref").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc")
    return fact(without_page(content.unionByName(twice).distinct()), 3, "medium", "Duplicate image objects detected (copy-paste signal)", 0.80)


def incremental_findings(docs: DataFrame) -> DataFrame:
    """docs: (doc, eof_count)."""
    return fact(without_page(docs.where("eof_count > 1")), 4, "medium", "Incremental update detected", 0.92, F.col("eof_count"))


def reocr_findings(hidden: DataFrame, pages: DataFrame, least: int = 40) -> DataFrame:
    """Pages with text-layer values that nothing visible explains; pages with less than `least` recognised characters are skipped.

    hidden: (doc, page, token). pages: (doc, page, ocr_chars).
    """
    readable = pages.where(F.col("ocr_chars") >= least).select("doc", "page")
    found = hidden.join(readable, ["doc", "page"], "left_semi").groupBy("doc", "page").agg(F.count_distinct("token").alias("k"))
    return fact(found, 5, "high", "Visible text differs from the text layer", 0.85, F.col("k"))


def document_findings(*parts: DataFrame) -> DataFrame:
    """All findings of a document, numbered in the order of detectors and pages (``seq``)."""
    both = reduce(DataFrame.unionByName, parts)
    return both.withColumn("seq", F.row_number().over(Window.partitionBy("doc").orderBy("part", F.col("page").asc_nulls_first(), "title")))


def sensitive_money(text: Column) -> Column:
    """{digits: literal as first found} of amounts behind a currency mark with 4 digits or more."""
    literals = F.regexp_extract_all(text, F.lit(r"(?i)(?:Rs\.?|INR|₹)\s*(\d(?:[\d,]*\d)?)"), 1)
    keyed = F.transform(F.filter(literals, lambda x: F.length(F.regexp_replace(x, ",", "")) >= 4), lambda x: F.struct(F.regexp_replace(x, ",", "").alias("k"), x.alias("v")))
    first = F.filter(keyed, lambda e, i: F.array_position(F.transform(keyed, lambda y: y["k"]), e["k"]) == i + 1)
    return F.map_from_entries(first)


def sensitive_pans(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"), 1))


def grid_regions(marked: DataFrame, key: str, least: int, most: Column) -> DataFrame:
    """(key, root_y, root_x, n, box, mean): 4-connected groups of marked cells (key, gy, gx, v) of a fitting size.

    most: the largest size, from a column `total` with the image's number of cells.
    """
    cells = grids.labelled(marked, key).join(marked, [key, "gy", "gx"])
    out = cells.groupBy(key, "root_y", "root_x").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.min("gy").alias("y0"), F.min("gx").alias("x0"), F.max("gy").alias("y1"), F.max("gx").alias("x1"), F.avg("v").alias("mean"), F.first("total").alias("total"), F.first("level").alias("level"),
    )
    return out.where((F.col("n") >= least) & (F.col("n") <= most))


def noise_regions(blocks: DataFrame, key: str, floor: float = fixed.NOISE_FLOOR, least: int = fixed.NOISE_CELLS, most: float = fixed.NOISE_MOST, regions: int = fixed.NOISE_REGIONS) -> DataFrame:
    """Regions that lost the page's noise, from (key, gy, gx, sigma); sigma is null where a block can't be measured.

    Images with few measured blocks, or next to no noise, or more than `regions` regions have none.
    """
    stats = blocks.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count("sigma").alias("valid"), F.median("sigma").alias("mid"))
    low = F.col("mid") * fixed.NOISE_LOW
    marked = blocks.join(stats.where((F.col("valid") >= fixed.NOISE_VALID) & (F.col("mid") >= floor)), key).where(F.col("sigma") < low).select(key, "gy", "gx", F.col("sigma").alias("v"), "total", low.alias("level"))
    found = grid_regions(marked, key, least, most * F.col("total"))
    strength = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("level") - F.col("mean")) / F.when(F.col("level") == 0, 1.0).otherwise(F.col("level"))))
    few = found.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy(key))).where(F.col("of") <= regions)
    return few.select(key, "root_y", "root_x", "n", "y0", "x0", "y1", "x1", F.round(strength, 3).alias("strength"))


def fill_regions(blocks: DataFrame, pages: DataFrame, key: str, white: float = fixed.FILL_WHITE, floor: float = fixed.NOISE_FLOOR, least: int = fixed.FILL_CELLS, most: float = fixed.FILL_MOST) -> DataFrame:
    """Solid mid-tone fills, from (key, gy, gx, mean, std), on white pages without a noise floor: (key, white_share, noise_mid)."""
    paper = pages.where((F.col("white_share") >= white) & (F.coalesce("noise_mid", F.lit(0.0)) < floor)).select(key)
    page = blocks.join(paper, key, "left_semi")
    flat = F.col("std") < fixed.FILL_STD
    stats = page.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.median(F.when(flat, F.col("mean"))).alias("level"))
    odd = flat & (F.col("mean") > fixed.FILL_LOW) & (F.col("mean") < fixed.FILL_HIGH) & (F.abs(F.col("mean") - F.col("level")) > fixed.FILL_DELTA)
    marked = page.join(stats, key).where(odd).select(key, "gy", "gx", F.col("mean").alias("v"), "total", "level")
    found = grid_regions(marked, key, least, most * F.col("total"))
    strength = F.least(F.lit(1.0), F.abs(F.col("mean") - F.col("level")) / 60.0)
    return found.select(key, "root_y", "root_x", "n", "y0", "x0", "y1", "x1", F.round(strength, 3).alias("strength"))


def corroborated(regions: DataFrame, key: str) -> DataFrame:
    """(key, detector, region, severity, confidence): what the detectors' regions say together.

    regions: (key, detector, region, strength, x0, y0, x1, y1). Noise counts alone and is high when ELA agrees; fills and ELA
    give way to stronger regions that they overlap; clones and ghosts count only on top of noise or ELA.
    """
    each = F.struct("detector", "region", "strength", "x0", "y0", "x1", "y1")
    all_of = regions.groupBy(key).agg(F.collect_list(each).alias("all"))  # an image has few regions
    one = all_of.select(key, "all", F.explode("all").alias("r"))
    over = lambda *names: F.exists("all", lambda o: o["detector"].isin(*names) & (o["x0"] < F.col("r.x1")) & (F.col("r.x0") < o["x1"]) & (o["y0"] < F.col("r.y1")) & (F.col("r.y0") < o["y1"]))
    of, strength = F.col("r.detector"), F.col("r.strength")
    severity = (
        F.when(of == "noise", F.when((strength >= 0.5) | over("ela"), "high").otherwise("medium"))
        .when((of == "flat_fill") & ~over("noise", "ela"), F.when(over("copy_move"), "high").otherwise("medium"))
        .when((of == "ela") & ~over("noise"), scalars.region_severity(strength))
        .when((of == "copy_move") & over("noise", "ela"), "high")
        .when((of == "jpeg_ghost") & over("noise", "ela"), "medium")
    )
    confidence = F.when(of == "noise", F.when(over("ela"), 0.7).otherwise(0.6)).when(of == "flat_fill", 0.55).when(of == "copy_move", 0.8).otherwise(0.6)
    return one.select(key, of.alias("detector"), F.col("r.region").alias("region"), severity.alias("severity"), confidence.alias("confidence")).where(F.col("severity").isNotNull())


def recapture_findings(peaks: DataFrame, key: str, least: int = 4, level: float = 44.0) -> DataFrame:
    """Images with at least `least` spectral peaks (key, place, bin, level) of `level` decibels: one medium finding, without a box."""
    strong = peaks.where(F.col("level") >= level).groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("peaks"), F.max("level").alias("top"))
    return strong.where(F.col("peaks") >= least).select(key, "peaks", F.lit("recapture").alias("detector"), F.lit("medium").alias("severity"), F.lit(0.6).alias("confidence"))


def merged_findings(structural: DataFrame, raster: DataFrame, pages: DataFrame, key: str, least: int = 40) -> DataFrame:
    """Structural findings of a document and raster ones of its pages with less than `least` characters of text.

    structural: (key, severity). raster: (key, page, severity). pages: (key, page, chars).
    """
    scanned = pages.where(F.col("chars") < least).select(key, "page")
    return structural.select(key, "severity").unionByName(raster.join(scanned, [key, "page"], "left_semi").select(key, "severity"))


def deep_scan(regions: DataFrame, pages: DataFrame, least: int = 40) -> DataFrame:
    """(doc, page, severity, title, confidence, n, x0, y0, x1, y1): raster findings of pages without a text layer, one a page.

    regions: (doc, page, detector, region, strength, x0, y0, x1, y1) in pixels. pages: (doc, page, chars, width, height). Regions
    back each other up as those of one image do; the box around what is left is in shares of the page. This is evidence and no
    feature: pristine text pages would fire, so pages with `least` characters of text are skipped.
    """
    scanned = pages.where(F.col("chars") < least).select("doc", "page", "width", "height")
    shown = regions.join(scanned, ["doc", "page"], "left_semi").withColumn("image", F.struct("doc", "page"))
    sure = corroborated(shown, "image")
    best = sure.groupBy("image").agg(F.max_by("severity", scalars.by_severity(F.col("severity"), 0)).alias("severity"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).cast("int").alias("n"))
    box = shown.join(sure.select("image", "detector", "region"), ["image", "detector", "region"], "left_semi").groupBy("image").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    out = best.join(box, "image").select("image.doc", "image.page", "severity", "confidence", "n", "x0", "y0", "x1", "y1").join(scanned, ["doc", "page"])
    share = lambda c, of: F.when(F.col(of) > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / F.col(of))), 6)).alias(c)
    return out.select("doc", "page", "severity", F.lit("Tampered region on a scanned page").alias("title"), "confidence", "n", share("x0", "width"), share("y0", "height"), share("x1", "width"), share("y1", "height"))


def template_fingerprint(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, fingerprint): documents of one template agree in producer, pages, and each page's fonts, images and drawings.

    pages: (doc, page, fonts, images, drawings). docs: (doc, producer).
    """
    line = F.concat_ws(",", "page", "fonts", "images", "drawings")
    per = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", line.alias("l")))), lambda x: x["l"]), ";").alias("layout"))  # a document's pages
    text = F.concat_ws("|", F.coalesce("producer", F.lit("")), F.coalesce("n", F.lit(0)).cast("string"), F.coalesce("layout", F.lit("")))
    return docs.join(per, "doc", "left").select("doc", F.left(F.sha2(text.cast("binary"), 256), F.lit(32)).alias("fingerprint"))


def heat(blocks: DataFrame, key: str) -> DataFrame:
    """Block values as 8-bit shares of their image's largest."""
    top = F.max("v").over(Window.partitionBy(key))
    return blocks.withColumn("heat", F.coalesce(F.floor(F.try_divide(F.col("v"), top) * 255), F.lit(0)).cast("int"))
