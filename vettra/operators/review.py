"""What reviewers and reports ask of findings, cases and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vettra.functions.scalars import by_severity
from vettra.operators.ordered import one_per


def ok_by_type(docs: DataFrame) -> DataFrame:
    """(packet_id, doc_type, documents): documents that are ok, by type (``other`` without one), in upload order."""
    good = docs.where(F.coalesce("ok", F.lit(False))).withColumn("doc_type", F.coalesce("doc_type", F.lit("other")))
    return good.groupBy("packet_id", "doc_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "doc_id"))), lambda x: x["doc_id"]).alias("documents"))


def kind_of(name: Column) -> Column:
    """Whether a file name says edited or original; null if neither."""
    low = F.lower(name)
    return F.when(low.contains("edited"), "edited").when(low.contains("original") | low.contains("oridinal"), "original")


def method_of(detector: Column, category: Column) -> Column:
    d = F.coalesce(detector, F.lit(""))
    return F.when(d == "forgery_model", "model").when((category == "semantic") | d.startswith("qr"), "semantic").otherwise("pixel")


def localized(findings: DataFrame, key: str) -> DataFrame:
    """(key, localized): whether any finding has a region."""
    return findings.groupBy(key).agg(F.coalesce(F.bool_or(F.col("n_regions") > 0), F.lit(False)).alias("localized"))


def escalated(heuristic: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """(key, source): heuristics if they localise something, else the model if it does, else heuristics.

    Both are (key, localized); the first names every key.
    """
    m = model.select(key, F.col("localized").alias("by_model"))
    by_model = ~F.col("localized") & F.coalesce("by_model", F.lit(False))
    return heuristic.join(m, key, "left").select(key, F.when(by_model, "model").otherwise("heuristic").alias("source"))


def primary(findings: DataFrame, key: str, prefer: str) -> DataFrame:
    """One finding of each key: of the preferred method if there is one, then the most severe, with most regions, the first."""
    return one_per(findings, [key], (F.col("method") == prefer).desc(), by_severity(F.col("severity"), 0).desc(), F.desc("n_regions"), "seq")


def best_source(records: DataFrame, group: str, source: str, difficulty: str, preferred: tuple[str, ...] = ()) -> DataFrame:
    """(group, source): preferred prefixes first, in order, then most difficulties, then the source met first (least `place`)."""
    n = records.groupBy(group, source).agg(F.count_distinct(difficulty).alias("n"), F.min("place").alias("at"))
    rank = F.lit(len(preferred))
    for i, p in reversed(list(enumerate(preferred))):
        rank = F.when(F.startswith(F.col(source), F.lit(p)), i).otherwise(rank)
    return one_per(n, [group], rank, F.desc("n"), "at").select(group, source, "n")


def first_match(asked: DataFrame, records: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Each asked row's first record (least `place`) with its keys and source, else with its keys alone."""
    exact = one_per(records, [*keys, source], "place").select(*keys, source, F.col("record").alias("exact"))
    loose = one_per(records, keys, "place").select(*keys, F.col("record").alias("loose"))
    return asked.join(exact, [*keys, source], "left").join(loose, keys, "left").withColumn("record", F.coalesce("exact", "loose")).drop("exact", "loose")


def findings_to_files(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Each finding's file: the first of its packet's names that its location or description contains; findings without one go."""
    names = files.groupBy("packet_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "filename"))), lambda x: x["filename"]).alias("names"))  # a packet's files
    hay = F.concat_ws(" ", F.coalesce("location", F.lit("")), F.coalesce("description", F.lit("")))
    named = findings.join(names, "packet_id").withColumn("filename", F.try_element_at(F.filter("names", lambda n: F.contains(hay, n)), F.lit(1)))
    return named.where(F.col("filename").isNotNull()).drop("names")


def packet_view(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc, page, n_boxes, edited): regions on the page of a document's first finding only; edited with any box."""
    placed = findings.where("page IS NOT NULL")
    first = one_per(placed, ["doc"], "seq").select("doc", "page")
    boxes = placed.join(first, ["doc", "page"], "left_semi").groupBy("doc", "page").agg(F.sum("n").cast("int").alias("n_boxes"))
    return docs.join(boxes, "doc", "left").select("doc", "page", F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"), (F.coalesce("n_boxes", F.lit(0)) > 0).alias("edited"))


def patches(records: DataFrame, most: int = 2) -> DataFrame:
    """Training patches: up to `most` boxes of each tampered record, and max(2, 2 * positives // clean pages) of every clean one, in hash order (``place``)."""
    positive = records.where("label = 'tampered'").select("file", F.explode(F.slice("boxes", 1, most)).alias("box")).select("file", F.col("box").cast("string").alias("box"), F.lit("pos").alias("mode"))
    clean = records.where("label = 'clean'").select("file")
    n = positive.agg(F.count(F.lit(1)).alias("p")).crossJoin(clean.agg(F.count(F.lit(1)).alias("c")))  # two single rows
    per = n.select(F.greatest(F.lit(2), F.floor(2 * F.col("p") / F.greatest("c", F.lit(1)))).cast("int").alias("k"))
    negative = clean.crossJoin(F.broadcast(per)).select("file", F.explode(F.sequence(F.lit(1), "k")).alias("box"), F.lit("neg").alias("mode")).withColumn("box", F.col("box").cast("string")).select("file", "box", "mode")
    return positive.unionByName(negative).withColumn("draw", F.xxhash64("file", "mode", "box"))


def calibration(models: DataFrame, stored: DataFrame, threshold: float = 0.5, area: float = 256.0) -> DataFrame:
    """Each model's stored threshold and least area, or the defaults; a stored area below 1 is a share of a million pixels."""
    s = stored.select("model", F.col("threshold").alias("t"), F.col("area").alias("a"))
    a = F.coalesce(F.when(F.col("a") < 1, F.col("a") * 1_000_000).otherwise(F.col("a")), F.lit(area))
    return models.join(s, "model", "left").select("model", F.coalesce("t", F.lit(threshold)).alias("threshold"), a.alias("area"), F.col("t").isNotNull().alias("stored"))


def by_category(evidence: DataFrame) -> DataFrame:
    """(packet_id, category, n, titles): categories without findings have no row."""
    return evidence.groupBy("packet_id", "category").agg(F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "title"))), lambda x: x["title"]).alias("titles"))


def cluster_summary(apps: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: applications, hub threshold, clusters of each kind and their largest."""
    n = apps.agg(F.count_distinct("app_id").alias("n_apps"))
    kinds = clusters.agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("property", "employer")), F.coalesce(F.max("n_apps"), F.lit(0)).alias("largest"))
    threshold = F.greatest(F.lit(6), F.ceil(F.col("n_apps") * F.lit(0.33))).cast("long")
    return n.crossJoin(kinds).select("n_apps", threshold.alias("hub_threshold"), "n_property", "n_employer", "largest")  # two single rows


def in_order(clusters: DataFrame, size: str, *ties: str) -> DataFrame:
    """Clusters numbered from the largest."""
    return clusters.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc(size), *ties)))


def editable(fields: DataFrame) -> DataFrame:
    """Recorded fields that somebody could alter with gain: of a fitting kind, with a direction of fraud and a place on the page."""
    kinds = F.col("kind").isin("money", "pan", "aadhaar", "date", "text")
    return fields.where(kinds & (F.coalesce("fraud", F.lit("none")) != "none") & F.col("rect").isNotNull() & (F.col("name") != "_balance_column"))
