"""Evidence rows: rules that emit them, dedupe, order, risk channels and the decision."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vettra.functions import fixed
from vettra.functions.scalars import by_severity, floor_days, pct_diff
from vettra.operators.ordered import one_per

COLUMNS = ["packet_id", "doc_id", "category", "severity", "title", "location", "confidence"]


def sign(category: str, severity: Column, title: str, location: Column, confidence: float) -> Column:
    """A finding as a struct, null where its severity is."""
    fields = {"category": F.lit(category), "severity": severity, "title": F.lit(title), "location": location, "confidence": F.lit(confidence)}
    return F.when(severity.isNotNull(), F.struct(*(v.alias(k) for k, v in fields.items())))


def emitted(docs: DataFrame, signs: list[Column]) -> DataFrame:
    """Evidence of all signs in one pass over the documents, with the number of the sign (``part``)."""
    found = docs.select("packet_id", "doc_id", F.posexplode(F.array(*signs)).alias("part", "s")).where("s IS NOT NULL")
    return found.select("packet_id", "doc_id", "s.*", "part")


def income_sign(stated: Column, implied: Column) -> Column:
    """Stated against implied amount: medium above 20 %, high above 40 %."""
    d = pct_diff(stated, implied)
    return sign("semantic", F.when(d > 0.4, "high").when(d > 0.2, "medium"), "Income does not match bank credits", F.concat(F.lit("type "), "doc_type"), 0.90)


def income_mismatch(docs: DataFrame, stated: Column, implied: Column) -> DataFrame:
    return emitted(docs, [income_sign(stated, implied)]).drop("part")


def date_signs(created: Column, modified: Column, as_of: Column) -> list[Column]:
    """Late modification, impossible order, and creation after `as_of` by more than 30 days."""
    gap, ahead, place = floor_days(modified, created), floor_days(created, as_of), F.concat(F.lit("type "), "doc_type")
    return [
        sign("forensic", F.when(gap > 30, "medium"), "Modified long after creation", place, 0.80),
        sign("forensic", F.when(gap < 0, "high"), "Impossible date order", place, 0.98),
        sign("forensic", F.when(ahead > 30, "high"), "Created in the future", place, 0.98),
    ]


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL in category order, numbered within the packet (``seq``)."""
    both = reduce(DataFrame.unionByName, (p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)))
    return both.withColumn("seq", F.row_number().over(Window.partitionBy("packet_id").orderBy("__part", "doc_id"))).drop("__part")


def deduped(evidence: DataFrame) -> DataFrame:
    """The first row of each (category, title, location) of a packet."""
    return one_per(evidence, ["packet_id", "category", "title", "location"], "seq")


def ordered(evidence: DataFrame) -> DataFrame:
    """Places in the evidence chain: severity and confidence down, then as inserted."""
    w = Window.partitionBy("packet_id").orderBy(by_severity(F.col("severity"), 0).desc(), F.desc("confidence"), "seq")
    return evidence.withColumn("place", F.row_number().over(w))


def channels(evidence: DataFrame) -> DataFrame:
    """One row a packet: counts, risk of each channel, and the flags that decisions need."""
    penalty = by_severity(F.col("severity"), 1)
    risk = lambda c: F.least(F.lit(1.0), F.coalesce(F.sum(F.when(F.col("category") == c, penalty)), F.lit(0.0)) / 100)
    doc = F.col("category").isin("forensic", "semantic") | ((F.col("category") == "graph") & (F.col("severity") != "info"))
    return evidence.groupBy("packet_id").agg(
        F.count(F.lit(1)).alias("n_findings"),
        F.count_if(F.col("severity").isin("high", "critical")).alias("n_severe"),
        *(risk(c).alias(f"{c}_risk") for c in ("forensic", "semantic", "graph")),
        F.bool_or(F.col("severity") == "critical").alias("has_critical"),
        F.bool_or(doc).alias("has_evidence"),
    )


def by_digits(x: Column) -> Column:
    """x to one place, halves up by its decimal digits."""
    return F.round(x, 1)


def by_tenfold(x: Column) -> Column:
    """x to one place by its tenfold, as SQL rounds doubles: 30.049999999999997 is 30.1, as ten times it is 300.5."""
    return F.round(x * 10) / 10


def trust(risk: Column, critical: Column, rounded: Callable[[Column], Column] = by_digits) -> Column:
    t = F.when(critical, F.least(100 * (1 - risk), F.lit(fixed.CRITICAL_CEILING))).otherwise(100 * (1 - risk))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), rounded(t)))


def recommend(score: Column, evidence: Column, critical: Column) -> Column:
    return F.when(score >= fixed.APPROVE_AT, "approve").when((score < fixed.FREEZE_BELOW) & (evidence | critical), "freeze").otherwise("manual_review")


def decided(scored: DataFrame, model: Column, anomaly: Column, rounded: Callable[[Column], Column] = by_digits) -> DataFrame:
    """Blend of channels, graph overlay, ceiling and recommended action of each row of `channels`."""
    w = fixed.WEIGHTS
    blend = w["model"] * model + w["forensic"] * F.col("forensic_risk") + w["semantic"] * F.col("semantic_risk") + w["anomaly"] * anomaly
    out = scored.withColumn("risk", F.least(F.lit(1.0), blend + fixed.GRAPH_OVERLAY * F.col("graph_risk")))
    out = out.withColumn("trust", trust(F.col("risk"), F.col("has_critical"), rounded))
    return out.withColumn("action", recommend(F.col("trust"), F.col("has_evidence"), F.col("has_critical")))


def folded(decisions: DataFrame, penalty: Column, rounded: Callable[[Column], Column] = by_digits) -> DataFrame:
    """Verification penalties, capped, taken off the trust score; the action is derived again."""
    out = decisions.withColumn("penalty", F.round(F.least(F.lit(fixed.VERIFICATION_CAP), penalty), 1))
    t = F.greatest(F.lit(0.0), rounded(F.col("trust") - F.col("penalty")))
    out = out.withColumn("final_trust", F.when(F.col("has_critical"), F.least(t, F.lit(fixed.CRITICAL_CEILING))).otherwise(t))
    return out.withColumn("final_action", recommend(F.col("final_trust"), F.col("has_evidence") | (F.col("penalty") > 0), F.col("has_critical")))


def checked(evidence: DataFrame) -> DataFrame:
    """The same rows; the job fails on a confidence outside 0 to 1 or an unknown severity."""
    fine = F.col("confidence").between(0, 1) & F.col("severity").isin(*fixed.SEVERITIES)
    return evidence.where(F.assert_true(F.coalesce(fine, F.lit(False)), F.lit("confidence or severity out of range")).isNull())


def checked_decisions(decisions: DataFrame) -> DataFrame:
    """The same rows; the job fails on an empty chain or a score outside 0 to 100."""
    fine = (F.col("chain") > 0) & F.col("trust").between(0, 100)
    return decisions.where(F.assert_true(F.coalesce(fine, F.lit(False)), F.lit("empty chain or score out of range")).isNull())


def row_id(prefix: str, *key: Column | str) -> Column:
    """prefix_ and 12 hex digits of a hash of the natural key, so that a retried task gives the same id."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\u0001", *(F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("\u0002")) for k in key)), 256), 1, 12))


def public_entries(entities: Column) -> Column:
    """A map without the keys that begin with an underscore."""
    return F.map_filter(entities, lambda k, _: ~F.startswith(k, F.lit("_")))
