"""Packet drivers: model features, attributions, the model's evidence, the decision, and verification of a loan file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vettra.functions import fixed, scalars
from vettra.operators import evidence as ev
from vettra.operators import underwriting
from vettra.operators.ordered import one_per


def flag(titles: Column, words: tuple[str, ...]) -> Column:
    """1 if one of the titles holds one of the words, else 0."""
    return F.coalesce(F.max(F.when(F.greatest(*(F.lower(titles).contains(w) for w in words), F.lit(False)), 1).otherwise(0)), F.lit(0))


def feature_vector(packets: DataFrame, forensic: DataFrame, semantic: DataFrame, behaviour: DataFrame) -> DataFrame:
    """The model's features of every packet, in the order of fixed.FEATURES; packets without findings have zeros.

    Findings of the OCR cross-check (`check` = reocr) are evidence, but no feature.
    """
    kept = forensic.where(F.coalesce("check", F.lit("")) != "reocr")
    f = kept.groupBy("packet_id").agg(F.count(F.lit(1)).alias("n_forensic_total"), F.count_if(F.col("severity").isin("high", "critical")).alias("n_forensic_high_critical"), *(flag(F.col("title"), w).alias(n) for n, w in fixed.FORENSIC_FLAGS.items()))
    s = semantic.groupBy("packet_id").agg(F.count(F.lit(1)).alias("n_semantic_total"), *(flag(F.col("title"), w).alias(n) for n, w in fixed.SEMANTIC_FLAGS.items()))
    b = behaviour.select(
        "packet_id", F.col("velocity_hours").alias("submit_velocity_hours"), F.col("gap_days").alias("max_doc_gap_days"), F.col("same_minute").cast("int").alias("all_docs_same_timestamp"),
        F.col("all_before").cast("int").alias("creation_before_submission"), "doc_count",
    )
    both = packets.select("packet_id").distinct().join(f, "packet_id", "left").join(s, "packet_id", "left").join(b, "packet_id", "left")
    return both.select("packet_id", *(F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in fixed.FEATURES))


def attributions(features: DataFrame, clean: Column, importance: dict[str, float], least: float = 0.01, most: int = 4) -> DataFrame:
    """(packet_id, rank, feature, share): importance times distance from the clean mean, in clean standard deviations, as shares of one.

    Features that are constant among clean packets keep their unit. Shares up to `least` are left out, and `most` of a packet stay.
    """
    stats = features.where(clean).agg(*(x for n in importance for x in (F.avg(n).alias(f"m_{n}"), F.nullif(F.stddev_pop(n), F.lit(0.0)).alias(f"s_{n}"))))
    weight = lambda n: F.lit(w) * F.abs(F.coalesce((F.col(n) - F.col(f"m_{n}")) / F.coalesce(f"s_{n}", F.lit(1.0)), F.lit(0.0))) if (w := importance[n]) else F.lit(0.0)
    parts = F.array(*(F.struct(weight(n).alias("w"), F.lit(i).alias("i"), F.lit(n).alias("feature")) for i, n in enumerate(importance)))
    one = features.crossJoin(F.broadcast(stats)).select("packet_id", parts.alias("parts"))  # stats is one row
    total = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["w"])
    shares = one.select("packet_id", total.alias("total"), F.explode("parts").alias("p")).select("packet_id", F.col("p.i").alias("i"), F.col("p.feature").alias("feature"), F.try_divide("p.w", "total").alias("share"))
    order = Window.partitionBy("packet_id").orderBy(F.desc("share"), "i")
    return shares.where(F.col("share") > least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("packet_id", "rank", "feature", "share")


def model_evidence(scores: DataFrame, factors: DataFrame | None = None, shown: DataFrame | None = None) -> DataFrame:
    """One anomaly finding for each packet of (packet_id, probability, anomaly), always there: severity, text, confidence and values.

    factors: (packet_id, rank, feature), the leading ones, by fixed.FEATURES' names in the text. shown: (packet_id, has_doc_evidence);
    a high probability without factors or evidence points to the graph.
    """
    labels = F.create_map(*(F.lit(x) for kv in fixed.FEATURES.items() for x in kv))
    rows = scores.withColumn("has_doc_evidence", F.lit(False)) if shown is None else scores.join(shown, "packet_id", "left")
    if factors is None:
        named = rows.withColumn("named", F.array().cast("array<string>"))
    else:
        lists = factors.groupBy("packet_id").agg(F.array_sort(F.collect_list(F.struct("rank", "feature"))).alias("l"))  # a few of each packet
        named = rows.join(lists, "packet_id", "left").withColumn("named", F.transform(F.coalesce("l", F.array().cast("array<struct<rank: int, feature: string>>")), lambda x: F.coalesce(F.try_element_at(labels, x["feature"]), x["feature"])))
    p = F.col("probability")
    tail = (
        F.when(F.size("named") > 0, F.concat(F.lit(", mostly by "), F.array_join("named", "; ")))
        .when((p >= 0.5) & ~F.coalesce("has_doc_evidence", F.lit(False)), ", though no document or rule shows anything; see the linked applications")
        .otherwise("")
    )
    text = F.concat(F.round(p * 100).cast("int").cast("string"), F.lit("% fraud probability by the risk model"), tail, F.lit("."))
    return named.select(
        "packet_id", F.lit("anomaly").alias("category"), scalars.model_severity(p).alias("severity"), F.lit("Learned risk model assessment").alias("title"), F.lit("risk model").alias("location"),
        F.round(F.greatest(p, 1 - p), 3).alias("confidence"), text.alias("description"), F.struct(F.round("probability", 4).alias("fraud_probability"), F.round("anomaly", 4).alias("anomaly_score")).alias("values"),
    )


def packet_decision(packets: DataFrame, evidence: DataFrame, scores: DataFrame) -> DataFrame:
    """The decision of every packet from its evidence rows and the model's (packet_id, probability, anomaly).

    Risk counts findings before they are deduplicated; the chain's length counts them after, with the model's own finding.
    """
    channels = ev.channels(evidence)
    chain = ev.deduped(evidence).groupBy("packet_id").agg(F.count(F.lit(1)).alias("chain"))
    numbers, flags = ["n_findings", "n_severe", "forensic_risk", "semantic_risk", "graph_risk"], ["has_critical", "has_evidence"]
    every = packets.select("packet_id").distinct().join(channels, "packet_id", "left").join(chain, "packet_id", "left").join(scores, "packet_id", "left")
    every = every.fillna(0, [*numbers, "chain", "probability", "anomaly"]).fillna(False, flags)
    out = ev.decided(every, F.col("probability"), F.col("anomaly"))
    part = lambda c: F.round(100 * (1 - F.col(c)), 1)
    return out.select(
        "packet_id", *numbers, *flags, "probability", "anomaly", "risk", "trust", "action", (F.col("chain") + 1).alias("chain"),
        part("forensic_risk").alias("forensic_subscore"), part("semantic_risk").alias("semantic_subscore"), part("probability").alias("anomaly_subscore"),
    )


def model_only(scores: DataFrame) -> DataFrame:
    """The model's two scores as it rounds them, with the severity that they imply."""
    return scores.select("packet_id", F.round("probability", 4).alias("fraud_probability"), F.round("anomaly", 4).alias("anomaly_score"), scalars.model_severity(F.col("probability")).alias("severity"))


def verification(packets: DataFrame, docs: DataFrame, purpose: str, tenure: int = fixed.TENURE_MONTHS) -> DataFrame:
    """The verification block of every packet: completeness, identity, income and eligibility, with the capped penalty.

    packets: (packet_id, loan_amount). docs: (packet_id, ordinal, ok, slot, name, pan, aadhaar_valid, net_monthly, monthly_credit,
    implied_annual, gross_income, valuation_amount, consideration); only those that are ok count. Amounts of zero count as missing.
    Eligibility adds no penalty.
    """
    good = docs.where(F.coalesce("ok", F.lit(False))).withColumn("slot", F.coalesce("slot", F.lit("other")))
    required, optional = fixed.PROFILES[purpose]
    wanted = lambda slots: F.array(*map(F.lit, slots)).cast("array<string>")
    first = one_per(good, ["packet_id", "slot"], "ordinal")
    # the last name of a type, as later documents overwrite
    names = one_per(good.withColumn("norm", scalars.norm_name(F.col("name"))).where("norm IS NOT NULL"), ["packet_id", "slot"], F.desc("ordinal")).groupBy("packet_id").agg(F.array_sort(F.collect_set("norm")).alias("names"))
    valid = (F.col("slot") == "pan") & F.coalesce(scalars.validate_pan(F.col("pan"))["valid"], F.lit(False)) | (F.col("slot") == "aadhaar") & F.coalesce("aadhaar_valid", F.lit(False))
    seen = good.groupBy("packet_id").agg(F.collect_set("slot").alias("slots"), F.bool_or(valid).alias("identity"), F.bool_or(F.col("slot").isin("aadhaar", "address_proof")).alias("address"))
    of = lambda slot, c: F.nullif(F.first(F.when(F.col("slot") == slot, F.col(c)), ignorenulls=True), F.lit(0.0))
    money = first.groupBy("packet_id").agg(
        of("salary_slip", "net_monthly").alias("net"), of("bank_statement", "monthly_credit").alias("credit"), of("bank_statement", "implied_annual").alias("bank"), of("form16", "gross_income").alias("gross"),
        F.coalesce(of("property_valuation", "valuation_amount"), of("sale_deed", "consideration")).alias("collateral"),
    )
    p = packets.select("packet_id", F.nullif("loan_amount", F.lit(0.0)).alias("loan_amount")).join(seen, "packet_id", "left").join(names, "packet_id", "left").join(money, "packet_id", "left")
    present = F.coalesce("slots", wanted([]))
    identity, address = F.coalesce("identity", F.lit(False)), F.coalesce("address", F.lit(False))
    agree = F.size(F.coalesce("names", wanted([]))) <= 1
    slip = F.col("net") * 12
    gap, share = F.abs(slip - F.col("bank")) / F.greatest(slip, F.col("bank")), F.col("bank") / F.col("gross")
    income = F.filter(F.array(F.when(gap > 0.15, "medium"), F.when(share > 1.05, "medium").when(share < 0.55, "low")), lambda x: x.isNotNull())
    missing = F.filter(wanted(required), lambda s: ~F.array_contains(present, s))
    out = p.withColumns({
        "missing": missing, "optional": F.filter(wanted(optional), lambda s: F.array_contains(present, s)), "identity": identity, "address": address, "name_consistent": agree, "income_findings": income,
        "net_monthly": F.coalesce("net", "credit", F.col("gross") * 0.7 / 12.0),
    })
    severities = F.concat(F.transform("missing", lambda _: F.lit("low")), F.filter(F.array(F.when(~F.col("identity"), "medium"), F.when(~F.col("address"), "low"), F.when(~F.col("name_consistent"), "medium")), lambda x: x.isNotNull()), F.col("income_findings"))
    points = F.aggregate(severities, F.lit(0.0), lambda a, s: a + scalars.by_severity(s, 1))
    out = underwriting.affordability(out, F.col("loan_amount"), F.col("net_monthly"), F.lit(tenure))
    ltv = F.round(F.try_divide("loan_amount", "collateral"), 3)
    verdict = F.when(F.col("net_monthly").isNull() | (F.col("net_monthly") <= 0), None).when(F.col("loan_amount").isNull(), "INFO").when((F.col("verdict") != "DECLINE") & F.coalesce(ltv <= fixed.LTV_CAP, F.lit(True)), F.col("verdict")).otherwise("DECLINE")
    have = F.coalesce("gross", "bank", "net").isNotNull()
    return out.select(
        "packet_id", (F.size("missing") == 0).alias("complete"), "missing", "optional", F.col("identity").alias("identity_established"), F.col("address").alias("address_established"), "name_consistent",
        F.when(F.col("identity") & F.col("address") & F.col("name_consistent"), "ESTABLISHED").otherwise("INCOMPLETE").alias("kyc"), (have & (F.size("income_findings") == 0)).alias("reconciled"),
        F.size(severities).alias("n_findings"), F.round(F.least(F.lit(fixed.VERIFICATION_CAP), points), 1).alias("penalty"), verdict.alias("eligibility"),
        F.when(verdict.isNotNull(), F.round("foir", 3)).alias("foir"), F.when(verdict.isNotNull(), ltv).alias("ltv"), F.when(verdict.isNotNull(), F.round("max_eligible")).alias("max_eligible"),
    )
