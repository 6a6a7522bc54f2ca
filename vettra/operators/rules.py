"""Cross-document rules: one row a packet with what its documents say, and the findings of all rules in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettra.functions import fixed
from vettra.functions.scalars import pct_diff

#: Document types whose property ids are compared, in order of precedence.
PROPERTY_TYPES = ("sale_deed", "encumbrance_certificate", "property_valuation", "legal_opinion")
FINDING = "struct<rule: string, severity: string, title: string, location: string, confidence: double, detail: double>"


def by_packet(entities: DataFrame) -> DataFrame:
    """One row a packet from one row for each packet and type (packet_id, position, doc_type and fields).

    A packet has a document of each type at most, so the arrays are bounded.
    """
    of = lambda t, c: F.first(F.when(F.col("doc_type") == t, F.col(c)), ignorenulls=True)
    carried = lambda place, c: F.sort_array(F.collect_list(F.when(F.nullif(F.trim(c), F.lit("")).isNotNull(), F.struct(place.alias("place"), "doc_type", F.trim(c).alias("value")))))
    order = F.array_position(F.array(*map(F.lit, PROPERTY_TYPES)), F.col("doc_type")).cast("int")
    return entities.groupBy("packet_id").agg(
        carried(F.col("position"), F.col("name")).alias("names"), carried(F.col("position"), F.col("pan")).alias("pans"),
        F.filter(carried(order, F.col("property_id")), lambda x: x["place"] > 0).alias("properties"),
        of("form16", "gross_income").alias("gross_income"), of("bank_statement", "implied_annual").alias("implied_annual"), of("salary_slip", "net_monthly").alias("net_monthly"),
        of("sale_deed", "owner_name").alias("deed_owner"), of("identity", "name").alias("identity_name"),
        of("property_valuation", "valuation_amount").alias("valuation_amount"), of("property_valuation", "property_id").alias("valued_property"), of("encumbrance_certificate", "claims_nil").alias("claims_nil"),
        F.coalesce(*(F.nullif(of(t, "property_id"), F.lit("")) for t in PROPERTY_TYPES[:3])).alias("collateral"),
    )


def with_registries(packets: DataFrame, market: DataFrame, charges: DataFrame) -> DataFrame:
    """Adds market_value (by the valued property) and n_charges (of the applicant on the collateral, whatever their status).

    market: (property_id, market_value). charges: (pan, property_id), one row a charge.
    """
    per = charges.groupBy(F.col("pan").alias("applicant_pan"), F.col("property_id").alias("collateral")).agg(F.count(F.lit(1)).alias("n_charges"))
    known = market.select(F.col("property_id").alias("valued_property"), "market_value")
    return packets.join(known, "valued_property", "left").join(per, ["applicant_pan", "collateral"], "left")


def finding(rule: str, severity: Column, location: Column | str, detail: Column | None = None) -> Column:
    """The finding as a struct, null where severity is."""
    title, confidence = fixed.RULES[rule]
    place = F.lit(location) if isinstance(location, str) else location
    value = F.lit(None).cast("double") if detail is None else detail.cast("double")
    return F.when(severity.isNotNull(), F.struct(F.lit(rule).alias("rule"), severity.alias("severity"), F.lit(title).alias("title"), place.alias("location"), F.lit(confidence).alias("confidence"), value.alias("detail")))


def against_reference(rule: str, severity: str, carried: Column, same) -> Column:
    """A finding for each value that differs from the first one."""
    later = F.slice(carried, 2, F.greatest(F.size(carried) - 1, F.lit(0)))
    return F.transform(later, lambda x: finding(rule, F.when(~same(x["value"], carried[0]["value"]), F.lit(severity)), F.concat(carried[0]["doc_type"], F.lit(" vs "), x["doc_type"])))


def findings(packets: DataFrame) -> DataFrame:
    """(packet_id, seq, rule, severity, title, location, confidence, detail): what all rules find, in order of evaluation.

    packets: rows of by_packet and with_registries, with loan_amount and applicant_pan.
    """
    c = F.col
    bank, slip = pct_diff(c("gross_income"), c("implied_annual")), pct_diff(c("gross_income"), c("net_monthly") * 12)
    income = lambda d: F.when(d > fixed.INCOME_SEVERE, "high").when(d > fixed.INCOME_TOLERANCE, "medium")
    low = lambda x: F.lower(F.trim(x))
    said = lambda x: F.nullif(x, F.lit("")).isNotNull()
    ltv, claimed = F.try_divide(c("loan_amount"), c("valuation_amount")), F.nullif(c("valuation_amount"), F.lit(0.0))
    inflation = F.try_divide(claimed - c("market_value"), c("market_value"))
    over = F.try_divide(F.nullif(c("loan_amount"), F.lit(0.0)), c("market_value"))
    single = lambda *x: F.array(*x).cast(f"array<{FINDING}>")
    parts = F.concat(
        single(finding("income_bank", income(bank), "form16.pdf vs bank_statement.pdf", F.round(bank * 100, 1)), finding("income_slip", income(slip), "form16.pdf vs salary_slip.pdf", F.round(slip * 100, 1))),
        against_reference("name", "high", c("names"), lambda a, b: F.lower(a) == F.lower(b)).cast(f"array<{FINDING}>"),
        against_reference("pan", "critical", c("pans"), lambda a, b: a == b).cast(f"array<{FINDING}>"),
        single(finding("owner", F.when(said(c("deed_owner")) & said(c("identity_name")) & (low(c("deed_owner")) != low(c("identity_name"))), "critical"), "sale_deed.pdf vs identity.pdf")),
        against_reference("property", "high", c("properties"), lambda a, b: a == b).cast(f"array<{FINDING}>"),
        single(
            finding("ltv", F.when(ltv > 1.0, "critical").when(ltv > fixed.LTV_FLAG, "high"), "property_valuation.pdf", F.round(ltv, 3)),
            finding("valuation", F.when(claimed > c("market_value") * (1 + fixed.INFLATION_FLAG), F.when(inflation > fixed.INFLATION_SEVERE, "critical").otherwise("high")), "property_valuation.pdf vs property_registry", F.round(inflation * 100, 1)),
            finding("loan", F.when(claimed.isNotNull() & (over > 1.0), "critical"), "property_valuation.pdf vs property_registry", F.round(over, 3)),
            finding("encumbrance", F.when(c("claims_nil") & (c("n_charges") > 0), "critical"), "encumbrance_certificate.pdf vs CERSAI registry", c("n_charges")),
        ),
    )
    return packets.select("packet_id", F.posexplode(F.array_compact(parts)).alias("seq", "f")).select("packet_id", F.col("seq") + 1, "f.*").withColumnRenamed("(seq + 1)", "seq")
