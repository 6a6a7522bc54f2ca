"""Queries over evidence, scoring, windows, linkage and underwriting."""

from __future__ import annotations

from pyspark.sql import functions as F

from vettra.functions import fixed, scalars
from vettra.operators import evidence as ev
from vettra.operators import linkage, ordered, underwriting
from vettra.plans import view
from vettra.sources.tables import charges_on, table, verify

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


ACTION = "CASE WHEN {t} >= 70 THEN 'approve' WHEN {t} < 40 AND ({e}) THEN 'freeze' ELSE 'manual_review' END"


@query(view.sql(*view.EVIDENCE, "ranked", "channels") + """,
semantic AS (SELECT packet_id, count(*) AS n_findings, round(least(1.0, sum(pts) / 100) * 0.15, 6) AS risk FROM ranked WHERE category = 'semantic' GROUP BY packet_id),
scored AS (SELECT *, round(100 * (1 - risk), 1) AS trust FROM semantic)
SELECT packet_id, n_findings, risk, trust, CASE WHEN trust >= 70 THEN 'approve' WHEN trust < 40 THEN 'freeze' ELSE 'manual_review' END AS action FROM scored""")
def income_mismatch_action(spark, sf):
    f = view.facts(spark, sf)
    found = ev.channels(ev.income_mismatch(f, F.col("declared"), F.col("implied")))
    out = ev.decided(found, F.lit(0.0), F.lit(0.0), ev.by_tenfold)
    return out.select("packet_id", "n_findings", F.round("risk", 6).alias("risk"), "trust", "action")


@query(view.sql(*view.EVIDENCE) + """
SELECT packet_id, doc_id, severity, confidence, row_number() OVER (PARTITION BY packet_id ORDER BY CASE severity WHEN 'high' THEN 3 ELSE 2 END DESC, confidence DESC, seq) AS place
FROM evidence WHERE category = 'semantic'""")
def income_mismatch_evidence(spark, sf):
    f = view.facts(spark, sf)
    out = ev.ordered(ev.concatenated([ev.income_mismatch(f, F.col("declared"), F.col("implied"))]))
    return out.select("packet_id", "doc_id", "severity", "confidence", "place")


@query(view.sql("docs") + """
SELECT packet_id, doc_id, status, reference FROM (SELECT *, first_value(status IGNORE NULLS) OVER (PARTITION BY packet_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS reference FROM docs)
WHERE status <> reference""")
def first_ref_consistency(spark, sf):
    return ordered.against_first(view.docs(spark, sf), "status").select("packet_id", "doc_id", "status", "reference")


@query(view.sql("docs") + """
SELECT packet_id, doc_type, doc_id, position FROM (SELECT *, min(ordinal) OVER (PARTITION BY packet_id, doc_type) AS position,
  row_number() OVER (PARTITION BY packet_id, doc_type ORDER BY ordinal DESC) AS rn FROM docs) WHERE rn = 1""")
def last_doc_per_type(spark, sf):
    return ordered.last_per_type(view.docs(spark, sf)).select("packet_id", "doc_type", "doc_id", "position")


@query(view.sql("docs") + """
SELECT packet_id, doc_type, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY packet_id, doc_type ORDER BY ordinal) AS rn FROM docs) WHERE rn = 1""")
def first_doc_per_slot(spark, sf):
    return ordered.one_per(view.docs(spark, sf), ["packet_id", "doc_type"], "ordinal").select("packet_id", "doc_type", "doc_id")


@query(view.sql("docs") + """
SELECT packet_id, arg_min(doc_type, ordinal) FILTER (status = 'F') AS first_final, arg_min(declared, ordinal) FILTER (status = 'O') AS first_open,
  coalesce(arg_min(declared, ordinal) FILTER (status = 'P'), arg_min(declared, ordinal) FILTER (status = 'O'), 0.7 * min(declared) / 12) AS resolved FROM docs GROUP BY packet_id""")
def first_nonnull_resolution(spark, sf):
    when = lambda s, c: F.when(F.col("status") == s, F.col(c))
    d = view.docs(spark, sf)
    first = ordered.first_values(d, first_final=when("F", "doc_type"), first_open=when("O", "declared"), first_partial=when("P", "declared"))
    least = d.groupBy("packet_id").agg(F.min("declared").alias("least"))
    return first.join(least, "packet_id").select("packet_id", "first_final", "first_open", F.coalesce("first_partial", "first_open", 0.7 * F.col("least") / 12).alias("resolved"))


@query("""SELECT o_orderkey AS doc_id, round(o_totalprice / nullif(greatest(c_acctbal, 0) * 20, 0), 3) AS ltv,
  CASE WHEN o_totalprice / nullif(greatest(c_acctbal, 0) * 20, 0) > 1.0 THEN 'critical' WHEN o_totalprice / nullif(greatest(c_acctbal, 0) * 20, 0) > 0.9 THEN 'high' END AS severity
FROM orders JOIN customer ON c_custkey = o_custkey""")
def ltv_bands(spark, sf):
    pairs = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    ratio = F.try_divide(F.col("o_totalprice"), F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 20)
    return pairs.select(F.col("o_orderkey").alias("doc_id"), F.round(ratio, 3).alias("ltv"), F.when(ratio > 1.0, "critical").when(ratio > 0.9, "high").alias("severity"))


@query("""SELECT l_orderkey AS doc_id, l_linenumber AS line, CASE WHEN claimed > m * 1.4 THEN 'critical' WHEN claimed > m * 1.2 THEN 'high' ELSE 'none' END AS severity, m IS NOT NULL AS found
FROM (SELECT *, l_extendedprice / l_quantity AS claimed FROM lineitem) l LEFT JOIN (SELECT p_partkey, p_retailprice AS m FROM part WHERE p_size > 5) p ON p_partkey = l_partkey""")
def registry_left_join(spark, sf):
    market = table(spark, sf, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("m"), F.lit("active").alias("status"))
    lines = verify(table(spark, sf, "lineitem").withColumn("claimed", F.col("l_extendedprice") / F.col("l_quantity")), market, "l_partkey")
    severity = F.when(F.col("claimed") > F.col("m") * 1.4, "critical").when(F.col("claimed") > F.col("m") * 1.2, "high").otherwise("none")
    return lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), severity.alias("severity"), "found")


@query("""SELECT l_suppkey AS pan, l_orderkey AS charge_doc, l_extendedprice AS amount FROM lineitem WHERE l_partkey = 7""")
def unnest_charges(spark, sf):
    """Charges on one property: suppliers' charges come as arrays, one for each supplier and order, and are filtered before they are unnested."""
    charge = F.struct(F.col("l_partkey").alias("property_id"), F.col("l_orderkey").alias("charge_doc"), F.col("l_extendedprice").alias("amount"))
    lines = table(spark, sf, "lineitem")
    wanted = lines.where("l_partkey = 7").select("l_suppkey", "l_orderkey").distinct()  # the registry is asked for the records that hold the property
    registry = lines.join(wanted, ["l_suppkey", "l_orderkey"], "left_semi").groupBy(F.col("l_suppkey").alias("pan"), "l_orderkey").agg(F.collect_list(charge).alias("charges"))
    return charges_on(registry, "pan", "charges", F.lit(7)).select("pan", "charge_doc", "amount")


REQUIRED = """kinds AS (SELECT DISTINCT event_type FROM events), have AS (SELECT DISTINCT user_id, event_type FROM events WHERE value >= 60),
wanted AS (SELECT DISTINCT user_id, k.event_type FROM events, kinds k)"""
#: Every event counts for what is there, and those that are ok for what is missing.
PRESENT = REQUIRED.replace(" WHERE value >= 60", "")


def _slots(spark, sf, ok="value >= 60"):
    have = table(spark, sf, "events").where(ok).select("user_id", "event_type").distinct()
    kinds = table(spark, sf, "events").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))  # a handful of slots
    users = table(spark, sf, "events").select("user_id").distinct()
    return users.withColumn("event_type", F.explode(kinds.scalar())), have


@query(f"WITH {REQUIRED} SELECT w.user_id, w.event_type FROM wanted w ANTI JOIN have h ON h.user_id = w.user_id AND h.event_type = w.event_type")
def completeness_anti(spark, sf):
    wanted, have = _slots(spark, sf)
    return wanted.join(have, ["user_id", "event_type"], "left_anti")


@query(f"WITH {PRESENT} SELECT w.user_id, w.event_type FROM wanted w SEMI JOIN have h ON h.user_id = w.user_id AND h.event_type = w.event_type")
def completeness_semi(spark, sf):
    wanted, have = _slots(spark, sf, "true")
    return wanted.join(have, ["user_id", "event_type"], "left_semi")


@query(view.sql("docs", "implied") + """,
j AS (SELECT docs.*, submitted FROM docs LEFT JOIN implied USING (doc_id))
SELECT packet_id, round(coalesce(greatest(0, (epoch_us(min(submitted)) - epoch_us(max(created))) / 3600000000), 0), 4) AS velocity_hours,
  CASE WHEN count(created) >= 2 THEN floor((epoch_us(max(created)) - epoch_us(min(created))) / 86400000000) ELSE 0 END::BIGINT AS gap_days,
  count(created) >= 2 AND count(DISTINCT date_trunc('minute', created)) = 1 AS same_minute,
  coalesce(bool_and(created <= submitted), true) AS all_before, count(*) AS doc_count FROM j GROUP BY packet_id""")
def behaviour_features(spark, sf):
    j = view.docs(spark, sf).join(view.implied(spark, sf), "doc_id", "left")
    return underwriting.behaviour(j).select("packet_id", F.round("velocity_hours", 4).alias("velocity_hours"), "gap_days", "same_minute", "all_before", "doc_count")


@query(view.sql(*view.EVIDENCE) + " SELECT packet_id, doc_id, severity, title, confidence FROM evidence WHERE category = 'forensic'")
def date_order_findings(spark, sf):
    return view.evidence(spark, sf).where("category = 'forensic'").select("packet_id", "doc_id", "severity", "title", "confidence")


@query(view.sql(*view.EVIDENCE, "ranked", "channels") + """
SELECT packet_id, n_findings, n_severe, round(forensic_risk, 6) AS forensic_risk, round(semantic_risk, 6) AS semantic_risk, round(graph_risk, 6) AS graph_risk, has_critical, has_evidence FROM channels""")
def channel_risk_pivot(spark, sf):
    c = ev.channels(view.evidence(spark, sf))
    return c.select("packet_id", "n_findings", "n_severe", *(F.round(f"{x}_risk", 6).alias(f"{x}_risk") for x in ("forensic", "semantic", "graph")), "has_critical", "has_evidence")


DEDUPED = "deduped AS (SELECT * FROM evidence QUALIFY row_number() OVER (PARTITION BY packet_id, category, title, location ORDER BY seq) = 1)"
SEV = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query(view.sql(*view.EVIDENCE) + f", {DEDUPED} SELECT packet_id, category, title, location, seq FROM deduped")
def dedupe_chain(spark, sf):
    return ev.deduped(view.evidence(spark, sf)).select("packet_id", "category", "title", "location", "seq")


@query(view.sql(*view.EVIDENCE) + f""", {DEDUPED}
SELECT packet_id, title, severity, doc_id, row_number() OVER (PARTITION BY packet_id ORDER BY {SEV} DESC, confidence DESC, seq) AS place FROM deduped""")
def ordered_chain(spark, sf):
    return ev.ordered(ev.deduped(view.evidence(spark, sf))).select("packet_id", "title", "severity", "doc_id", "place")


@query(view.sql(*view.EVIDENCE) + f"""
SELECT packet_id, doc_id, title, (row_number() OVER (PARTITION BY packet_id ORDER BY {SEV} DESC, seq))::INTEGER AS rank FROM evidence
QUALIFY row_number() OVER (PARTITION BY packet_id ORDER BY {SEV} DESC, seq) <= 2""")
def top_k_evidence(spark, sf):
    return ordered.top_n(view.evidence(spark, sf), ["packet_id"], 2, scalars.by_severity(F.col("severity"), 0).desc(), "seq").select("packet_id", "doc_id", "title", "rank")


BLENDED = f"""blended AS (SELECT *, least(1.0, 0.55 * model + 0.25 * forensic_risk + 0.15 * semantic_risk + 0.05 * 0.5 + 0.5 * graph_risk) AS risk
  FROM (SELECT *, (packet_id % 10) / 10.0::DOUBLE AS model FROM channels)),
trusted AS (SELECT *, greatest(0.0, least(100.0, round(CASE WHEN has_critical THEN least(100 * (1 - risk), 25.0) ELSE 100 * (1 - risk) END, 1))) AS trust FROM blended),
decided AS (SELECT *, {ACTION.format(t='trust', e='has_evidence OR has_critical')} AS action FROM trusted)"""


def _decided(spark, sf):
    model = (F.col("packet_id") % 10) / F.lit(10.0)
    return ev.decided(ev.channels(view.evidence(spark, sf)), model, F.lit(0.5), ev.by_tenfold)


@query(view.sql(*view.EVIDENCE, "ranked", "channels") + f", {BLENDED} SELECT packet_id, round(risk, 6) AS risk, trust, action FROM decided")
def blended_decision(spark, sf):
    return _decided(spark, sf).select("packet_id", F.round("risk", 6).alias("risk"), "trust", "action")


@query(view.sql(*view.EVIDENCE, "ranked", "channels") + f""", {BLENDED},
folded AS (SELECT *, round(least(25.0, 6.0 * (packet_id % 6)), 1) AS penalty FROM decided),
final AS (SELECT *, CASE WHEN has_critical THEN least(greatest(0.0, round(trust - penalty, 1)), 25.0) ELSE greatest(0.0, round(trust - penalty, 1)) END AS final_trust FROM folded)
SELECT packet_id, penalty, final_trust, {ACTION.format(t='final_trust', e='has_evidence OR has_critical OR penalty > 0')} AS final_action FROM final""")
def fold_verification(spark, sf):
    return ev.folded(_decided(spark, sf), 6.0 * (F.col("packet_id") % 6), ev.by_tenfold).select("packet_id", "penalty", "final_trust", "final_action")


@query(view.sql("edges", "degrees") + " SELECT kind, value, n_apps, is_hub FROM degrees")
def attr_degree_hubs(spark, sf):
    return linkage.degrees(view.stored_edges(spark, sf))


CLUSTERS = """, pans AS (SELECT app_id, value AS pan FROM edges WHERE kind = 'pan'),
clusters AS (SELECT links.kind, links.value, count(DISTINCT links.app_id) AS n_apps, count(DISTINCT pan) AS n_applicants FROM links LEFT JOIN pans USING (app_id)
  GROUP BY links.kind, links.value HAVING count(DISTINCT links.app_id) >= 2 AND count(DISTINCT pan) >= 2)"""
TEMPLATES = """, shared AS (SELECT links.value, t.value AS template, count(DISTINCT links.app_id) AS n FROM links JOIN edges t ON t.app_id = links.app_id AND t.kind = 'template'
  WHERE links.kind = 'employer' GROUP BY ALL HAVING count(DISTINCT links.app_id) >= 2),
rings AS (SELECT value, count(*) AS n_templates FROM shared GROUP BY value)"""


@query(view.sql("edges", "degrees") + CLUSTERS + " SELECT value, n_apps, n_applicants FROM clusters WHERE kind = 'property'")
def collateral_clusters(spark, sf):
    return linkage.clusters(view.stored_edges(spark, sf), "property")


@query(view.sql("edges", "degrees") + CLUSTERS + TEMPLATES + " SELECT value, n_apps, n_applicants, coalesce(n_templates, 0) > 0 AS shared_template FROM clusters LEFT JOIN rings USING (value) WHERE kind = 'employer'")
def employer_rings(spark, sf):
    e = view.stored_edges(spark, sf)
    return linkage.clusters(e, "employer").join(linkage.shared_templates(e, "employer"), "value", "left").select("value", "n_apps", "n_applicants", (F.coalesce("n_templates", F.lit(0)) > 0).alias("shared_template"))


@query(view.sql("edges", "degrees") + CLUSTERS + """
SELECT links.app_id, clusters.kind, clusters.value, CASE WHEN n_applicants >= 3 THEN 'critical' WHEN clusters.kind = 'property' THEN 'medium' ELSE 'high' END AS severity
FROM clusters JOIN links USING (kind, value) WHERE clusters.kind IN ('property', 'employer')""")
def graph_evidence(spark, sf):
    e = view.stored_edges(spark, sf)
    found = [linkage.clusters(e, k).withColumn("kind", F.lit(k)) for k in ("property", "employer")]
    both = found[0].unionByName(found[1]).join(linkage.linking(e), ["kind", "value"])
    severity = F.when(F.col("n_applicants") >= 3, "critical").when(F.col("kind") == "property", "medium").otherwise("high")
    return both.select("app_id", "kind", "value", severity.alias("severity"))


@query(view.sql("edges") + " SELECT value AS pan, count(DISTINCT app_id) AS n_apps, 'info' AS severity FROM edges WHERE kind = 'pan' GROUP BY value HAVING count(DISTINCT app_id) >= 2")
def repeat_applicant(spark, sf):
    return linkage.repeat_applicants(view.edges(spark, sf)).withColumn("severity", F.lit("info"))


SUB = """, own AS (SELECT DISTINCT kind, value FROM links WHERE app_id = 1), apps AS (SELECT DISTINCT app_id FROM links JOIN own USING (kind, value)),
nodes AS (SELECT kind, value AS label, 1 AS distance FROM own UNION ALL SELECT 'app', app_id::VARCHAR, CASE WHEN app_id = 1 THEN 0 ELSE 2 END FROM apps),
kept AS (SELECT * FROM nodes ORDER BY distance, kind, label LIMIT 30)"""


@query(view.sql("edges", "degrees") + SUB + " SELECT kind, label, distance FROM kept")
def subgraph_nodes(spark, sf):
    return linkage.neighbourhood(view.stored_edges(spark, sf), 1)[0]


@query(view.sql("edges", "degrees") + SUB + " SELECT DISTINCT app_id, links.kind, links.value FROM links JOIN kept a ON a.kind = 'app' AND a.label = app_id::VARCHAR JOIN kept b ON b.kind = links.kind AND b.label = links.value")
def subgraph_edges(spark, sf):
    return linkage.neighbourhood(view.stored_edges(spark, sf), 1)[1]


@query(view.sql("edges") + " SELECT kind, count(*) AS n_edges, count(DISTINCT app_id) AS n_apps FROM edges GROUP BY kind")
def graph_upsert_idempotent(spark, sf):
    e = view.stored_edges(spark, sf)  # each replay reads them
    replayed = e.withColumn("version", F.lit(1)).unionByName(e.withColumn("version", F.lit(2))).unionByName(e.where("app_id % 2 = 0").withColumn("version", F.lit(2)))
    return linkage.latest_edges(replayed).groupBy("kind").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("app_id").alias("n_apps"))


@query("""WITH r AS (SELECT o_orderkey AS doc_id, o_totalprice AS p, c_acctbal AS net FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0),
e AS (SELECT doc_id, p, net, p * 0.00875 * pow(1 + 0.105 / 12, 60) / (pow(1 + 0.105 / 12, 60) - 1) AS emi, 0.5 * net * (pow(1 + 0.105 / 12, 60) - 1) / (0.00875 * pow(1 + 0.105 / 12, 60)) AS most FROM r)
SELECT doc_id, round(emi, 2) AS emi, round(most, 2) AS max_eligible, round(emi / net, 3) AS foir, CASE WHEN emi / net <= 0.5 THEN 'ELIGIBLE' WHEN emi / net <= 0.6 THEN 'REFER' ELSE 'DECLINE' END AS verdict FROM e""")
def emi_affordability(spark, sf):
    r = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).where("c_acctbal > 0")
    out = underwriting.affordability(r, F.col("o_totalprice"), F.col("c_acctbal"), F.lit(fixed.TENURE_MONTHS))
    return out.select(F.col("o_orderkey").alias("doc_id"), F.round("emi", 2).alias("emi"), F.round("max_eligible", 2).alias("max_eligible"), F.round("foir", 3).alias("foir"), "verdict")


@query(view.sql("docs", "implied", "facts") + """
SELECT doc_id, CASE WHEN declared = 0 OR implied = 0 THEN 'unknown' WHEN abs(declared - implied) / greatest(declared, implied) <= 0.15 THEN 'consistent' ELSE 'inconsistent' END AS slip_bank,
  CASE WHEN implied / declared BETWEEN 0.55 AND 1.05 THEN 'plausible' ELSE 'implausible' END AS bank_gross FROM facts""")
def income_reconciliation(spark, sf):
    out = underwriting.reconcile(view.facts(spark, sf), F.col("declared"), F.col("implied"))
    return out.select("doc_id", "slip_bank", "bank_gross")
