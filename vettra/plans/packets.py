"""Queries over whole packets: document texts, extracted entities, rules, features, decision and verification.

The documents are those of plans/lending.py. Findings of the documents, of the rules across
them and of the graph of all applications meet in one decision.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vettra.functions import fixed
from vettra.operators import ordered, packets, rules, underwriting
from vettra.plans import lending
from vettra.plans.lending import lit
from vettra.sources.shared import written

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


CTE = dict(lending.CTE) | {
    "wide": """wide AS (SELECT packet_id, max(gross_income) AS gross_income, max(implied_annual) AS implied_annual, max(net_monthly) AS net_monthly, max(owner_name) FILTER (doc_type = 'sale_deed') AS deed_owner,
  max(name) FILTER (doc_type = 'identity') AS identity_name, max(valuation_amount) AS valuation_amount, max(property_id) FILTER (doc_type = 'property_valuation') AS valued_property, bool_or(claims_nil) AS claims_nil,
  coalesce(max(property_id) FILTER (doc_type = 'sale_deed'), max(property_id) FILTER (doc_type = 'encumbrance_certificate'), max(property_id) FILTER (doc_type = 'property_valuation')) AS collateral FROM last GROUP BY packet_id),
checked AS (SELECT wide.*, loan_amount, applicant_pan, market_value, owed.n AS n_charges FROM wide JOIN applications USING (packet_id) LEFT JOIN market ON market.property_id = valued_property
  LEFT JOIN owed ON owed.pan = applicant_pan AND owed.property_id = collateral)""",
    "semantic": f"""gaps AS (SELECT *, CASE WHEN greatest(abs(gross_income), abs(implied_annual)) < 1 THEN 0 ELSE abs(gross_income - implied_annual) / greatest(abs(gross_income), abs(implied_annual)) END AS bank,
  CASE WHEN greatest(abs(gross_income), abs(net_monthly * 12)) < 1 THEN 0 ELSE abs(gross_income - net_monthly * 12) / greatest(abs(gross_income), abs(net_monthly * 12)) END AS slip FROM checked),
semantic AS (
  SELECT packet_id, 'income_bank' AS rule, 1 AS part, 0 AS place, CASE WHEN bank > 0.4 THEN 'high' ELSE 'medium' END AS severity, 'form16.pdf vs bank_statement.pdf' AS location, round(bank * 100, 1) AS detail FROM gaps WHERE gross_income IS NOT NULL AND implied_annual IS NOT NULL AND bank > 0.2
  UNION ALL SELECT packet_id, 'income_slip', 2, 0, CASE WHEN slip > 0.4 THEN 'high' ELSE 'medium' END, 'form16.pdf vs salary_slip.pdf', round(slip * 100, 1) FROM gaps WHERE gross_income IS NOT NULL AND net_monthly IS NOT NULL AND slip > 0.2
  UNION ALL SELECT packet_id, 'name', 3, position, 'high', t0 || ' vs ' || doc_type, NULL FROM (SELECT *, first_value(name) OVER w AS n0, first_value(doc_type) OVER w AS t0 FROM last WHERE name IS NOT NULL WINDOW w AS (PARTITION BY packet_id ORDER BY position)) WHERE lower(name) <> lower(n0)
  UNION ALL SELECT packet_id, 'pan', 4, position, 'critical', t0 || ' vs ' || doc_type, NULL FROM (SELECT *, first_value(pan) OVER w AS n0, first_value(doc_type) OVER w AS t0 FROM last WHERE pan IS NOT NULL WINDOW w AS (PARTITION BY packet_id ORDER BY position)) WHERE pan <> n0
  UNION ALL SELECT packet_id, 'owner', 5, 0, 'critical', 'sale_deed.pdf vs identity.pdf', NULL FROM checked WHERE lower(trim(deed_owner)) <> lower(trim(identity_name))
  UNION ALL SELECT packet_id, 'property', 6, k, 'high', t0 || ' vs ' || doc_type, NULL FROM (SELECT *, first_value(property_id) OVER w AS n0, first_value(doc_type) OVER w AS t0 FROM (SELECT *, list_position([{', '.join(map(lit, rules.PROPERTY_TYPES))}], doc_type) AS k FROM last WHERE property_id IS NOT NULL) WINDOW w AS (PARTITION BY packet_id ORDER BY k)) WHERE property_id <> n0
  UNION ALL SELECT packet_id, 'ltv', 7, 0, CASE WHEN loan_amount / nullif(valuation_amount, 0) > 1 THEN 'critical' ELSE 'high' END, 'property_valuation.pdf', round(loan_amount / nullif(valuation_amount, 0), 3) FROM checked WHERE loan_amount / nullif(valuation_amount, 0) > 0.9
  UNION ALL SELECT packet_id, 'valuation', 8, 0, CASE WHEN (valuation_amount - market_value) / market_value > 0.4 THEN 'critical' ELSE 'high' END, 'property_valuation.pdf vs property_registry', round((valuation_amount - market_value) / market_value * 100, 1) FROM checked WHERE valuation_amount > market_value * 1.2
  UNION ALL SELECT packet_id, 'loan', 9, 0, 'critical', 'property_valuation.pdf vs property_registry', round(loan_amount / market_value, 3) FROM checked WHERE valuation_amount <> 0 AND loan_amount > market_value
  UNION ALL SELECT packet_id, 'encumbrance', 10, 0, 'critical', 'encumbrance_certificate.pdf vs CERSAI registry', n_charges FROM checked WHERE claims_nil AND n_charges > 0),
titles(rule, title, confidence) AS (VALUES {', '.join(f"({lit(k)}, {lit(t)}, {c}::DOUBLE)" for k, (t, c) in fixed.RULES.items())}),
found_by_rules AS (SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY part, place) AS seq FROM semantic JOIN titles USING (rule))""",
}


def sql(*names: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names)


ENTITIES = ("docs", "entities")
RULES = (*ENTITIES, "last", "registries", "wide", "semantic")


# ---- the Spark side, from the written documents of all packets
def semantic(spark, sf, docs, found=None):
    """What the rules find; found: the documents' entities where they are written already."""
    # the window, the grouping and the join after it need no other exchange; only texts that the rules see are read
    last = ordered.last_per_type((docs if found is None else found).repartition("packet_id"))
    one = rules.by_packet(lending.entities(last, "position") if found is None else last).join(lending.applications(docs), "packet_id")
    return rules.findings(rules.with_registries(one, *lending.registries(spark, sf, docs)))


def features(spark, sf, docs=None):
    """A row a packet, written once: scaling, attributions and scores each read it."""
    docs = lending.stored_documents(spark, sf) if docs is None else docs
    return written(packets.feature_vector(docs, lending.forensic(docs), semantic(spark, sf, docs), underwriting.behaviour(docs)), "features")


def scores(found):
    """Stand-in for the trained model, which SQL lacks: (packet_id, probability, anomaly) from the features."""
    p = F.least(F.lit(0.99), 0.02 + 0.09 * F.col("n_semantic_total") + 0.06 * F.col("n_forensic_total"))
    return found.select("packet_id", F.round(p, 4).alias("probability"), F.round(F.least(F.lit(1.0), F.col("doc_count") / 25), 4).alias("anomaly"))


E_TEXT = "name pan dob employer fy masked_account property_id owner_name period advocate address issue_date".split()
E_OTHER = "gross_income tax_paid monthly_credit net_monthly consideration valuation_amount claims_nil title_clear title_unclear".split()


@query(sql(*ENTITIES) + f" SELECT doc_id, doc_type, {', '.join(E_TEXT + E_OTHER)}, charges, round(implied_annual, 4) AS implied_annual FROM entities")
def document_entities(spark, sf):
    """Every field of every document type, charges as joined text."""
    e = lending.entities(lending.documents(spark, sf))
    charges = F.array_join(F.transform("charges", lambda c: F.concat_ws(":", c["lender"], c["amount"].cast("long").cast("string"), c["registered_on"])), ";")
    return e.select("doc_id", "doc_type", *E_TEXT, *E_OTHER, charges.alias("charges"), F.round("implied_annual", 4).alias("implied_annual"))


@query(sql(*RULES) + " SELECT packet_id, rule, severity, title, location, confidence, detail, seq FROM found_by_rules")
def packet_rules_all(spark, sf):
    return semantic(spark, sf, lending.stored_documents(spark, sf)).select("packet_id", "rule", "severity", "title", "location", "confidence", "detail", "seq")


@query(sql("docs", "forensic") + " SELECT packet_id, doc_id, page, severity, title, confidence, checked_by, seq FROM forensic")
def packet_document_findings(spark, sf):
    """All detectors over the documents of all packets, from metadata to recognition."""
    out = lending.forensic(lending.stored_documents(spark, sf))
    return out.select("packet_id", "doc_id", "page", "severity", "title", "confidence", F.col("check").alias("checked_by"), "seq")


@query(sql("docs", "graph") + " SELECT packet_id, severity, title, location, confidence, row_number() OVER (PARTITION BY packet_id ORDER BY part, location) AS seq FROM graph")
def packet_graph_findings(spark, sf):
    """What the graph of all applications says of each packet."""
    return lending.graph(written(lending.edges(lending.stored_documents(spark, sf)), "edges", "kind"))


def _any(words: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(lower(title), {lit(w)})" for w in words)


CTE["features"] = f"""f AS (SELECT packet_id, count(*) AS n_forensic_total, count_if(severity IN ('high', 'critical')) AS n_forensic_high_critical, {', '.join(f'max(({_any(w)})::INTEGER) AS {n}' for n, w in fixed.FORENSIC_FLAGS.items())} FROM forensic WHERE checked_by <> 'reocr' GROUP BY 1),
s AS (SELECT packet_id, count(*) AS n_semantic_total, {', '.join(f'max(({_any(w)})::INTEGER) AS {n}' for n, w in fixed.SEMANTIC_FLAGS.items())} FROM found_by_rules GROUP BY 1),
b AS (SELECT packet_id, greatest(0, (epoch_us(min(submitted)) - epoch_us(max(created))) / 3600000000) AS submit_velocity_hours,
  CASE WHEN count(created) >= 2 THEN floor((epoch_us(max(created)) - epoch_us(min(created))) / 86400000000) ELSE 0 END AS max_doc_gap_days,
  (count(created) >= 2 AND count(DISTINCT date_trunc('minute', created)) = 1)::INTEGER AS all_docs_same_timestamp, coalesce(bool_and(created <= submitted), true)::INTEGER AS creation_before_submission, count(*) AS doc_count
  FROM docs GROUP BY 1),
features AS (SELECT p.packet_id, {', '.join(f'coalesce({n}, 0)::DOUBLE AS {n}' for n in fixed.FEATURES)} FROM (SELECT DISTINCT packet_id FROM docs) p LEFT JOIN f USING (packet_id) LEFT JOIN s USING (packet_id) LEFT JOIN b USING (packet_id)),
scores AS (SELECT packet_id, round(least(0.99, 0.02 + 0.09 * n_semantic_total + 0.06 * n_forensic_total), 4) AS probability, round(least(1.0, doc_count / 25), 4) AS anomaly FROM features)"""
FEATURES = (*RULES, "forensic", "features")


@query(sql(*FEATURES) + f" SELECT packet_id, {', '.join(f'round({n}, 4) AS {n}' for n in fixed.FEATURES)} FROM features")
def feature_vector(spark, sf):
    return features(spark, sf).select("packet_id", *(F.round(n, 4).alias(n) for n in fixed.FEATURES))


IMPORTANCE = {"n_forensic_total": 0.1, "n_semantic_total": 0.3, "has_cersai_violation": 0.05, "submit_velocity_hours": 0.5, "doc_count": 0.05}
_Z = {n: f"{w} * abs(({n} - (SELECT avg({n}) FROM clean)) / coalesce(nullif((SELECT stddev_pop({n}) FROM clean), 0), 1))" for n, w in IMPORTANCE.items()}
CTE["attributions"] = f"""clean AS (SELECT * FROM features WHERE n_semantic_total <= 1),
weights AS ({' UNION ALL '.join(f"SELECT packet_id, {i} AS i, {lit(n)} AS feature, {z} AS w FROM features" for i, (n, z) in enumerate(_Z.items()))}),
shares AS (SELECT packet_id, i, feature, w / nullif(sum(w) OVER (PARTITION BY packet_id), 0) AS share FROM weights),
factors AS (SELECT packet_id, feature, share, row_number() OVER (PARTITION BY packet_id ORDER BY share DESC, i) AS rank FROM shares WHERE share > 0.01 QUALIFY rank <= 4)"""


def factors(found):
    return packets.attributions(found, F.col("n_semantic_total") <= 1, IMPORTANCE)


@query(sql(*FEATURES, "attributions") + " SELECT packet_id, rank, feature, round(share, 6) AS share FROM factors")
def attributions(spark, sf):
    return factors(features(spark, sf)).select("packet_id", "rank", "feature", F.round("share", 6).alias("share"))


_SEVERITY = "CASE WHEN probability >= 0.8 THEN 'high' WHEN probability >= 0.5 THEN 'medium' WHEN probability >= 0.2 THEN 'low' ELSE 'info' END"


@query(sql(*FEATURES, "attributions") + f""", labels(feature, label) AS (VALUES {', '.join(f'({lit(k)}, {lit(v)})' for k, v in fixed.FEATURES.items())}),
named AS (SELECT packet_id, string_agg(label, '; ' ORDER BY rank) AS named FROM factors JOIN labels USING (feature) GROUP BY 1)
SELECT packet_id, {_SEVERITY} AS severity, round(greatest(probability, 1 - probability), 3) AS confidence,
  round(probability * 100)::INTEGER || '% fraud probability by the risk model' || CASE WHEN named IS NOT NULL THEN ', mostly by ' || named WHEN probability >= 0.5 AND NOT coalesce(n_doc > 0, false) THEN ', though no document or rule shows anything; see the linked applications' ELSE '' END || '.' AS description, probability AS fraud_probability, anomaly AS anomaly_score FROM scores LEFT JOIN named USING (packet_id) LEFT JOIN (SELECT packet_id, n_forensic_total + n_semantic_total AS n_doc FROM features) USING (packet_id)""")
def model_evidence(spark, sf):
    found = features(spark, sf)
    shown = found.select("packet_id", (F.col("n_forensic_total") + F.col("n_semantic_total") > 0).alias("has_doc_evidence"))
    return packets.model_evidence(scores(found), factors(found), shown).select("packet_id", "severity", "confidence", "description", "values.fraud_probability", "values.anomaly_score")


@query(sql(*FEATURES) + f" SELECT packet_id, probability AS fraud_probability, anomaly AS anomaly_score, {_SEVERITY} AS severity FROM scores")
def model_only(spark, sf):
    return packets.model_only(scores(features(spark, sf)))


CTE["decided"] = f"""chain AS (SELECT packet_id, 'forensic' AS category, severity, title, location FROM forensic
  UNION ALL SELECT packet_id, 'semantic', severity, title, location FROM found_by_rules UNION ALL SELECT packet_id, 'graph', severity, title, location FROM graph),
points AS (SELECT *, CASE severity WHEN 'critical' THEN 60 WHEN 'high' THEN 35 WHEN 'medium' THEN 18 WHEN 'low' THEN 6 ELSE 0 END AS pts FROM chain),
risks AS (SELECT packet_id, count(*) AS n_findings, count_if(severity IN ('high', 'critical')) AS n_severe, least(1.0, coalesce(sum(pts) FILTER (category = 'forensic'), 0) / 100)::DOUBLE AS forensic_risk,
  least(1.0, coalesce(sum(pts) FILTER (category = 'semantic'), 0) / 100)::DOUBLE AS semantic_risk, least(1.0, coalesce(sum(pts) FILTER (category = 'graph'), 0) / 100)::DOUBLE AS graph_risk,
  bool_or(severity = 'critical') AS has_critical, bool_or(category <> 'graph' OR severity <> 'info') AS has_evidence, count(DISTINCT (category, title, location)) AS n_chain FROM points GROUP BY 1),
blend AS (SELECT packet_id, coalesce(n_findings, 0) AS n_findings, coalesce(n_severe, 0) AS n_severe, coalesce(has_critical, false) AS has_critical, coalesce(has_evidence, false) AS has_evidence, coalesce(n_chain, 0) + 1 AS chain,
  coalesce(forensic_risk, 0) AS forensic_risk, coalesce(semantic_risk, 0) AS semantic_risk, coalesce(graph_risk, 0) AS graph_risk, probability,
  least(1.0, 0.55 * probability + 0.25 * coalesce(forensic_risk, 0) + 0.15 * coalesce(semantic_risk, 0) + 0.05 * anomaly + 0.5 * coalesce(graph_risk, 0)) AS risk FROM scores LEFT JOIN risks USING (packet_id)),
trusted AS (SELECT *, greatest(0.0, least(100.0, round((CASE WHEN has_critical THEN least(100 * (1 - risk), 25.0) ELSE 100 * (1 - risk) END)::DOUBLE::VARCHAR::DECIMAL(38, 20), 1)::DOUBLE)) AS trust FROM blend)"""


DECIDED = (*FEATURES, "graph", "decided")


@query(sql(*DECIDED) + """ SELECT packet_id, n_findings, n_severe, round(graph_risk, 6) AS graph_risk, round(risk, 6) AS risk, trust, CASE WHEN trust >= 70 THEN 'approve' WHEN trust < 40 AND (has_evidence OR has_critical) THEN 'freeze' ELSE 'manual_review' END AS action, chain,
  round(100 * (1 - forensic_risk), 1) AS forensic_subscore, round(100 * (1 - semantic_risk), 1) AS semantic_subscore, round(100 * (1 - probability), 1) AS anomaly_subscore FROM trusted""")
def score_driver(spark, sf):
    out = decisions(spark, sf)
    return out.select("packet_id", "n_findings", "n_severe", F.round("graph_risk", 6).alias("graph_risk"), F.round("risk", 6).alias("risk"), "trust", "action", "chain", "forensic_subscore", "semantic_subscore", "anomaly_subscore")


def evidence_rows(spark, sf, docs, found, marks):
    """The findings of documents, rules and graph as evidence of their packets, in this order."""
    one = lambda df, c: df.select("packet_id", F.lit(c).alias("category"), "severity", "title", "location", "seq")
    links = lending.graph(written(lending.edges(docs), "edges", "kind"))
    return one(marks, "forensic").unionByName(one(found, "semantic")).unionByName(one(links, "graph"))


def decisions(spark, sf, docs=None, scored=scores, more=None, entities=None):
    """Decisions of all packets, from their texts on; scored: features -> (packet_id, probability, anomaly). `more` evidence sets no feature."""
    docs = lending.stored_documents(spark, sf) if docs is None else docs
    found, marks = written(semantic(spark, sf, docs, entities), "rules"), written(lending.forensic(docs), "findings")  # each feeds features and evidence
    vector = written(packets.feature_vector(docs, marks, found, underwriting.behaviour(docs)), "features")
    rows = evidence_rows(spark, sf, docs, found, marks)
    return packets.packet_decision(docs, rows if more is None else rows.unionByName(more), scored(vector))


_FIRST = """ok AS (SELECT *, CASE doc_type WHEN 'identity' THEN 'pan' ELSE doc_type END AS slot FROM entities WHERE n_lines > 1 OR status <> 'P'),
firsts AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY packet_id, slot ORDER BY ordinal) = 1),
people AS (SELECT packet_id, count(DISTINCT upper(name)) AS n_names FROM (SELECT * FROM ok WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY packet_id, slot ORDER BY ordinal DESC) = 1) GROUP BY 1),
seen AS (SELECT packet_id, list(DISTINCT slot) AS slots, coalesce(bool_or(slot = 'pan' AND pan IS NOT NULL), false) AS identity, bool_or(slot IN ('aadhaar', 'address_proof')) AS address FROM ok GROUP BY 1),
sums AS (SELECT packet_id, max(net_monthly) AS net, max(monthly_credit) AS credit, max(implied_annual) AS bank, max(gross_income) AS gross, coalesce(max(valuation_amount), max(consideration)) AS collateral FROM firsts GROUP BY 1),
v AS (SELECT packet_id, nullif(loan_amount, 0) AS loan, coalesce(identity, false) AS identity, coalesce(address, false) AS address, coalesce(n_names, 0) <= 1 AS agree, net, bank, gross, collateral,
  coalesce(net, credit, gross * 0.7 / 12) AS monthly, list_filter(['pan', 'aadhaar', 'address_proof', 'salary_slip', 'form16', 'bank_statement'], lambda x: NOT list_contains(coalesce(slots, []), x)) AS missing,
  CASE WHEN abs(net * 12 - bank) / greatest(net * 12, bank) > 0.15 THEN 18 ELSE 0 END AS slip_points, CASE WHEN bank / gross > 1.05 THEN 18 WHEN bank / gross < 0.55 THEN 6 ELSE 0 END AS gross_points
  FROM applications LEFT JOIN seen USING (packet_id) LEFT JOIN people USING (packet_id) LEFT JOIN sums USING (packet_id)),
e AS (SELECT *, loan * 0.00875 * pow(1 + 0.105 / 12, 60) / (pow(1 + 0.105 / 12, 60) - 1) / monthly AS foir, round(loan / collateral, 3) AS ltv FROM v)"""


@query(sql(*ENTITIES, "registries") + f""", {_FIRST}
SELECT packet_id, len(missing) = 0 AS complete, array_to_string(missing, ',') AS missing, CASE WHEN identity AND address AND agree THEN 'ESTABLISHED' ELSE 'INCOMPLETE' END AS kyc,
  coalesce(gross, bank, net) IS NOT NULL AND slip_points + gross_points = 0 AS reconciled, round(least(25.0, 6.0 * len(missing) + CASE WHEN identity THEN 0 ELSE 18 END + CASE WHEN address THEN 0 ELSE 6 END + CASE WHEN agree THEN 0 ELSE 18 END + slip_points + gross_points), 1) AS penalty,
  CASE WHEN monthly IS NULL OR monthly <= 0 THEN NULL WHEN loan IS NULL THEN 'INFO' WHEN coalesce(ltv <= 0.8, true) AND foir <= 0.5 THEN 'ELIGIBLE' WHEN coalesce(ltv <= 0.8, true) AND foir <= 0.6 THEN 'REFER' ELSE 'DECLINE' END AS eligibility,
  CASE WHEN monthly > 0 THEN round(foir, 3) END AS foir, CASE WHEN monthly > 0 THEN ltv END AS ltv FROM e""")
def verification_driver(spark, sf):
    out = verified(lending.stored_documents(spark, sf))
    return out.select("packet_id", "complete", F.array_join("missing", ",").alias("missing"), "kyc", "reconciled", "penalty", "eligibility", "foir", "ltv")


def verified(docs, entities=None):
    """The verification block of every packet; scans of one line that are still pending are not ok."""
    e = (lending.entities(docs) if entities is None else entities).withColumns({"ok": (F.col("n_lines") > 1) | (F.col("status") != "P"), "slot": F.when(F.col("doc_type") == "identity", "pan").otherwise(F.col("doc_type")), "aadhaar_valid": F.lit(None).cast("boolean")})
    return packets.verification(lending.applications(docs), e, "salaried_loan")


VERIFIED = """ver AS (SELECT packet_id, round(least(25.0, 6.0 * len(missing) + CASE WHEN identity THEN 0 ELSE 18 END + CASE WHEN address THEN 0 ELSE 6 END + CASE WHEN agree THEN 0 ELSE 18 END + slip_points + gross_points), 1) AS penalty FROM e),
folded AS (SELECT t.packet_id, penalty, has_critical, has_evidence, CASE WHEN has_critical THEN least(greatest(0.0, round((trust - penalty)::DOUBLE::VARCHAR::DECIMAL(38, 20), 1)::DOUBLE), 25.0) ELSE greatest(0.0, round((trust - penalty)::DOUBLE::VARCHAR::DECIMAL(38, 20), 1)::DOUBLE) END AS final FROM trusted t JOIN ver USING (packet_id))"""
