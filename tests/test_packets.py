"""Extraction, rules and verification on stated small cases."""

import pytest
from pyspark.sql import functions as F

from vettra.operators import extract, packets, rules


def one(spark, text, doc_type):
    df = spark.createDataFrame([(1, doc_type, text)], "packet_id long, doc_type string, text string")
    return extract.entities(df, "packet_id").first()


def test_form16_layouts(spark):
    flat = one(spark, "FORM 16 FY 2023-24\nEmployee: Asha Rao\nPAN: ABCPV1234D\nEmployer: Acme Ltd\nGross Salary: Rs. 18,20,000\nTax Deducted\nRs. 1,000", "form16")
    assert (flat.name, flat.pan, flat.employer, flat.gross_income, flat.tax_paid, flat.fy) == ("Asha Rao", "ABCPV1234D", "Acme Ltd", 1820000.0, 1000.0, "2023-24")
    block = one(spark, "Name and address of the Employer\nAcme Ltd\nName and address of the Employee\n Asha Rao\nAAAPA1111A x ABCPV1234D\nGross Salary (a)\n(b)\nRs. 5,00,000", "form16")
    assert (block.name, block.pan, block.employer, block.gross_income, block.tax_paid) == ("Asha Rao", "ABCPV1234D", "Acme Ltd", 500000.0, None)


def test_other_types(spark):
    slip = one(spark, "Acme Ltd\nx\nPayslip for the month May\nEmployee Name: A B\nNet Pay (take-home)\nRs. 80,000", "salary_slip")
    assert (slip.name, slip.employer, slip.net_monthly) == ("A B", "Acme Ltd", 80000.0)
    bank = one(spark, "Holder: A B\nAccount: XX12\nSALARY CREDIT May\n Rs. 70,000\nSALARY CREDIT June\n Rs. 90,000", "bank_statement")
    assert (bank.salary_credits, bank.monthly_credit, bank.implied_annual, bank.masked_account) == ([70000.0, 90000.0], 70000.0, 960000.0, "XX12")
    none = one(spark, "Holder: A B", "bank_statement")
    assert (none.salary_credits, none.monthly_credit, none.implied_annual) == ([], None, None)
    ec = one(spark, "Property: SY-217/3B | Period: 2010-2024\nOwner: A B\nmortgage in favour of First Bank, Rs. 5,00,000, registered 2019-01-02", "encumbrance_certificate")
    assert (ec.property_id, ec.period, ec.claims_nil) == ("SY-217/3B", "2010-2024", False)
    assert [tuple(c) for c in ec.charges] == [("First Bank", 500000.0, "2019-01-02")]
    legal = one(spark, "Property No: SY-1\nOwner examined: A\nAdvocate: B\nThe title is NOT clear", "legal_opinion")
    assert (legal.advocate, legal.title_clear, legal.title_unclear) == ("B", False, True)
    proof = one(spark, "Consumer Name: Asha Rao\nBilling Address: " + "x" * 300 + "\nBill Date: 05/03/2024", "address_proof")
    assert (proof.name, len(proof.address), proof.issue_date) == ("Asha Rao", 200, "05/03/2024")
    assert one(spark, None, "identity").name is None and one(spark, "Name: x", "unheard of").name is None


def test_cards(spark):
    df = spark.createDataFrame([("PATPK4316\nName: Asha Rao\nDOB: 02/03/1990", "XXXX XXXX 1234\nFEMALE\nYear of Birth: 1990\nName: B C")], "p string, a string")
    pan, aadhaar = extract.pan_card(F.col("p")), extract.aadhaar_card(F.col("a"))
    r = df.select(*(v.alias(f"p_{k}") for k, v in pan.items()), *(v.alias(f"a_{k}") for k, v in aadhaar.items()), extract.identifiers(pan["pan"], aadhaar["aadhaar"]).alias("kyc")).first()
    assert (r.p_pan, r.p_name, r.p_dob) == ("PATPK4316", "Asha Rao", "1990-03-02")
    assert (r.a_aadhaar, r.a_gender, r.a_dob, r.a_name) == ("XXXXXXXX1234", "FEMALE", "1990", "B C")
    assert not r.kyc.pan.valid and r.kyc.aadhaar.valid
    cards = df.select(F.lit(1).alias("packet_id"), F.lit(2).alias("doc_id"), extract.identifiers(pan["pan"], aadhaar["aadhaar"]).alias("kyc"))
    assert [(x.title, x.severity) for x in extract.identifier_findings(cards).collect()] == [("Invalid PAN number", "high")]


FIELDS = "packet_id long, position int, doc_type string, name string, pan string, property_id string, owner_name string, gross_income double, implied_annual double, net_monthly double, valuation_amount double, claims_nil boolean"
NONE = dict.fromkeys([f.split()[0] for f in FIELDS.split(", ")])


def found(spark, docs, loan=None, pan="P", market=(), charges=()):
    rows = [tuple((NONE | {"packet_id": 1, "position": i} | d).values()) for i, d in enumerate(docs, 1)]
    one = rules.by_packet(spark.createDataFrame(rows, FIELDS)).withColumns({"loan_amount": F.lit(loan).cast("double"), "applicant_pan": F.lit(pan)})
    known = spark.createDataFrame(list(market), "property_id string, market_value double")
    owed = spark.createDataFrame(list(charges), "pan string, property_id string")
    return [(r.rule, r.severity, r.detail) for r in rules.findings(rules.with_registries(one, known, owed)).orderBy("seq").collect()]


@pytest.mark.parametrize("bank, want", [(820000.0, [("income_bank", "high", 54.9)]), (1638000.0, []), (1400000.0, [("income_bank", "medium", 23.1)]), (None, [])])
def test_income_rule(spark, bank, want):
    assert found(spark, [{"doc_type": "form16", "gross_income": 1820000.0}, {"doc_type": "bank_statement", "implied_annual": bank}]) == want


def test_identity_rules(spark):
    docs = [{"doc_type": "identity", "name": "Asha Rao ", "pan": "A"}, {"doc_type": "form16", "name": "asha rao", "pan": "B"}, {"doc_type": "salary_slip", "name": "B C"}, {"doc_type": "sale_deed", "owner_name": "X"}]
    assert found(spark, docs) == [("name", "high", None), ("pan", "critical", None), ("owner", "critical", None)]


@pytest.mark.parametrize("loan, value, want", [(9.5e6, 1e7, [("ltv", "high", 0.95)]), (9.5e6, 7.5e6, [("ltv", "critical", 1.267)]), (6e6, 9e6, []), (6e6, 0.0, []), (None, 1.0, [])])
def test_ltv_rule(spark, loan, value, want):
    assert found(spark, [{"doc_type": "property_valuation", "valuation_amount": value}], loan) == want


def test_registry_rules(spark):
    docs = [{"doc_type": "encumbrance_certificate", "claims_nil": True, "property_id": "S1"}, {"doc_type": "property_valuation", "valuation_amount": 150.0, "property_id": "S2"}]
    got = found(spark, docs, 120.0, market=[("S2", 100.0)], charges=[("P", "S1"), ("P", "S1"), ("Q", "S1")])
    assert got == [("property", "high", None), ("valuation", "critical", 50.0), ("loan", "critical", 1.2), ("encumbrance", "critical", 2.0)]
    assert found(spark, [docs[0] | {"claims_nil": False}], charges=[("P", "S1")]) == []


VERIFIED = "packet_id long, ordinal int, ok boolean, slot string, name string, pan string, aadhaar_valid boolean, net_monthly double, monthly_credit double, implied_annual double, gross_income double, valuation_amount double, consideration double"


def verify(spark, docs, loan):
    empty = dict.fromkeys([f.split()[0] for f in VERIFIED.split(", ")])
    rows = [tuple((empty | {"packet_id": 1, "ordinal": i, "ok": True} | d).values()) for i, d in enumerate(docs)]
    return packets.verification(spark.createDataFrame([(1, loan)], "packet_id long, loan_amount double"), spark.createDataFrame(rows, VERIFIED), "salaried_loan").first()


def test_verification(spark):
    good = [{"slot": "pan", "pan": "ABCPV1234D", "name": "Mr. Asha Rao"}, {"slot": "aadhaar", "aadhaar_valid": True}, {"slot": "address_proof"}, {"slot": "salary_slip", "net_monthly": 80000.0, "name": "ASHA RAO"}, {"slot": "form16", "gross_income": 1.3e6}, {"slot": "bank_statement", "implied_annual": 960000.0}]
    r = verify(spark, good, 1.5e6)
    assert (r.complete, r.kyc, r.reconciled, r.penalty, r.eligibility) == (True, "ESTABLISHED", True, 0.0, "ELIGIBLE")
    assert verify(spark, good, 9e6).eligibility == "DECLINE" and verify(spark, good, None).eligibility == "INFO"
    secured = [*good, {"slot": "property_valuation", "valuation_amount": 1.6e6}]
    assert (verify(spark, secured, 1.5e6).eligibility, verify(spark, secured, 1.5e6).ltv) == ("DECLINE", 0.938)
    bad = verify(spark, [{"slot": "pan", "pan": "x"}, {"slot": "salary_slip", "net_monthly": 1.0, "ok": False}], 1.0)
    assert (bad.kyc, bad.penalty, bad.eligibility, bad.missing) == ("INCOMPLETE", 25.0, None, ["aadhaar", "address_proof", "salary_slip", "form16", "bank_statement"])


def test_ocr_findings_are_no_features(spark):
    p = spark.createDataFrame([(1,), (2,)], "packet_id long")
    f = spark.createDataFrame([(1, "high", "Font differs", None), (1, "high", "White box", "reocr")], "packet_id long, severity string, title string, check string")
    s = spark.createDataFrame([], "packet_id long, title string")
    b = spark.createDataFrame([(1, 2.0, 3, True, True, 4)], "packet_id long, velocity_hours double, gap_days long, same_minute boolean, all_before boolean, doc_count long")
    got = {r.packet_id: r for r in packets.feature_vector(p, f, s, b).collect()}
    assert (got[1].n_forensic_total, got[1].has_font_inconsistency, got[1].has_whitebox_edit, got[1].doc_count) == (1.0, 1.0, 0.0, 4.0)
    assert sum(got[2][1:]) == 0


def test_packets_of_every_kind(spark):
    """The driver tables' packets exercise the decision: every action, rule and finding, graph risk, and no constant feature."""
    from vettra.functions import fixed
    from vettra.plans import catalogue

    sf = "/root/testdata/sf0.01"
    found = catalogue.QUERIES["score_driver"](spark, sf).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.max("graph_risk").alias("g")).collect()
    total = sum(r.n for r in found)
    assert {r.action for r in found} == {"approve", "manual_review", "freeze"} and all(r.n >= 0.05 * total for r in found) and max(r.g for r in found) > 0
    values = catalogue.QUERIES["feature_vector"](spark, sf).agg(*(F.count_distinct(n).alias(n) for n in fixed.FEATURES)).first().asDict()
    assert all(n > 1 for n in values.values()), values
    assert {r.rule for r in catalogue.QUERIES["packet_rules_all"](spark, sf).select("rule").distinct().collect()} == set(fixed.RULES)
    assert catalogue.QUERIES["packet_document_findings"](spark, sf).select("title").distinct().count() == 9


def test_every_pattern_of_a_text_is_searched_once(spark):
    df = spark.createDataFrame([(1, "form16", "Employer: Acme Ltd")], "packet_id long, doc_type string, text string")
    plan = extract.entities(df, "packet_id").select("employer", "pan")._jdf.queryExecution().optimizedPlan().toString()
    for pattern in ("Employer:", "Name and address of the Employer", "SALARY SLIP"):
        assert plan.count(pattern) == 1, pattern


def test_detectors_read_the_stored_documents_only(spark):
    """Lines reach the detectors with their documents, and only where a detector may find something."""
    from vettra.plans import lending

    docs = lending.stored_documents(spark, "/root/testdata/sf0.001")
    plan = lending.forensic(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan and "l_orderkey" not in plan
    n, marked = docs.count(), docs.where("marked IS NOT NULL").count()
    assert 0 < marked < n / 2
    whole = docs.where("marked IS NOT NULL AND size(marked) <> n_lines").count()
    assert whole == 0


def test_minutes_of_a_packet(spark):
    from vettra.operators import underwriting

    rows = [(1, "2024-01-01 10:00:01"), (1, "2024-01-01 10:00:59"), (2, "2024-01-01 10:00:59"), (2, "2024-01-01 10:01:00"), (3, "2024-01-01 10:00:00"), (3, None), (4, None)]
    df = spark.createDataFrame(rows, "packet_id long, at string").select("packet_id", F.to_timestamp("at").alias("created"), F.to_timestamp(F.lit("2024-02-01")).alias("submitted"))
    assert {r.packet_id: r.same_minute for r in underwriting.behaviour(df).collect()} == {1: True, 2: False, 3: False, 4: False}
