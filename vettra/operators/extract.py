"""Field extraction from document texts: label patterns for each document type, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettra.functions import fixed, scalars


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that f names several times: the value, a pattern over a whole text, is found once."""
    return F.transform(F.array(value), f)[0]


def first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    """Group 1 of the first pattern that matches, trimmed; null without a match."""
    return F.coalesce(*(once(F.trim(F.regexp_extract(text, "(?d)" + p, 1)), lambda x: F.nullif(x, F.lit(""))) for p in patterns))


def money(value: Column) -> Column:
    return F.regexp_replace(value, r"Rs\.|,", "").try_cast("double")


def all_money(text: Column, patterns: tuple[str, ...]) -> Column:
    """The amounts of every match of the first pattern that matches at all."""
    found = [F.filter(F.transform(F.regexp_extract_all(text, F.lit(p), 1), money), lambda x: x.isNotNull()) for p in patterns]

    def either(f: Column, other: Column) -> Column:
        return once(f, lambda x: F.when(F.size(x) > 0, x).otherwise(other))

    out = found[-1]
    for f in found[-2::-1]:
        out = either(f, out)
    return out


def charges(text: Column) -> Column:
    """Mortgages of an encumbrance certificate: (lender, amount, registered_on)."""
    parts = [F.regexp_extract_all(text, F.lit(fixed.CHARGE_PATTERN), g) for g in (1, 2, 3)]
    return F.transform(F.arrays_zip(*parts), lambda x: F.struct(F.trim(x["0"]).alias("lender"), money(x["1"]).alias("amount"), x["2"].alias("registered_on")))


def field(text: Column, kind: str, patterns: tuple[str, ...]) -> Column:
    match kind:
        case "text":
            return first_match(text, patterns)
        case "money":
            return money(first_match(text, patterns))
        case "moneys":
            return all_money(text, patterns)
        case "flag":
            return F.coalesce(text.rlike(patterns[0]), F.lit(False))
        case "last":  # the label's value, else the last match anywhere
            anywhere = F.regexp_extract_all(text, F.lit(f"({patterns[-1]})"), 1)
            return F.coalesce(first_match(text, patterns[:-1]), F.try_element_at(anywhere, F.lit(-1)))
    raise ValueError(kind)


def fields_of(text: Column, doc_type: str) -> dict[str, Column]:
    """The fields of one document type."""
    out = {name: field(text, kind, patterns) for name, (kind, patterns) in fixed.FIELDS.get(doc_type, {}).items()}
    if "salary_credits" in out:
        credits = out["salary_credits"]
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
        out["monthly_credit"] = F.try_element_at(credits, F.lit(1))
        out["implied_annual"] = once(credits, lambda c: F.when(F.size(c) > 0, total(c) / F.size(c) * 12))
    if doc_type == "encumbrance_certificate":
        out["charges"] = charges(text)
    if "address" in out:
        out["address"] = F.substring(out["address"], 1, 200)
    return out


def entities(docs: DataFrame, *keep: str, doc_type: str = "doc_type", text: str = "text") -> DataFrame:
    """docs' columns `keep`, the type, and one column for each field of any type, null where the type lacks it.

    Unknown types and null texts have no fields.
    """
    of, names = {t: fields_of(F.col(text), t) for t in fixed.FIELDS}, {}
    for t, fields in of.items():
        for name, value in fields.items():
            names.setdefault(name, []).append(F.when(F.col(doc_type) == t, value))
    return docs.select(*keep, F.col(doc_type).alias("doc_type"), *(F.coalesce(*v).alias(n) for n, v in names.items()))


def pan_card(text: Column) -> dict[str, Column]:
    """Number (its last letter may be missing, so that altered cards surface), name and date of birth of a PAN card."""
    born = F.nullif(F.regexp_extract(text, fixed.BORN_PATTERN, 1), F.lit(""))
    return {
        "pan": F.upper(F.nullif(F.regexp_extract(text, "[A-Za-z]{5}[0-9]{4}[A-Za-z]?", 0), F.lit(""))),
        "name": F.nullif(F.trim(F.regexp_extract(text, fixed.CARD_NAME_PATTERN, 1)), F.lit("")),
        "dob": F.coalesce(scalars.parse_date(born), born),
    }


def aadhaar_card(text: Column) -> dict[str, Column]:
    """Number (masked or not), gender, date or else year of birth, and name of an Aadhaar card."""
    number = F.regexp_extract(text, r"(?i)\b([0-9X*]{4}\s?[0-9X*]{4}\s?\d{4})\b", 1)
    born = F.nullif(F.regexp_extract(text, r"(?i)(?:DOB|Date of Birth)\s*[:\-]?\s*([0-3]?\d[/\-.][0-3]?\d[/\-.]\d{2,4})", 1), F.lit(""))
    year = F.nullif(F.regexp_extract(text, r"(?i)(?:YOB|Year of Birth)\s*[:\-]?\s*(\d{4})", 1), F.lit(""))
    return {
        "aadhaar": F.nullif(F.upper(F.regexp_replace(number, r"\s+", "")), F.lit("")),
        "gender": F.nullif(F.upper(F.regexp_extract(text, r"(?i)\b(MALE|FEMALE|TRANSGENDER)\b", 1)), F.lit("")),
        "dob": F.coalesce(scalars.parse_date(born), born, year),
        "name": F.nullif(F.trim(F.regexp_extract(text, fixed.CARD_NAME_PATTERN, 1)), F.lit("")),
    }


def identifiers(pan: Column, aadhaar: Column) -> Column:
    """Validation of whichever identifiers are there: struct(pan, aadhaar), a part null where its number is."""
    return F.struct(F.when(pan.isNotNull(), scalars.validate_pan(pan)).alias("pan"), F.when(aadhaar.isNotNull(), scalars.validate_aadhaar(aadhaar)).alias("aadhaar"))


def identifier_findings(cards: DataFrame) -> DataFrame:
    """HIGH findings for numbers that don't validate, from (packet_id, doc_id, kyc)."""
    bad = F.filter(
        F.array(
            F.when(~F.col("kyc.pan.valid"), F.struct(F.lit("PAN").alias("kind"), F.col("kyc.pan.normalized").alias("value"))),
            F.when(~F.col("kyc.aadhaar.valid"), F.struct(F.lit("Aadhaar").alias("kind"), F.lit(None).cast("string").alias("value"))),
        ),
        lambda x: x.isNotNull(),
    )
    return cards.select("packet_id", "doc_id", F.explode(bad).alias("b")).select("packet_id", "doc_id", F.concat(F.lit("Invalid "), F.col("b.kind"), F.lit(" number")).alias("title"), F.lit("high").alias("severity"))


def qr_identifier(payload: Column) -> Column:
    """The first PAN in a QR payload."""
    return F.nullif(F.regexp_extract(F.upper(payload), "[A-Z]{5}[0-9]{4}[A-Z]", 0), F.lit(""))


def ingest(docs: DataFrame, lexicon_type: str = "hint", text: str = "text") -> DataFrame:
    """One chain for raw texts: classify unless a type is given, extract, validate."""
    from vettra.operators.documents import classify

    found = classify(docs, "doc_id", text).select("doc_id", F.col("doc_type").alias("guess"), "confidence")
    typed = docs.join(found, "doc_id").withColumn("type", F.coalesce(lexicon_type, "guess"))
    pan, aadhaar = pan_card(F.col(text)), aadhaar_card(F.col(text))
    number = F.when(F.col("type") == "pan", pan["pan"]), F.when(F.col("type") == "aadhaar", aadhaar["aadhaar"])
    return typed.select("doc_id", F.col("type").alias("doc_type"), "confidence", identifiers(*number).alias("kyc"), F.when(F.col("type") == "pan", pan["name"]).when(F.col("type") == "aadhaar", aadhaar["name"]).alias("name"))
