"""Scalar operators as column expressions: money, dates, identifiers, masks, ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vettra.functions import fixed


def parse_amount(text: Column) -> Column:
    """First number times crore (1e7) or lakh/lac (1e5); null without a number."""
    low = F.lower(text)
    times = F.when(low.rlike(r"\bcrores?\b"), 1e7).when(low.rlike(r"\bla(kh|c)s?\b"), 1e5).otherwise(1.0)
    number = F.regexp_extract(F.regexp_replace(text, r"₹|Rs\.|Rs|INR", ""), r"(\d[\d,]*(?:\.\d+)?)", 1)
    return F.regexp_replace(F.nullif(number, F.lit("")), ",", "").try_cast("double") * times


def parse_date(text: Column) -> Column:
    """ISO date of a day-first or ISO spelling; two-digit years from 69 are 19xx."""
    t = F.trim(text)
    pivot = lambda d: F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)
    numeric = F.regexp_extract(t, r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})", 0)
    short = F.regexp_extract(t, r"^(\d{1,2})/(\d{1,2})/(\d{2})$", 0)
    named = F.regexp_replace(F.regexp_extract(t, r"\d{1,2}[ -][A-Za-z]{3}[ -]\d{4}", 0), " ", "-")
    named_short = F.regexp_extract(t, r"^\d{1,2}-[A-Za-z]{3}-\d{2}$", 0)
    long = F.regexp_extract(t, r"\d{1,2} [A-Za-z]{4,9} \d{4}", 0)
    found = [
        F.try_to_date(F.regexp_extract(t, r"\d{4}-\d{2}-\d{2}", 0), "yyyy-MM-dd"), F.try_to_date(F.regexp_replace(numeric, r"[/.]", "-"), "d-M-yyyy"), F.try_to_date(named, "d-MMM-yyyy"),
        F.try_to_date(long, "d MMMM yyyy"), pivot(F.try_to_date(short, "d/M/yy")), pivot(F.try_to_date(named_short, "d-MMM-yy")),
    ]
    return F.date_format(F.coalesce(*found), "yyyy-MM-dd")


def parse_pdf_date(text: Column) -> Column:
    """Timestamp of D:YYYYMMDDHHmmSS, read as UTC; null if malformed."""
    return F.try_to_timestamp(F.regexp_extract(text, r"^D:(\d{14})", 1), F.lit("yyyyMMddHHmmss"))


def micros(t: Column) -> Column:
    """Microseconds since 1970; timestamps without zone count as the session's."""
    return F.unix_micros(t.cast("timestamp"))


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days, rounded down also when negative."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(86_400_000_000)).cast("long")


def _permutations() -> list[list[int]]:
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([fixed.VERHOEFF_STEP[x] for x in rows[-1]])
    return rows


def _dihedral() -> list[list[int]]:
    def times(a: int, b: int) -> int:
        if a < 5:
            return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
        return 5 + (a - b) % 5 if b < 5 else (a - b) % 5

    return [[times(a, b) for b in range(10)] for a in range(10)]


def verhoeff_valid(digits: Column) -> Column:
    """Checksum of the dihedral group over reversed digits; null for other text."""
    d, p = (F.array(*(F.array(*map(F.lit, row)) for row in t)) for t in (_dihedral(), _permutations()))
    rev = F.transform(F.split(F.reverse(digits), ""), lambda c: c.try_cast("int"))
    c = F.aggregate(F.transform(rev, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), F.lit(0), lambda acc, v: d[acc][p[(v["i"] % 8)][v["x"]]])
    return F.when(digits.rlike(r"^\d+$"), c == 0)


def validate_pan(pan: Column) -> Column:
    """struct(valid, normalized, holder_type, reason); the reason is ok, empty, bad format or invalid holder type."""
    norm = F.nullif(F.upper(F.regexp_replace(pan, r"\s+", "")), F.lit(""))
    holders = F.create_map(*(F.lit(x) for kv in fixed.PAN_HOLDERS.items() for x in kv))
    shaped = norm.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$")
    holder = F.when(shaped, F.try_element_at(holders, F.substring(norm, 4, 1)))
    reason = F.when(norm.isNull(), "empty").when(~shaped, "bad format").when(holder.isNull(), "invalid holder type").otherwise("ok")
    return F.struct(holder.isNotNull().alias("valid"), norm.alias("normalized"), holder.alias("holder_type"), reason.alias("reason"))


def validate_aadhaar(number: Column) -> Column:
    """struct(valid, masked, checksum_verified)."""
    raw = F.regexp_replace(number, r"[\s-]", "")
    masked = raw.rlike("[X*x]")
    full = raw.rlike(r"^\d{12}$")
    low = F.substring(raw, 1, 1).isin("0", "1")
    valid = F.when(F.coalesce(raw, F.lit("")) == "", False).when(masked, (F.length(raw) == 12) & raw.rlike(r"\d{4}$")).when(~full | low, False).otherwise(F.coalesce(verhoeff_valid(raw), F.lit(False)))
    return F.struct(valid.alias("valid"), F.coalesce(masked, F.lit(False)).alias("masked"), F.coalesce(~masked & full, F.lit(False)).alias("checksum_verified"))


def validate_ifsc(code: Column) -> Column:
    """struct(valid, normalized, bank_code)."""
    norm = F.nullif(F.upper(F.regexp_replace(code, r"\s+", "")), F.lit(""))
    ok = F.coalesce(norm.rlike("^[A-Z]{4}0[A-Z0-9]{6}$"), F.lit(False))
    return F.struct(ok.alias("valid"), norm.alias("normalized"), F.when(ok, F.substring(norm, 1, 4)).alias("bank_code"))


def norm_name(name: Column) -> Column:
    """Upper-case letters and single blanks without honorifics; null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(name, fixed.HONORIFICS, ""), "[^A-Za-z ]", " ")
    return F.nullif(F.upper(F.trim(F.regexp_replace(bare, r"\s+", " "))), F.lit(""))


def norm_id(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")


def mask_pan(text: Column) -> Column:
    return F.regexp_replace(text, r"\b([A-Z]{2})[A-Z]{3}[0-9]{4}([A-Z])\b", "$1*******$2")


def mask_accounts(text: Column) -> Column:
    """Runs of 9 to 18 digits keep their last 4: each digit of such a run that 4 more follow becomes a star."""
    return F.regexp_replace(text, r"(?:\b(?=\d{9,18}\b)|\G(?<=\d))\d(?=\d{4})", "*")


def mask_property_ids(text: Column) -> Column:
    return F.regexp_replace(text, r"\b([A-Z]{2})-\d{1,4}/\d{1,3}[A-Z]?\b", "$1-***")


def redact_text(text: Column) -> Column:
    return mask_property_ids(mask_accounts(mask_pan(text)))


def mask_whole(value: Column) -> Column:
    """The first character and stars, or one star for a single character; a PAN keeps its own mask."""
    return F.when(value.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"), mask_pan(value)).when(value == "", value).when(F.length(value) == 1, "*").otherwise(F.concat(F.substring(value, 1, 1), F.repeat(F.lit("*"), F.length(value) - 1)))


def pct_diff(a: Column, b: Column) -> Column:
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top < 1, 0.0).otherwise(F.abs(a - b) / top)


def emi(principal: Column, months: Column, rate: float = fixed.ANNUAL_RATE) -> Column:
    r = rate / 12.0
    if r <= 0:
        return principal / months
    f = F.pow(F.lit(1 + r), months)
    return principal * r * f / (f - 1)


def max_principal(affordable: Column, months: Column, rate: float = fixed.ANNUAL_RATE) -> Column:
    r = rate / 12.0
    f = F.pow(F.lit(1 + r), months)
    return F.when(affordable <= 0, 0.0).otherwise(affordable * months if r <= 0 else affordable * (f - 1) / (r * f))


def by_severity(severity: Column, which: int) -> Column:
    """Rank (0) or penalty (1) of a severity."""
    out = F.lit(0) if which == 0 else F.lit(0.0)
    for name, values in fixed.SEVERITIES.items():
        out = F.when(severity == name, F.lit(values[which])).otherwise(out)
    return out


def model_severity(p: Column) -> Column:
    return F.when(p >= 0.8, "high").when(p >= 0.5, "medium").when(p >= 0.2, "low").otherwise("info")


def region_severity(strength: Column) -> Column:
    return F.when(strength >= 0.66, "high").when(strength >= 0.33, "medium").otherwise("low")


def edit_within_one(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def digit_runs(text: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(text, F.lit(r"(\d[\d,]*)"), 1), lambda x: F.regexp_replace(x, ",", ""))
    return F.array_distinct(F.filter(runs, lambda x: F.length(x) >= 4))


def safe_name(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "[^A-Za-z0-9._-]", "_")


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def overlaps(a: str, b: str) -> Column:
    """Strict rectangle intersection of column groups {a}_x0.. and {b}_x0.."""
    c = F.col
    return (c(f"{a}_x0") < c(f"{b}_x1")) & (c(f"{b}_x0") < c(f"{a}_x1")) & (c(f"{a}_y0") < c(f"{b}_y1")) & (c(f"{b}_y0") < c(f"{a}_y1"))


def hash_bucket(text: Column, buckets: int = 100) -> Column:
    """SHA-1 of a text as an integer modulo buckets, digit by digit."""
    digits = F.transform(F.split(F.sha1(text.cast("binary")), ""), lambda h: F.conv(h, 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda acc, d: (acc * 16 + d) % buckets)


def parse_iso(text: Column) -> Column:
    """Timestamp of an ISO 8601 text, read as UTC where it names no zone; null if malformed."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def money_text(amount: Column) -> Column:
    """``Rs. 1,234``, cut to whole rupees; N/A without an amount."""
    return F.coalesce(F.concat(F.lit("Rs. "), F.format_number(amount.cast("bigint"), 0)), F.lit("N/A"))


def tax(income: Column) -> Column:
    return income * F.when(income > 1_500_000, 0.18).otherwise(0.10)


def host_of(url: Column) -> Column:
    """Lower-case host without credentials and port."""
    rest = F.split_part(F.lower(url), F.lit("/"), F.lit(3))
    return F.split_part(F.split_part(rest, F.lit("@"), F.lit(-1)), F.lit(":"), F.lit(1))


def verhoeff_digit(digits: Column) -> Column:
    """The check digit that makes these digits valid; null for other text."""
    d, p = (F.array(*(F.array(*map(F.lit, row)) for row in t)) for t in (_dihedral(), _permutations()))
    inverse = F.array(*(F.lit(next(j for j in range(10) if row[j] == 0)) for row in _dihedral()))
    rev = F.transform(F.split(F.reverse(digits), ""), lambda c: c.try_cast("int"))
    c = F.aggregate(F.transform(rev, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), F.lit(0), lambda acc, v: d[acc][p[((v["i"] + 1) % 8)][v["x"]]])
    return F.when(digits.rlike(r"^\d+$"), inverse[c])


def redact_mapping(value: Column, kind: T.DataType, name: str = "") -> Column:
    """A nested value with texts redacted; values under names of persons or identifiers are masked whole (``***`` unless text)."""
    whole = name.lower() in fixed.PII_NAMES
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(redact_mapping(value[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: redact_mapping(x, kind.elementType, name))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: F.when(F.lower(k.cast("string")).isin(*fixed.PII_NAMES), mask_whole(v) if isinstance(kind.valueType, T.StringType) else v).otherwise(redact_mapping(v, kind.valueType, name)))
    if isinstance(kind, T.StringType):
        return mask_whole(value) if whole else redact_text(value)
    return F.when(value.isNotNull(), F.lit("***")) if whole else value
