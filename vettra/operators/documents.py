"""Document operators: classification, field extraction, structural checks, overlap joins, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettra.functions import fixed, scalars
from vettra.operators.ordered import one_per


def classify(docs: DataFrame, key: str, text: str, lexicon: dict[str, dict[str, int]] = fixed.LEXICON, least: int = 2) -> DataFrame:
    """(key, doc_type, score, confidence): the class with the highest sum of weights of contained keywords, ties to the first."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # one pass over the text: a fixed number of substring tests, no join
    scores = F.array(*(sum((F.when(low.contains(k), w).otherwise(0) for k, w in words.items()), F.lit(0)) for words in lexicon.values()))
    names = F.array(*map(F.lit, lexicon))
    best = docs.select(key, scores.alias("scores")).withColumn("score", F.array_max("scores"))
    ranked = F.sort_array("scores", asc=False)
    strength = F.col("score") / (F.col("score") + 3.0)
    margin = (F.col("score") - ranked[1]) / F.col("score")
    known = F.col("score") >= least
    return best.select(
        key,
        F.when(known, F.element_at(names, F.array_position("scores", F.col("score")).cast("int"))).otherwise("other").alias("doc_type"),
        "score",
        F.when(known, F.round(F.least(F.lit(1.0), strength * (0.5 + 0.5 * margin)), 3)).otherwise(0.0).alias("confidence"),
    )


def labelled(text: Column, label: str, value: str) -> Column:
    """The value behind a label, null if it isn't there."""
    return F.nullif(F.regexp_extract(text, rf"(?is){label}\s*:\s*({value})", 1), F.lit(""))


def identity_fields(text: Column) -> dict[str, Column]:
    return {"name": labelled(text, "Name", r"[A-Za-z][A-Za-z .]*"), "pan": labelled(text, "PAN", "[A-Z]{5}[0-9]{4}[A-Z]"), "dob": labelled(text, "DOB", r"\d{2}/\d{2}/\d{4}")}


def income_fields(text: Column) -> dict[str, Column]:
    """Stated gross and tax; the PAN falls back to the last one anywhere in the text."""
    pans = F.regexp_extract_all(text, F.lit(r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"), 1)
    money = lambda label: F.regexp_replace(labelled(text, label, r"(?:Rs\.?\s*)?[\d,]+(?:\.\d+)?"), r"Rs\.?\s*|,", "").try_cast("double")
    return {"gross": money("Gross Salary"), "tax": money("Tax Deducted"), "pan": F.coalesce(labelled(text, "PAN", "[A-Z]{5}[0-9]{4}[A-Z]"), F.when(F.size(pans) > 0, F.element_at(pans, -1)))}


def credit_series(text: Column) -> dict[str, Column]:
    """All salary credits, the first one, and their mean over twelve months."""
    credits = F.transform(F.regexp_extract_all(text, F.lit(r"SALARY CREDIT\s+([\d,.]+)"), 1), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    mean = F.aggregate(credits, F.lit(0.0), lambda a, x: a + x) / F.size(credits)
    return {"n_credits": F.size(credits), "first_credit": F.when(F.size(credits) > 0, credits[0]), "implied_annual": F.when(F.size(credits) > 0, mean * 12)}


def suspicious_producer(*names: Column) -> Column:
    return sum((F.lower(F.coalesce(n, F.lit(""))).contains(k).cast("int") for n in names for k in fixed.SUSPICIOUS_PRODUCERS), F.lit(0)) > 0


def marker_count(text: Column, marker: str) -> Column:
    """Occurrences of a literal marker."""
    return (F.size(F.split(text, "\\Q" + marker + "\\E", -1)) - 1).cast("int")


def dominant(df: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    """(key, dominant, n, minority): the most frequent value, ties to the first met, and the others joined."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("at"))
    top = one_per(counts, [key], F.desc("n"), "at", value).select(key, F.col(value).alias("dominant"), F.col("n"))
    rest = counts.join(top.select(key, F.col("dominant").alias(value)), [key, value], "left_anti").groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(value)), ",").alias("minority"))
    return top.join(rest, key, "left").withColumn("minority", F.coalesce("minority", F.lit("")))


def covered_spans(rects: DataFrame, spans: DataFrame, key: str, least: float = 0.30) -> DataFrame:
    """(key, rect, span): for each rectangle the first span of its page that it covers by more than `least`."""
    both = rects.join(spans, key)
    w = F.least("r_x1", "s_x1") - F.greatest("r_x0", "s_x0")
    h = F.least("r_y1", "s_y1") - F.greatest("r_y0", "s_y0")
    area = (F.col("s_x1") - F.col("s_x0")) * (F.col("s_y1") - F.col("s_y0"))
    hit = both.where((w > 0) & (h > 0) & (area > 0)).where(w * h / area > least)
    return one_per(hit, [key, "rect"], "span").select(key, "rect", "span")


def hidden_tokens(layer: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Layer tokens that no recognised token explains: equal or one edit away, unless it is another token of the layer."""
    other = layer.select(key, F.col("token").alias("seen")).withColumn("is_layer", F.lit(True))
    recognised = seen.select(key, F.col("token").alias("seen")).distinct().join(other.distinct(), [key, "seen"], "left")
    pairs = layer.select(key, "token").distinct().join(recognised, key)
    near = scalars.edit_within_one(F.col("token"), F.col("seen"))
    explained = pairs.where((F.col("token") == F.col("seen")) | (near & F.col("is_layer").isNull())).select(key, "token").distinct()
    return layer.select(key, "token").distinct().join(explained, [key, "token"], "left_anti")


def verdict(regions: DataFrame, key: str) -> DataFrame:
    """(key, n_regions, risk, verdict) from the severities of an image's regions."""
    base = F.element_at(F.array(*(F.lit(x) for x in (0.0, 0.15, 0.45, 0.85, 1.0))), F.max(scalars.by_severity(F.col("severity"), 0)) + 1)
    out = regions.groupBy(key).agg(F.count(F.lit(1)).alias("n_regions"), base.alias("base"))
    risk = F.round(F.least(F.lit(1.0), F.col("base") + 0.05 * (F.col("n_regions") - 1)), 3)
    return out.select(key, "n_regions", risk.alias("risk"), F.when(risk >= 0.66, "EDITED").when(risk >= 0.33, "SUSPICIOUS").otherwise("CLEAN").alias("verdict"))


def near_names(rows: DataFrame, group: str, key: str, name: str) -> DataFrame:
    """(group, a, b, n_a, n_b): names of one group within one edit of each other, each by its least key and with its number of rows; a name with itself once it has two.

    Distinct names meet on themselves and on what is left after deleting any one character: names within one edit share such a
    variant, so that no group is compared all with all, and rows of one name aren't paired.
    """
    names = rows.where(F.col(name).isNotNull()).groupBy(F.col(group).alias("g"), F.col(name).alias("name")).agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n"))
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1))), lambda i: F.concat(F.substring("name", F.lit(1), i - 1), F.substring("name", i + 1, F.length("name"))))
    variants = names.withColumn("v", F.explode(F.array_distinct(F.array_append(cut, F.col("name")))))
    left, right = (variants.select("g", "v", F.col("name").alias(f"name_{k}"), F.col("least").alias(k), F.col("n").alias(f"n_{k}")) for k in ("a", "b"))
    met = left.join(right, ["g", "v"]).where((F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("n_a") > 1))).drop("v").distinct()
    return met.where(scalars.edit_within_one(F.col("name_a"), F.col("name_b"))).select(F.col("g").alias(group), "a", "b", "n_a", "n_b")


def near_rows(rows: DataFrame, group: str, key: str, name: str) -> DataFrame:
    """(a, b): all pairs a < b of rows of one group whose names are equal or one edit apart, from the pairs of names and the rows of each."""
    names = near_names(rows, group, key, name).select(F.col(group).alias("g"), F.col("a").alias("p"), F.col("b").alias("q"))
    own = rows.where(F.col(name).isNotNull()).select(F.col(group).alias("g"), F.col(name).alias("name"), F.col(key).alias("k"))
    members = own.join(own.groupBy("g", "name").agg(F.min("k").alias("least")), ["g", "name"]).select("g", "least", "k")
    one, other = members.select("g", F.col("least").alias("p"), F.col("k").alias("x")), members.select("g", F.col("least").alias("q"), F.col("k").alias("y"))
    pairs = names.join(one, ["g", "p"]).join(other, ["g", "q"]).where((F.col("p") != F.col("q")) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
