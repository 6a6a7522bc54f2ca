"""Queries over structural and grid findings, registries, scans, and what reviewers and reports ask."""

from __future__ import annotations

from pyspark.sql import functions as F

from vettra.functions import fixed, scalars
from vettra.operators import documents as ops
from vettra.operators import evaluation, forensics, grids, linkage, pixels, review
from vettra.operators import evidence as ev
from vettra.plans import lending, packets, view
from vettra.plans.documents import _BOX_SQL, _boxes, lit
from vettra.sources.shared import written
from vettra.sources.tables import load_files, table, text_or_ocr

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- structural findings: an order is a document, its lines are spans, images and pages
_FONTS = {"A": "Helvetica-Bold", "N": "TimesNewRomanPS-BoldMT", "R": "Arial"}


def _structural(spark, sf):
    lines = table(spark, sf, "lineitem").withColumns({"doc": F.col("l_orderkey"), "page": F.when(F.col("l_linestatus") == "O", 1).otherwise(2)})
    font = F.lit(None).cast("string")
    for flag, name in _FONTS.items():
        font = F.when(F.col("l_returnflag") == flag, name).otherwise(font)
    spans = lines.select("doc", "page", F.col("l_linenumber").alias("place"), F.lit("x").alias("text"), font.alias("font"), F.col("l_quantity").alias("size"))
    images = lines.select("doc", "page", F.col("l_suppkey").alias("xref"), F.floor(F.col("l_partkey") / 100).cast("string").alias("sha256"))
    covered = ops.covered_spans(_boxes(spark, sf, "r", "rect"), _boxes(spark, sf, "s", "span"), "page").select(F.col("page").alias("doc"), F.lit(1).alias("page"), "rect")
    eof = lines.groupBy("doc").agg(F.count(F.lit(1)).alias("eof_count")).where("eof_count > 6").withColumn("eof_count", F.col("eof_count") - 5)
    price = F.floor("l_extendedprice").cast("string")
    hidden = lines.where("l_tax >= 0.08").select("doc", "page", price.alias("token"))
    pages = lines.groupBy("doc", "page").agg((F.count(F.lit(1)) * 15).alias("ocr_chars"))
    return forensics.document_findings(
        forensics.whitebox_findings(covered), forensics.font_findings(spans), forensics.duplicate_image_findings(images), forensics.incremental_findings(eof), forensics.reocr_findings(hidden, pages)
    )


_STRUCTURAL = f"""WITH lines AS (SELECT *, l_orderkey AS doc, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS page FROM lineitem),
r AS (SELECT l_orderkey AS p, l_linenumber AS rect, {_BOX_SQL['r']} FROM lineitem), s AS (SELECT l_orderkey AS p, l_linenumber AS span, {_BOX_SQL['s']} FROM lineitem),
covered AS (SELECT DISTINCT p AS doc, rect FROM (SELECT *, least(r_x1, s_x1) - greatest(r_x0, s_x0) AS w, least(r_y1, s_y1) - greatest(r_y0, s_y0) AS h FROM r JOIN s USING (p)) WHERE w > 0 AND h > 0 AND w * h / 72.0 > 0.3),
spans AS (SELECT doc, page, l_linenumber AS place, CASE l_returnflag WHEN 'A' THEN 'helvetica' WHEN 'N' THEN 'timesnewromanpsbold' ELSE 'arial' END AS base FROM lines WHERE l_quantity BETWEEN 8 AND 20),
counts AS (SELECT doc, page, base, count(*) AS n, min(place) AS met FROM spans GROUP BY ALL),
ranked AS (SELECT *, first_value(base) OVER (PARTITION BY doc, page ORDER BY n DESC, met, base) AS top FROM counts),
suspect AS (SELECT doc, page, count(*) AS k FROM ranked WHERE base <> top AND ((top IN ('helvetica', 'arial') AND base LIKE 'times%') OR (base <> 'helvetica' AND NOT starts_with(base, left(top, 4)))) GROUP BY doc, page),
images AS (SELECT doc, page, l_suppkey AS xref, (l_partkey // 100) AS sha FROM lines),
twice AS (SELECT doc FROM images GROUP BY doc, sha HAVING count(*) > 1 UNION SELECT doc FROM images GROUP BY doc, page, xref HAVING count(*) > 1),
pages AS (SELECT doc, page FROM lines GROUP BY doc, page HAVING count(*) * 15 >= 40),
facts AS (SELECT doc, 1 AS page, 1 AS part, 'high' AS severity, 'White-box edit detected (covered text)' AS title, 0.88::DOUBLE AS confidence, count(*) AS n FROM covered GROUP BY doc
  UNION ALL SELECT doc, page, 2, 'high', 'Font inconsistency in body text', 0.85, k FROM suspect
  UNION ALL SELECT doc, NULL, 3, 'medium', 'Duplicate image objects detected (copy-paste signal)', 0.80, 1 FROM twice
  UNION ALL SELECT doc, NULL, 4, 'medium', 'Incremental update detected', 0.92, count(*) - 5 FROM lines GROUP BY doc HAVING count(*) > 6
  UNION ALL SELECT doc, page, 5, 'high', 'Visible text differs from the text layer', 0.85, count(DISTINCT floor(l_extendedprice)) FROM lines JOIN pages USING (doc, page) WHERE l_tax >= 0.08 GROUP BY doc, page),
findings AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY part, page NULLS FIRST, title) AS seq FROM facts)"""


@query(_STRUCTURAL + " SELECT doc, page::INTEGER AS page, severity, title, confidence, n::INTEGER AS n, seq FROM findings")
def document_findings(spark, sf):
    return _structural(spark, sf).select("doc", "page", "severity", "title", "confidence", "n", "seq")


@query(_STRUCTURAL + """, placed AS (SELECT * FROM findings WHERE page IS NOT NULL), first AS (SELECT doc, arg_min(page, seq) AS page FROM placed GROUP BY doc), boxes AS (SELECT doc, page, sum(n) AS n FROM placed JOIN first USING (doc, page) GROUP BY ALL)
SELECT o_orderkey AS doc, page::INTEGER AS page, coalesce(n, 0)::INTEGER AS n_boxes, coalesce(n, 0) > 0 AS edited FROM orders LEFT JOIN boxes ON doc = o_orderkey""")
def packet_documents_view(spark, sf):
    return review.packet_view(table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc")), _structural(spark, sf))


@query(_STRUCTURAL + """, methods AS (SELECT *, CASE WHEN part IN (1, 2) THEN 'pixel' ELSE 'semantic' END AS method FROM findings)
SELECT doc, title, method FROM methods QUALIFY row_number() OVER (PARTITION BY doc ORDER BY method = 'semantic' DESC, CASE severity WHEN 'high' THEN 3 ELSE 2 END DESC, n DESC, seq) = 1""")
def primary_finding(spark, sf):
    f = _structural(spark, sf).withColumn("method", review.method_of(F.when(F.col("part").isin(1, 2), "ela"), F.when(~F.col("part").isin(1, 2), "semantic").otherwise("forensic"))).withColumnRenamed("n", "n_regions")
    return review.primary(f, "doc", "semantic").select("doc", "title", "method")


@query(_STRUCTURAL + """, raster AS (SELECT l_orderkey AS doc, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS page, CASE WHEN l_discount >= 0.09 THEN 'critical' ELSE 'low' END AS severity FROM lineitem WHERE l_returnflag = 'R'),
scanned AS (SELECT doc, page FROM lines GROUP BY doc, page HAVING count(*) * 15 < 40), merged AS (SELECT doc, severity FROM findings UNION ALL SELECT doc, severity FROM raster JOIN scanned USING (doc, page)),
a AS (SELECT doc, count(*) AS n_regions, max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS s FROM merged GROUP BY doc),
k AS (SELECT doc, n_regions, round(least(1.0, [0.0, 0.15, 0.45, 0.85, 1.0][s + 1]::DOUBLE + 0.05::DOUBLE * (n_regions - 1)), 3) AS risk FROM a) SELECT *, CASE WHEN risk >= 0.66 THEN 'EDITED' WHEN risk >= 0.33 THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS verdict FROM k""")
def document_verdict(spark, sf):
    lines = table(spark, sf, "lineitem").withColumns({"doc": F.col("l_orderkey"), "page": F.when(F.col("l_linestatus") == "O", 1).otherwise(2)})
    raster = lines.where("l_returnflag = 'R'").select("doc", "page", F.when(F.col("l_discount") >= 0.09, "critical").otherwise("low").alias("severity"))
    pages = lines.groupBy("doc", "page").agg((F.count(F.lit(1)) * 15).alias("chars"))
    return ops.verdict(forensics.merged_findings(_structural(spark, sf), raster, pages, "doc"), "doc")


_FONT_CASES = "(VALUES ('A', 'Helvetica-Bold', 'helvetica'), ('N', 'TimesNewRomanPS-BoldMT', 'timesnewromanpsbold'), ('R', 'Arial', 'arial'))"


@query(f"""SELECT l_orderkey AS doc, l_linenumber AS line, base, base IN ('timesnewromanpsbold') AS serif, base IN ('helvetica', 'arial') AS sans,
  CASE WHEN l_extendedprice >= 1000 THEN floor(l_extendedprice)::BIGINT::VARCHAR END AS money, 'Rs. ' || trim(format('{{:,}}', floor(l_extendedprice)::BIGINT)) AS shown FROM lineitem JOIN {_FONT_CASES} f(flag, font, base) ON flag = l_returnflag""")
def font_and_money_tokens(spark, sf):
    font = F.create_map(*(F.lit(x) for kv in _FONTS.items() for x in kv))
    base, shown = forensics.font_base(font[F.col("l_returnflag")]), F.concat(F.lit("Rs. "), F.format_number(F.floor("l_extendedprice"), 0))
    money = F.try_element_at(F.map_keys(forensics.sensitive_money(F.concat(F.lit("paid "), shown, F.lit(" and Rs. 12")))), F.lit(1))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), base.alias("base"), forensics.holds(base, fixed.SERIF_WORDS).alias("serif"), forensics.holds(base, fixed.SANS_WORDS).alias("sans"), money.alias("money"), shown.alias("shown"))


# ---- grid findings: embeddings as 8 x 8 blocks
_REACH = """reach AS (SELECT vec_id, gy, gx, gy AS ry, gx AS rx FROM marked UNION SELECT m.vec_id, m.gy, m.gx, r.ry, r.rx FROM reach r JOIN marked m ON m.vec_id = r.vec_id AND abs(m.gy - r.gy) + abs(m.gx - r.gx) = 1),
roots AS (SELECT vec_id, gy, gx, min(ry * 8 + rx) AS root FROM reach GROUP BY ALL),
regions AS (SELECT vec_id, root, count(*) AS n, min(gy) AS y0, min(gx) AS x0, max(gy) AS y1, max(gx) AS x1, avg(v) AS mean, any_value(level) AS level FROM roots JOIN marked USING (vec_id, gy, gx) GROUP BY vec_id, root)"""
_CELLS = "cells AS (SELECT vec_id, (i // 8)::INTEGER AS gy, (i % 8)::INTEGER AS gx, v::DOUBLE AS v FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings))"


@query(f"""WITH RECURSIVE {_CELLS}, b AS (SELECT vec_id, gy, gx, CASE WHEN v > -0.25 THEN 40 * abs(v) END AS sigma FROM cells),
st AS (SELECT vec_id, count(*) AS total, count(sigma) AS valid, median(sigma) AS mid FROM b GROUP BY 1),
marked AS (SELECT vec_id, gy, gx, sigma AS v, mid * 0.5 AS level FROM b JOIN st USING (vec_id) WHERE valid >= 8 AND mid >= 2.2 AND sigma < mid * 0.5), {_REACH},
kept AS (SELECT *, count(*) OVER (PARTITION BY vec_id) AS k FROM regions WHERE n >= 2 AND n <= 0.2 * 64)
SELECT vec_id, (root // 8)::INTEGER AS root_y, (root % 8)::INTEGER AS root_x, n::INTEGER AS n, y0, x0, y1, x1, round(greatest(0.0, least(1.0, (level - mean) / level)), 3) AS strength FROM kept WHERE k <= 3""")
def noise_flat_regions(spark, sf):
    b = grids.cells(table(spark, sf, "embeddings"), "vec_id", "embedding", 8).select("vec_id", "gy", "gx", F.when(F.col("v") > -0.25, 40 * F.abs("v")).alias("sigma"))
    return forensics.noise_regions(b, "vec_id", least=2, most=0.2)


@query(f"""WITH RECURSIVE {_CELLS}, b AS (SELECT vec_id, gy, gx, 200 + 320 * v AS mean, 32 * abs(v) AS std FROM cells),
paper AS (SELECT vec_id, avg((mean > 225)::INTEGER) AS white FROM b GROUP BY 1), p AS (SELECT b.* FROM b JOIN paper USING (vec_id) WHERE white >= 0.2),
st AS (SELECT vec_id, median(mean) FILTER (std < 4) AS level FROM p GROUP BY 1),
marked AS (SELECT vec_id, gy, gx, mean AS v, level FROM p JOIN st USING (vec_id) WHERE std < 4 AND mean > 70 AND mean < 242 AND abs(mean - level) > 12), {_REACH}
SELECT vec_id, (root // 8)::INTEGER AS root_y, (root % 8)::INTEGER AS root_x, n::INTEGER AS n, y0, x0, y1, x1, round(least(1.0, abs(mean - level) / 60.0), 3) AS strength FROM regions WHERE n >= 2 AND n <= 0.3 * 64""")
def flat_fill_regions(spark, sf):
    b = grids.cells(table(spark, sf, "embeddings"), "vec_id", "embedding", 8).select("vec_id", "gy", "gx", (200 + 320 * F.col("v")).alias("mean"), (32 * F.abs("v")).alias("std"))
    pages = b.groupBy("vec_id").agg(F.avg((F.col("mean") > 225).cast("int")).alias("white_share")).withColumn("noise_mid", F.lit(None).cast("double"))
    return forensics.fill_regions(b, pages, "vec_id", white=0.2, least=2, most=0.3)


@query(f"""WITH {_CELLS} SELECT vec_id, gy, gx, greatest(0, floor(v / nullif(max(v) OVER (PARTITION BY vec_id), 0) * 255))::INTEGER AS heat FROM cells""")
def heat_map(spark, sf):
    return forensics.heat(grids.cells(table(spark, sf, "embeddings"), "vec_id", "embedding", 8), "vec_id").select("vec_id", "gy", "gx", F.greatest("heat", F.lit(0)).alias("heat"))


_DETECTORS = ["noise", "ela", "flat_fill", "copy_move", "jpeg_ghost"]


@query(f"""WITH r AS (SELECT l_orderkey AS image, [{', '.join(map(lit, _DETECTORS))}][(l_linenumber - 1) % 5 + 1] AS detector, (l_partkey * 10 + l_linenumber)::BIGINT AS region, l_discount * 10 AS strength, {_BOX_SQL['r']} FROM lineitem),
o AS (SELECT a.image, a.region, a.detector, a.strength, bool_or(b.detector = 'noise') AS noise, bool_or(b.detector = 'ela') AS ela, bool_or(b.detector = 'copy_move') AS clone
  FROM (SELECT *, row_number() OVER () AS rn FROM r) a LEFT JOIN r b ON a.image = b.image AND b.r_x0 < a.r_x1 AND a.r_x0 < b.r_x1 AND b.r_y0 < a.r_y1 AND a.r_y0 < b.r_y1 GROUP BY a.rn, a.image, a.region, a.detector, a.strength),
f AS (SELECT image, detector, region, CASE detector WHEN 'noise' THEN CASE WHEN strength >= 0.5 OR ela THEN 'high' ELSE 'medium' END WHEN 'flat_fill' THEN CASE WHEN NOT noise AND NOT ela THEN CASE WHEN clone THEN 'high' ELSE 'medium' END END
  WHEN 'ela' THEN CASE WHEN NOT noise THEN CASE WHEN strength >= 0.66 THEN 'high' WHEN strength >= 0.33 THEN 'medium' ELSE 'low' END END WHEN 'copy_move' THEN CASE WHEN noise OR ela THEN 'high' END ELSE CASE WHEN noise OR ela THEN 'medium' END END AS severity,
  (CASE detector WHEN 'noise' THEN CASE WHEN ela THEN 0.7 ELSE 0.6 END WHEN 'flat_fill' THEN 0.55 WHEN 'copy_move' THEN 0.8 ELSE 0.6 END)::DOUBLE AS confidence FROM o) SELECT * FROM f WHERE severity IS NOT NULL""")
def corroborated_regions(spark, sf):
    kind = F.array(*map(F.lit, _DETECTORS))[(F.col("l_linenumber") - 1) % 5]
    extra = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")
    c = lambda e: F.expr(f"cast({e} AS double)")
    r = extra.select(F.col("l_orderkey").alias("image"), kind.alias("detector"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("region"), (F.col("l_discount") * 10).alias("strength"),
                     c("l_suppkey % 40").alias("x0"), c("l_partkey % 40").alias("y0"), c("l_suppkey % 40 + 20").alias("x1"), c("l_partkey % 40 + 10").alias("y1"))
    return forensics.corroborated(r, "image")


# ---- registries: nations, regions and suppliers as keyed records
@query("""WITH income AS (SELECT n_nationkey AS k, n_regionkey * 100000.0 AS reported FROM nation WHERE n_nationkey < 20),
legal AS (SELECT s_suppkey AS k, s_name AS legal_name FROM supplier WHERE s_acctbal > 0), firms AS (SELECT s_suppkey AS k, CASE WHEN s_acctbal > 5000 THEN 'Active' ELSE 'Struck off' END AS status FROM supplier WHERE s_nationkey < 20),
owed AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_quantity >= 49 GROUP BY 1), papers AS (SELECT o_custkey AS k, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1)
SELECT c_custkey AS packet_id, reported AS income_of_record, coalesce(owed.n, 0) AS n_charges, coalesce(papers.n, 0) AS n_documents, legal_name, coalesce(lower(firms.status) = 'active', false) AS is_active, market AS market_value
FROM (SELECT *, c_custkey % (SELECT count(*) FROM supplier) AS sk FROM customer) c LEFT JOIN income ON income.k = c_nationkey LEFT JOIN owed ON owed.k = sk LEFT JOIN papers ON papers.k = c_custkey LEFT JOIN legal ON legal.k = sk LEFT JOIN firms ON firms.k = sk
LEFT JOIN (SELECT p_partkey AS k, p_retailprice AS market FROM part WHERE p_size > 10) pr ON pr.k = c_custkey""")
def registry_lookups(spark, sf):
    from vettra.sources import tables as t

    s = table(spark, sf, "supplier")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("packet_id"), "c_nationkey").crossJoin(F.broadcast(s.agg(F.count(F.lit(1)).alias("m")))).withColumn("sk", F.col("packet_id") % F.col("m"))
    registries = {
        "ais": table(spark, sf, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("pan"), (F.col("n_regionkey") * 100000.0).alias("reported_income")),
        "cersai": table(spark, sf, "lineitem").where("l_quantity >= 49").groupBy(F.col("l_suppkey").alias("pan")).agg(F.count(F.lit(1)).alias("charges")),
        "digilocker": table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("pan")).agg(F.count_distinct("o_orderpriority").alias("documents")),
        "gstin": s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("gstin"), F.col("s_name").alias("legal_name")),
        "mca21": s.where("s_nationkey < 20").select(F.col("s_suppkey").alias("cin"), F.when(F.col("s_acctbal") > 5000, "Active").otherwise("Struck off").alias("status")),
        "property_registry": table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("property_id"), F.col("p_retailprice").alias("registered_market_value")),
    }
    assert set(registries) == set(t.ADAPTERS)
    out = t.look_up(c, "c_nationkey", registries["ais"], "ais", "income_of_record")
    out = t.look_up(out, "sk", registries["cersai"], "cersai", "charges")
    out = t.look_up(out, "packet_id", registries["digilocker"], "digilocker", "documents")
    out = t.look_up(out, "sk", registries["gstin"], "gstin", "legal_name")
    out = t.look_up(out, "sk", registries["mca21"], "mca21", "is_active")
    out = t.look_up(out, "packet_id", registries["property_registry"], "property_registry", "market_value")
    return out.select("packet_id", "income_of_record", F.coalesce("charges", F.lit(0)).cast("long").alias("n_charges"), F.coalesce("documents", F.lit(0)).cast("long").alias("n_documents"), "legal_name", "is_active", "market_value")


# ---- scans, point reads and sinks
@query("""SELECT conv_id AS packet_id, role AS doc_type, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS documents FROM conversations WHERE length(trim(text)) >= 60 GROUP BY 1, 2""")
def packet_scan(spark, sf):
    docs = table(spark, sf, "conversations").select(F.col("conv_id").alias("packet_id"), F.col("turn").alias("ordinal"), F.col("turn").alias("doc_id"), F.col("role").alias("doc_type"), (F.length(F.trim("text")) >= 60).alias("ok"))
    return review.ok_by_type(docs).select("packet_id", "doc_type", F.array_join(F.col("documents").cast("array<string>"), ",").alias("documents"))


@query("""SELECT c_custkey AS k, c_name, (SELECT count(*) FROM customer) AS n_users FROM customer WHERE lower(trim(c_name)) = lower(trim(' CUSTOMER#000000007 '))""")
def point_reads(spark, sf):
    c = table(spark, sf, "customer")
    n = c.agg(F.count(F.lit(1)).alias("n"))
    return c.where(F.lower(F.trim("c_name")) == F.lower(F.trim(F.lit(" CUSTOMER#000000007 ")))).select(F.col("c_custkey").alias("k"), "c_name", n.scalar().alias("n_users"))


@query(packets.sql(*packets.DECIDED) + """ SELECT packet_id, '{"packet_id":' || packet_id || ',"action":"' || CASE WHEN trust >= 70 THEN 'approve' WHEN trust < 40 AND (has_evidence OR has_critical) THEN 'freeze' ELSE 'manual_review' END || '","chain":' || chain || '}' AS decision FROM trusted""")
def decision_documents(spark, sf):
    """The decision sink's JSON documents."""
    return packets.score_driver(spark, sf).select("packet_id", F.to_json(F.struct("packet_id", "action", "chain")).alias("decision"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, 'Rs. ' || trim(format('{:,}', trunc(value * 1000)::BIGINT)) AS money, json_extract(props, '$.k')::BIGINT AS k, regexp_replace(event_type || ' ' || user_id || '.pdf', '[^A-Za-z0-9._-]', '_', 'g') AS safe,
  CASE WHEN value >= 66 THEN 'high' WHEN value >= 33 THEN 'medium' ELSE 'low' END AS region_severity, CASE WHEN value >= 80 THEN 'high' WHEN value >= 50 THEN 'medium' WHEN value >= 20 THEN 'low' ELSE 'info' END AS model_severity,
  round(CASE WHEN value * 100000 > 1500000 THEN 0.18 ELSE 0.10 END * value * 100000, 2) AS tax FROM events""")
def scalar_misc(spark, sf):
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    share, income = F.col("value") / 100, F.col("value") * 100000
    return table(spark, sf, "events").select(
        "event_id", F.date_format(scalars.parse_iso(iso), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), scalars.money_text(F.col("value") * 1000).alias("money"), F.from_json("props", "struct<k: bigint>")["k"].alias("k"),
        scalars.safe_name(F.concat(F.lit("/up/loads/"), "event_type", F.lit(" "), F.col("user_id").cast("string"), F.lit(".pdf"))).alias("safe"), scalars.region_severity(share).alias("region_severity"), scalars.model_severity(share).alias("model_severity"),
        F.round(scalars.tax(income), 2).alias("tax"),
    )


@query("SELECT c_custkey AS k, c_nationkey <> 3 AS valid FROM customer")
def check_digits(spark, sf):
    """Every number with its generated check digit validates; those of one nation have the next digit and don't."""
    n = F.concat(F.lit("2"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"))
    digit = scalars.verhoeff_digit(n)
    valid = scalars.verhoeff_valid(F.concat(n, F.when(F.col("c_nationkey") == 3, (digit + 1) % 10).otherwise(digit).cast("string")))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), valid.alias("valid"))


@query("""SELECT event_id, '{"name":"' || substr(event_type, 1, 1) || repeat('*', length(event_type) - 1) || '","k":' || json_extract(props, '$.k') || ',"note":"call ********' || lpad((user_id % 10000)::VARCHAR, 4, '0') || '"}' AS redacted FROM events""")
def redact_mappings(spark, sf):
    note = F.concat(F.lit("call 98765432"), F.lpad((F.col("user_id") % 10000).cast("string"), 4, "0"))
    nested = F.struct(F.col("event_type").alias("name"), F.from_json("props", "struct<k: bigint>")["k"].alias("k"), note.alias("note"))
    df = table(spark, sf, "events").select("event_id", nested.alias("m"))
    return df.select("event_id", F.to_json(scalars.redact_mapping(F.col("m"), df.schema["m"].dataType)).alias("redacted"))


# ---- counts, orders and reports
@query("""SELECT lang, count(*) AS n, count_if(toxic = 1) AS fraud, round(avg(toxic), 6) AS rate, round(avg(toxic) FILTER (quality = 1), 6) AS recall_good FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def group_counts(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("fraud"), F.round(F.avg("toxic"), 6).alias("rate"), F.round(F.avg(F.when(F.col("quality") == 1, F.col("toxic"))), 6).alias("recall_good"))


_KIND = "CASE WHEN contains(lower(name), 'edited') THEN 'edited' WHEN contains(lower(name), 'original') OR contains(lower(name), 'oridinal') THEN 'original' END"


@query(f"""WITH f AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'Edited ' WHEN 1 THEN 'oridinal ' ELSE 'scan ' END || source || '.jpg' AS name, n_chars % 2 = 0 AS flagged FROM documents)
SELECT {_KIND} AS kind, count(*) AS n, count_if(flagged) AS n_flagged, round(avg(flagged::INTEGER), 6) AS rate FROM f GROUP BY 1""")
def real_anchor_rates(spark, sf):
    name = F.concat(F.when(F.col("doc_id") % 3 == 0, "Edited ").when(F.col("doc_id") % 3 == 1, "oridinal ").otherwise("scan "), "source", F.lit(".jpg"))
    f = table(spark, sf, "documents").select(review.kind_of(name).alias("kind"), (F.col("n_chars") % 2 == 0).alias("flagged"))
    return f.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("n_flagged"), F.round(F.avg(F.col("flagged").cast("int")), 6).alias("rate"))


@query(view.sql(*view.EVIDENCE) + " SELECT packet_id, category, count(*) AS n, string_agg(title, '|' ORDER BY seq) AS titles FROM evidence GROUP BY 1, 2")
def evidence_by_category(spark, sf):
    return review.by_category(view.evidence(spark, sf)).select("packet_id", "category", "n", F.array_join("titles", "|").alias("titles"))


_CLUSTERS = view.sql("edges", "degrees") + """, pans AS (SELECT app_id, value AS pan FROM edges WHERE kind = 'pan'),
clusters AS (SELECT links.kind, links.value, count(DISTINCT links.app_id) AS n_apps, count(DISTINCT pan) AS n_applicants FROM links LEFT JOIN pans USING (app_id)
  WHERE links.kind IN ('property', 'employer') GROUP BY links.kind, links.value HAVING count(DISTINCT links.app_id) >= 2 AND count(DISTINCT pan) >= 2)"""


def _clusters(spark, sf):
    e = view.stored_edges(spark, sf)
    found = [linkage.clusters(e, k).withColumn("kind", F.lit(k)) for k in ("property", "employer")]
    return e, found[0].unionByName(found[1])


@query(_CLUSTERS + " SELECT (SELECT count(DISTINCT app_id) FROM edges) AS n_apps, (SELECT t FROM threshold) AS hub_threshold, count_if(kind = 'property') AS n_property, count_if(kind = 'employer') AS n_employer, coalesce(max(n_apps), 0) AS largest FROM clusters")
def cluster_summary(spark, sf):
    return review.cluster_summary(*_clusters(spark, sf))


@query(_CLUSTERS + " SELECT kind, value, n_apps, row_number() OVER (PARTITION BY kind ORDER BY n_apps DESC, value) AS place FROM clusters QUALIFY place <= 10")
def top_n_ordered(spark, sf):
    return review.in_order(_clusters(spark, sf)[1], "n_apps", "value").where("place <= 10").select("kind", "value", "n_apps", "place")


@query(_CLUSTERS + " SELECT kind, count(*) AS n_edges, (SELECT count(*) FROM clusters c WHERE c.kind = edges.kind) AS n_clusters FROM edges GROUP BY kind")
def seed_counts(spark, sf):
    """A graph rebuilt from all applications: edges and clusters of each kind."""
    e, clusters = _clusters(spark, sf)
    edges = linkage.latest_edges(e.withColumn("version", F.lit(1))).groupBy("kind").agg(F.count(F.lit(1)).alias("n_edges"))
    n = clusters.groupBy("kind").agg(F.count(F.lit(1)).alias("n_clusters"))
    return edges.join(n, "kind", "left").select("kind", "n_edges", F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"))


@query("""SELECT o_custkey AS packet_id, l_orderkey AS finding, 'doc' || (min(o) OVER (PARTITION BY l_orderkey))::VARCHAR || '.pdf' AS filename FROM (
  SELECT o_custkey, l_orderkey, o_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_tax >= 0.05) WHERE k = 1""")
def finding_to_doc(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    name = F.concat(F.lit("doc"), F.col("o_orderkey").cast("string"), F.lit(".pdf"))
    files = o.select(F.col("o_custkey").alias("packet_id"), F.struct("o_orderdate", "o_orderkey").alias("ordinal"), name.alias("filename"))
    found = table(spark, sf, "lineitem").where("l_tax >= 0.05").select(F.col("l_orderkey").alias("o_orderkey")).distinct().join(o, "o_orderkey")
    findings = found.select(F.col("o_custkey").alias("packet_id"), F.col("o_orderkey").alias("finding"), F.concat(F.lit("page 1 of "), name).alias("location"), F.lit(None).cast("string").alias("description"))
    unnamed = found.select(F.col("o_custkey").alias("packet_id"), F.col("o_orderkey").alias("finding"), F.lit("nowhere").alias("location"), F.lit("a description").alias("description"))
    return review.findings_to_files(findings.unionByName(unnamed), files).select("packet_id", "finding", "filename")


@query("""WITH h AS (SELECT doc_id, quality = 1 AS loc FROM labels), m AS (SELECT doc_id, toxic = 1 AS loc FROM labels) SELECT doc_id, CASE WHEN NOT h.loc AND coalesce(m.loc, false) THEN 'model' ELSE 'heuristic' END AS source FROM h LEFT JOIN m USING (doc_id)""")
def escalation(spark, sf):
    f = table(spark, sf, "labels")
    by = lambda c: review.localized(f.select("doc_id", F.col(c).alias("n_regions")), "doc_id")
    return review.escalated(by("quality"), by("toxic"), "doc_id")


@query("""WITH r AS (SELECT p_type, p_brand, p_size, p_partkey FROM part), n AS (SELECT p_type, p_brand, count(DISTINCT p_size) AS n, min(p_partkey) AS met FROM r GROUP BY 1, 2)
SELECT p_type, p_brand, n FROM n QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY CASE WHEN starts_with(p_brand, 'Brand#9') THEN 0 WHEN starts_with(p_brand, 'Brand#2') THEN 1 ELSE 2 END, n DESC, met) = 1""")
def best_sources(spark, sf):
    return review.best_source(table(spark, sf, "part").withColumn("place", F.col("p_partkey")), "p_type", "p_brand", "p_size", ("Brand#9", "Brand#2"))


@query("""WITH a AS (SELECT DISTINCT p_type, p_size, 'Brand#7' AS p_brand FROM part)
SELECT p_type, p_size, coalesce((SELECT min(p_partkey) FROM part p WHERE p.p_type = a.p_type AND p.p_size = a.p_size AND p.p_brand = a.p_brand), (SELECT min(p_partkey) FROM part p WHERE p.p_type = a.p_type AND p.p_size = a.p_size)) AS record FROM a""")
def first_match_or_any(spark, sf):
    p = table(spark, sf, "part")
    asked = p.select("p_type", "p_size").distinct().withColumn("p_brand", F.lit("Brand#7"))
    records = p.select("p_type", "p_size", "p_brand", F.col("p_partkey").alias("place"), F.col("p_partkey").alias("record"))
    return review.first_match(asked, records, ["p_type", "p_size"], "p_brand").select("p_type", "p_size", "record")


@query("""WITH r AS (SELECT vec_id AS file, CASE WHEN label % 3 = 0 THEN 'clean' ELSE 'tampered' END AS label, 1 + vec_id % 3 AS boxes FROM embeddings),
pos AS (SELECT file, 'pos' AS mode, least(2, boxes) AS n FROM r WHERE label = 'tampered'), k AS (SELECT greatest(2, (2 * (SELECT sum(n) FROM pos)) // greatest(1, count(*))) AS k FROM r WHERE label = 'clean')
SELECT file, mode, n::BIGINT AS n FROM pos UNION ALL SELECT file, 'neg', k::BIGINT FROM r, k WHERE label = 'clean'""")
def patch_sampler(spark, sf):
    r = table(spark, sf, "embeddings").select(F.col("vec_id").alias("file"), F.when(F.col("label") % 3 == 0, "clean").otherwise("tampered").alias("label"), F.sequence(F.lit(1), (1 + F.col("vec_id") % 3).cast("int")).alias("boxes"))
    return review.patches(r).groupBy("file", "mode").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s_suppkey AS model, CASE WHEN s_acctbal > 5000 THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END AS threshold, CASE WHEN s_acctbal > 8000 THEN 300.0::DOUBLE WHEN s_acctbal > 5000 THEN 1000.0::DOUBLE ELSE 256.0::DOUBLE END AS area, s_acctbal > 5000 AS stored FROM supplier""")
def calibration_lookup(spark, sf):
    s = table(spark, sf, "supplier")
    stored = s.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("model"), F.lit(0.4).alias("threshold"), F.when(F.col("s_acctbal") > 8000, 300.0).otherwise(0.001).alias("area"))
    return review.calibration(s.select(F.col("s_suppkey").alias("model")), stored)


_HOSTS = ["site1.example", "site2.example", "site3.example"]


@query(f"""SELECT page_id, h AS host, h IN ({', '.join(map(lit, _HOSTS))}) AS allowed FROM (SELECT page_id, split_part(split_part(split_part(lower(url), '/', 3), '@', -1), ':', 1) AS h FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(url, '://', '://user:pw@') ELSE url END AS url FROM pages))""")
def hosts_allowed(spark, sf):
    url = F.when(F.col("page_id") % 2 == 0, F.replace("url", F.lit("://"), F.lit("://user:pw@"))).otherwise(F.col("url"))
    host = scalars.host_of(url)
    return table(spark, sf, "pages").select("page_id", host.alias("host"), host.isin(*_HOSTS).alias("allowed"))


@query(packets.sql(*packets.ENTITIES) + """, cards AS (SELECT *, CASE WHEN status = 'P' THEN left(number, 9) ELSE number END AS shown FROM typed WHERE doc_type = 'identity')
SELECT packet_id, doc_id, 'Invalid PAN number' AS title, 'high' AS severity FROM cards WHERE shown IS NOT NULL AND status = 'P'""")
def identifier_checks(spark, sf):
    """Cards whose number lost its last letter."""
    from vettra.operators import extract

    t = lending.texts(lending.documents(spark, sf)).where("doc_type = 'identity'")
    shown = F.when(F.col("status") == "P", F.regexp_replace("text", r"(ABCP[VX]\d{4})[A-Z]", "$1")).otherwise(F.col("text"))
    cards = t.withColumn("text", shown).withColumn("kyc", extract.identifiers(F.when(F.col("text").contains("PAN: "), extract.pan_card(F.col("text"))["pan"]), F.lit(None).cast("string")))
    return extract.identifier_findings(cards)


@query("""WITH p AS (SELECT o_orderkey AS doc, CASE WHEN o_orderstatus <> 'F' THEN 'id ABCPV' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || 'D end' END AS payload, 'ABCPV' || lpad((o_orderkey % 10000 + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::VARCHAR, 4, '0') || 'D' AS printed FROM orders)
SELECT doc, regexp_extract(payload, '[A-Z]{5}[0-9]{4}[A-Z]') AS in_code, printed FROM p WHERE payload IS NOT NULL AND regexp_extract(payload, '[A-Z]{5}[0-9]{4}[A-Z]') <> printed""")
def qr_cross_check(spark, sf):
    """Documents whose code carries another number than what is printed; none without a payload."""
    from vettra.operators import extract

    number = lambda n: F.concat(F.lit("ABCPV"), F.lpad(n.cast("string"), 4, "0"), F.lit("D"))
    k = F.col("o_orderkey") % 10000
    payload = F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("id "), F.lower(number(k)), F.lit(" end")))
    both = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), extract.qr_identifier(payload).alias("in_code"), number(k + (F.col("o_orderstatus") == "P").cast("int")).alias("printed"))
    return both.where(scalars.norm_id(F.col("in_code")) != scalars.norm_id(F.col("printed")))


# ---- pixels, boxes and reports
@query(f"""WITH {_CELLS} SELECT vec_id, (gy // 4)::INTEGER AS gy, (gx // 4)::INTEGER AS gx, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM cells GROUP BY ALL""")
def block_grid(spark, sf):
    out = pixels.block_grid(table(spark, sf, "embeddings").withColumn("w", F.lit(8)), "vec_id", "w", "embedding", 4)
    return out.select("vec_id", "gy", "gx", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


_TAP = lambda c, w, k: f"coalesce({'lead' if k > 0 else 'lag'}({c}, {abs(k)}) OVER {w}, {c if abs(k) == 1 else _TAP(c, w, k - 1 if k > 0 else k + 1)})"
_SMOOTH = lambda c, w: f"({_TAP(c, w, -2)} + 4 * {_TAP(c, w, -1)} + 6 * {c} + 4 * {_TAP(c, w, 1)} + {_TAP(c, w, 2)}) / 16"
_SLOPE = lambda c, w: f"coalesce(CASE WHEN lead({c}) OVER {w} IS NULL THEN {c} - lag({c}) OVER {w} WHEN lag({c}) OVER {w} IS NULL THEN lead({c}) OVER {w} - {c} ELSE (lead({c}) OVER {w} - lag({c}) OVER {w}) / 2 END, 0)"
_ACROSS, _DOWN = "(PARTITION BY vec_id, gy ORDER BY gx)", "(PARTITION BY vec_id, gx ORDER BY gy)"


@query(f"""WITH {_CELLS}, p AS (SELECT vec_id, gy, gx, 128::DOUBLE + 100::DOUBLE * v AS v FROM cells), a AS (SELECT *, {_SMOOTH('v', _ACROSS)} AS h FROM p), b AS (SELECT *, {_SLOPE('h', _ACROSS)} AS dh FROM a),
c AS (SELECT *, {_SMOOTH('h', _DOWN)} AS low, {_SMOOTH('dh', _DOWN)} AS dx FROM b), d AS (SELECT *, {_SLOPE('low', _DOWN)} AS dy FROM c),
e AS (SELECT vec_id, gy // 4 AS ty, gx // 4 AS tx, CASE WHEN sqrt(dx * dx + dy * dy) < 6 THEN v - low END AS r FROM d)
SELECT vec_id, ty::INTEGER AS gy, tx::INTEGER AS gx, CASE WHEN count(r) >= 3 THEN round(stddev_pop(r), 4) END AS sigma FROM e GROUP BY vec_id, ty, tx""")
def noise_grid(spark, sf):
    """Noise of 4 x 4 blocks of embeddings as 8 x 8 images."""
    points = grids.cells(table(spark, sf, "embeddings"), "vec_id", "embedding", 8).select("vec_id", F.col("gy").alias("y"), F.col("gx").alias("x"), (128 + 100 * F.col("v")).alias("v"))
    return pixels.noise_grid(points, "vec_id", 4).select("vec_id", "gy", "gx", F.round("sigma", 4).alias("sigma"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_reverse(embedding)::DOUBLE[] AS b, list_avg(embedding::DOUBLE[]) AS m FROM embeddings),
c AS (SELECT vec_id, list_transform(a, lambda x: x - m) AS p, list_transform(b, lambda x: x - m) AS q FROM e) SELECT vec_id, round(list_inner_product(p, q) / (sqrt(list_inner_product(p, p)) * sqrt(list_inner_product(q, q)) + 1e-6), 5) AS ncc FROM c""")
def self_correlation(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(pixels.correlation(F.col("embedding"), F.reverse("embedding")), 5).alias("ncc"))


_CORNERS = f"r AS (SELECT l_orderkey AS page, l_linenumber AS n, l_partkey AS k, {_BOX_SQL['r']} FROM lineitem)"


def _corners(spark, sf):
    c = lambda e: F.expr(f"cast({e} AS double)")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k"), (c("l_suppkey % 40")).alias("x0"), c("l_partkey % 40").alias("y0"), c("l_suppkey % 40 + 20 + l_linenumber").alias("x1"), c("l_partkey % 40 + 10").alias("y1"))


@query(f"WITH {_CORNERS} SELECT page, n, k, (r_x1 + n - r_x0) * (r_y1 - r_y0) AS area FROM r QUALIFY row_number() OVER (PARTITION BY page ORDER BY (r_x1 + n - r_x0) * (r_y1 - r_y0) DESC, n, k) = 1")
def largest_faces(spark, sf):
    return pixels.largest_box(_corners(spark, sf), "page", "n", "k").select("page", "n", "k", "area")


@query(f"WITH {_CORNERS} SELECT page, n, k, greatest(0, least(50, trunc(r_x0 * 1.5)))::INTEGER AS x0, greatest(0, least(60, trunc(r_y0 * 0.75)))::INTEGER AS y0, greatest(0, least(50, trunc((r_x1 + n) * 1.5)))::INTEGER AS x1, greatest(0, least(60, trunc(r_y1 * 0.75)))::INTEGER AS y1 FROM r")
def scaled_boxes(spark, sf):
    box = pixels.scaled_box(F.struct("x0", "y0", "x1", "y1"), F.lit(1.5), F.lit(0.75), F.lit(50), F.lit(60))
    return _corners(spark, sf).select("page", "n", "k", box.alias("b")).select("page", "n", "k", "b.*")


@query(packets.sql(*packets.FEATURES, "attributions") + " SELECT feature, round(avg(share), 6) AS importance, count(*) AS n FROM factors GROUP BY feature ORDER BY importance DESC LIMIT 10")
def feature_importance(spark, sf):
    """The ten features with the largest mean share."""
    f = packets.factors(packets.features(spark, sf)).groupBy("feature").agg(F.round(F.avg("share"), 6).alias("importance"), F.count(F.lit(1)).alias("n"))
    return f.orderBy(F.desc("importance")).limit(10)


@query("""WITH r AS (SELECT round(n_chars / 25000.0, 4) AS s, toxic = 1 AS t FROM documents JOIN labels USING (doc_id)), e AS (SELECT s, count_if(t) AS p, count_if(NOT t) AS n FROM r GROUP BY s),
u AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM e), a AS (SELECT round(sum(p * (under + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM u),
c AS (SELECT count_if(t AND s >= 0.05) AS tp, count_if(NOT t AND s >= 0.05) AS fp, count_if(NOT t AND s < 0.05) AS tn, count_if(t AND s < 0.05) AS fn FROM r)
SELECT auc, tp, fp, tn, fn, round(tp / nullif(tp + fp, 0), 6) AS prec, round(tp / nullif(tp + fn, 0), 6) AS recall, round((tp + tn) / nullif(tp + fp + tn + fn, 0), 6) AS accuracy, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM a, c""")
def roc_report(spark, sf):
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select((F.col("n_chars") / 25000).alias("score"), (F.col("toxic") == 1).alias("truth"))
    return evaluation.roc_report(j, "score", "truth", 0.05)


@query(packets.sql(*packets.DECIDED) + f""", {packets._FIRST}, {packets.VERIFIED} SELECT packet_id, 'case_' || left(sha256('packet' || chr(1) || packet_id), 12) AS case_id, penalty, final AS final_trust,
  CASE WHEN final >= 70 THEN 'approve' WHEN final < 40 AND (has_evidence OR has_critical OR penalty > 0) THEN 'freeze' ELSE 'manual_review' END AS final_action FROM folded""")
def case_submissions(spark, sf):
    """Every packet as a submitted case: scored, verified, and the verification folded into the decision."""
    docs = lending.stored_documents(spark, sf)
    e = written(lending.entities(docs), "entities")  # rules and verification each read them
    block = packets.verified(docs, e).select("packet_id", F.col("penalty").alias("points"))
    decided = ev.checked_decisions(packets.decisions(spark, sf, docs, entities=e)).join(block, "packet_id")
    out = ev.folded(decided, F.col("points"))
    return out.select("packet_id", ev.row_id("case", F.lit("packet"), "packet_id").alias("case_id"), "penalty", "final_trust", "final_action")


# ---- loading, and scalars that no other query shows
@query("""WITH p AS (SELECT conv_id, role, string_agg(text, chr(10) ORDER BY turn) AS joined, max(length(trim(text))) > 10 AS layer, count(*) AS n FROM conversations GROUP BY 1, 2)
SELECT conv_id, role, md5(CASE WHEN layer THEN joined ELSE 'recognised ' || n END) AS text_md5, CASE WHEN layer THEN 'embedded' ELSE 'ocr' END AS source FROM p""")
def document_texts(spark, sf):
    """What each side of a conversation said is a document, its turns are the pages."""
    c = table(spark, sf, "conversations").withColumn("doc", F.struct("conv_id", "role"))
    ocr = c.groupBy("doc").agg(F.concat(F.lit("recognised "), F.count(F.lit(1)).cast("string")).alias("ocr_text"))
    return text_or_ocr(c, ocr, "doc", "turn", "text").select("doc.conv_id", "doc.role", F.md5(F.col("text").cast("binary")).alias("text_md5"), "source")


@query("""WITH f AS (SELECT conv_id, min(turn) AS first, conv_id % 5 = 0 AS image, conv_id % 7 = 0 AS locked FROM conversations GROUP BY 1),
p AS (SELECT conv_id, turn, image, locked, NOT image AND length(trim(text)) >= 100 AS layer, CASE WHEN NOT image AND length(trim(text)) >= 100 THEN text ELSE 'ocr ' || text END AS t FROM conversations JOIN f USING (conv_id) WHERE NOT image OR turn = first),
g AS (SELECT conv_id, any_value(image) AS image, any_value(locked) AS locked, count(*) FILTER (NOT locked) AS n, string_agg(t, chr(10) ORDER BY turn) FILTER (NOT locked) AS text, bool_and(layer) AS every, bool_or(layer) AS partly FROM p GROUP BY 1)
SELECT conv_id, CASE WHEN image THEN 'image' ELSE 'pdf' END AS kind, md5(coalesce(text, '')) AS text_md5, n::INTEGER AS n_pages, CASE WHEN image THEN 'image-ocr' WHEN locked THEN NULL WHEN every THEN 'embedded' WHEN partly THEN 'mixed' ELSE 'ocr' END AS source,
  image OR (NOT locked AND NOT every) AS ocr_used, locked AND NOT image AS needs_password, NOT (locked AND NOT image) AND n > 0 AS ok FROM g""")
def file_loading(spark, sf):
    c = table(spark, sf, "conversations")
    first = c.groupBy("conv_id").agg(F.min("turn").alias("first"))
    files = first.select("conv_id", F.when(F.col("conv_id") % 5 == 0, "scan.v2.PNG").otherwise("file.pdf").alias("path"), (F.col("conv_id") % 7 == 0).alias("locked"))
    pages = c.join(first, "conv_id").where("conv_id % 5 <> 0 OR turn = first").select("conv_id", F.col("turn").alias("page_no"), "text", F.concat(F.lit("ocr "), F.col("text")).alias("ocr_text"))
    out = load_files(files, pages, "conv_id", 100)
    return out.select("conv_id", "kind", F.md5(F.col("text").cast("binary")).alias("text_md5"), "n_pages", "source", "ocr_used", "needs_password", "ok")


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS made, CASE WHEN o_totalprice >= 1000 THEN floor(o_totalprice)::BIGINT::VARCHAR ELSE '' END AS runs,
  CASE o_orderstatus WHEN 'P' THEN 'bad format' WHEN 'O' THEN 'invalid holder type' ELSE 'ok' END AS reason FROM orders""")
def pdf_dates_and_runs(spark, sf):
    o = table(spark, sf, "orders")
    made = F.when(F.col("o_orderstatus") == "P", "D:2024").otherwise(F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("+05'30'")))
    text = F.concat(F.lit("pay "), F.format_number(F.floor("o_totalprice"), 0), F.lit(" of "), F.format_number(F.floor("o_totalprice"), 0), F.lit(" or 12"))
    pan = F.when(F.col("o_orderstatus") == "P", "ABC").when(F.col("o_orderstatus") == "O", "ABCQV1234D").otherwise("abcpv 1234d")
    return o.select(F.col("o_orderkey").alias("k"), F.date_format(scalars.parse_pdf_date(made), "yyyy-MM-dd HH:mm:ss").alias("made"), F.array_join(scalars.digit_runs(text), ",").alias("runs"), scalars.validate_pan(pan)["reason"].alias("reason"))
