"""Driver tables as applications: customers are packets, orders their documents, lines what the documents imply.

Each function has its SQL twin in CTE.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vettra.operators import evidence as ev
from vettra.operators import linkage
from vettra.sources.shared import written, written_parts
from vettra.sources.tables import table

AS_OF = "2001-01-01"

CTE = {
    "docs": """docs AS (SELECT o_custkey AS packet_id, o_orderkey AS doc_id,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS ordinal,
  o_orderpriority AS doc_type, o_orderstatus AS status, o_totalprice AS declared, o_orderdate AS created FROM orders)""",
    "implied": """implied AS (SELECT l_orderkey AS doc_id, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS implied,
  min(l_shipdate) AS submitted, max(l_shipdate) AS modified, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey)""",
    "facts": "facts AS (SELECT docs.*, implied, submitted, modified, n_lines FROM docs JOIN implied USING (doc_id))",
    "found": f"""homes AS (SELECT packet_id, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS home, arg_min(l_suppkey, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS firm FROM docs JOIN lineitem ON l_orderkey = doc_id WHERE ordinal = 1 GROUP BY 1),
shared AS (SELECT packet_id AS app_id, 'property' AS kind, home::VARCHAR AS value FROM homes UNION ALL SELECT packet_id, 'employer', firm || '-' || p_brand FROM homes JOIN part ON p_partkey = home
  UNION ALL SELECT packet_id, 'pan', c_nationkey || '-' || c_mktsegment FROM homes JOIN customer ON c_custkey = packet_id),
counts AS (SELECT kind, value, count(*) AS n_apps FROM shared GROUP BY ALL),
bonds AS (SELECT * FROM shared JOIN counts USING (kind, value) WHERE n_apps <= (SELECT greatest(6, ceil(0.33 * count(DISTINCT app_id))) FROM shared)),
groups AS (SELECT b.kind, b.value, count(DISTINCT p.value) AS n_applicants FROM bonds b JOIN shared p ON p.app_id = b.app_id AND p.kind = 'pan' WHERE b.kind <> 'pan' GROUP BY ALL HAVING count(DISTINCT b.app_id) >= 2 AND count(DISTINCT p.value) >= 2),
found AS (
  SELECT packet_id, doc_id, 'forensic' AS category, 'medium' AS severity, 'Modified long after creation' AS title, 'type ' || doc_type AS location, 0.80::DOUBLE AS confidence, 0 AS part
    FROM facts WHERE floor((epoch_us(modified) - epoch_us(created)) / 86400000000) > 30
  UNION ALL SELECT packet_id, doc_id, 'forensic', 'high', 'Impossible date order', 'type ' || doc_type, 0.98::DOUBLE, 1
    FROM facts WHERE floor((epoch_us(modified) - epoch_us(created)) / 86400000000) < 0
  UNION ALL SELECT packet_id, doc_id, 'forensic', 'high', 'Created in the future', 'type ' || doc_type, 0.98::DOUBLE, 2
    FROM facts WHERE floor((epoch_us(created) - epoch_us(TIMESTAMP '{AS_OF}')) / 86400000000) > 30
  UNION ALL SELECT packet_id, doc_id, 'semantic', CASE WHEN d > 0.4 THEN 'high' ELSE 'medium' END, 'Income does not match bank credits', 'type ' || doc_type, 0.90::DOUBLE, 3
    FROM (SELECT *, CASE WHEN greatest(abs(declared), abs(implied)) < 1 THEN 0.0 ELSE abs(declared - implied) / greatest(abs(declared), abs(implied)) END AS d FROM facts) WHERE d > 0.2
  UNION ALL SELECT app_id, NULL, 'graph', CASE WHEN n_applicants >= 3 THEN 'critical' WHEN kind = 'property' THEN 'medium' ELSE 'high' END, CASE kind WHEN 'property' THEN 'Property pledged in several applications' ELSE 'Applicants linked by one employer' END,
    kind || ' ' || value, CASE kind WHEN 'property' THEN 0.9 ELSE 0.85 END::DOUBLE, CASE kind WHEN 'property' THEN 4 ELSE 5 END FROM groups JOIN bonds USING (kind, value)
  UNION ALL SELECT app_id, NULL, 'graph', 'info', 'Applicant of several applications', 'pan ' || value, 0.7::DOUBLE, 6 FROM shared JOIN counts USING (kind, value) WHERE kind = 'pan' AND n_apps >= 2)""",
    "evidence": "evidence AS (SELECT * EXCLUDE (part), row_number() OVER (PARTITION BY packet_id ORDER BY part, doc_id) AS seq FROM found)",
    "ranked": """ranked AS (SELECT *, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS sev,
  CASE severity WHEN 'critical' THEN 60.0 WHEN 'high' THEN 35.0 WHEN 'medium' THEN 18.0 WHEN 'low' THEN 6.0 ELSE 0.0 END::DOUBLE AS pts FROM evidence)""",
    "channels": """channels AS (SELECT packet_id, count(*) AS n_findings, count_if(severity IN ('high', 'critical')) AS n_severe,
  least(1.0, coalesce(sum(pts) FILTER (category = 'forensic'), 0) / 100)::DOUBLE AS forensic_risk,
  least(1.0, coalesce(sum(pts) FILTER (category = 'semantic'), 0) / 100)::DOUBLE AS semantic_risk,
  least(1.0, coalesce(sum(pts) FILTER (category = 'graph'), 0) / 100)::DOUBLE AS graph_risk,
  bool_or(severity = 'critical') AS has_critical,
  bool_or(category IN ('forensic', 'semantic') OR (category = 'graph' AND severity <> 'info')) AS has_evidence
  FROM ranked GROUP BY packet_id)""",
    "edges": """edges AS (
  SELECT DISTINCT o_custkey AS app_id, 'property' AS kind, l_partkey::VARCHAR AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  UNION SELECT o_custkey, 'employer', l_suppkey::VARCHAR FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  UNION SELECT o_custkey, 'template', o_orderpriority FROM orders
  UNION SELECT c_custkey, 'pan', c_nationkey || '-' || c_mktsegment FROM customer)""",
    "degrees": """threshold AS (SELECT greatest(6, ceil(0.33 * count(DISTINCT app_id)))::BIGINT AS t FROM edges),
degrees AS (SELECT kind, value, count(DISTINCT app_id) AS n_apps, count(DISTINCT app_id) > (SELECT t FROM threshold) AS is_hub FROM edges GROUP BY kind, value),
links AS (SELECT edges.* FROM edges JOIN degrees USING (kind, value) WHERE NOT is_hub)""",
}


def sql(*names: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names)


EVIDENCE = ("docs", "implied", "facts", "found", "evidence")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("packet_id"), F.col("o_orderkey").alias("doc_id"), F.row_number().over(w).alias("ordinal"), F.col("o_orderpriority").alias("doc_type"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("declared"), F.col("o_orderdate").alias("created"),
    )


def implied(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("implied"), F.min("l_shipdate").alias("submitted"), F.max("l_shipdate").alias("modified"), F.count(F.lit(1)).alias("n_lines"),
    )


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).join(implied(spark, sf), "doc_id")


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of the documents in one pass, then those of the graph."""
    f = facts(spark, sf)
    dates = ev.date_signs(F.col("created"), F.col("modified"), F.lit(AS_OF).cast("timestamp"))
    found = ev.emitted(f, [*dates, ev.income_sign(F.col("declared"), F.col("implied"))])
    links = linkage.evidence(written(case_edges(spark, sf), "case-edges", "kind"))
    graph = links.select("packet_id", F.lit(None).cast("long").alias("doc_id"), F.lit("graph").alias("category"), "severity", "title", "location", "confidence", (F.col("seq") + 10).alias("part"))
    order = Window.partitionBy("packet_id").orderBy("part", "doc_id")
    return found.unionByName(graph).withColumn("seq", F.row_number().over(order)).drop("part")


def case_edges(spark: SparkSession, sf: str) -> DataFrame:
    """(app_id, kind, value): the property and employer of each packet's first document, and its applicant."""
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = docs(spark, sf).where("ordinal = 1").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("doc_id"))
    home = lines.groupBy("packet_id").agg(F.min_by(F.struct("l_partkey", "l_suppkey"), key).alias("h")).select("packet_id", "h.*")
    full = home.join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("packet_id"))
    kinds = {"property": F.col("l_partkey").cast("string"), "employer": F.concat_ws("-", F.col("l_suppkey").cast("string"), "p_brand"), "pan": F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment")}
    return full.select(F.col("packet_id").alias("app_id"), F.explode(F.create_map(*(x for k, v in kinds.items() for x in (F.lit(k), v)))).alias("kind", "value"))


def _edges(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """(app_id, value) of each kind: numbers are made distinct before they become text."""
    orders = table(spark, sf, "orders")
    lines = orders.join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    edge = lambda df, app, value: df.select(F.col(app).alias("app_id"), value.alias("value")).distinct().withColumn("value", F.col("value").cast("string"))
    return {
        "property": edge(lines, "o_custkey", F.col("l_partkey")), "employer": edge(lines, "o_custkey", F.col("l_suppkey")),
        "template": edge(orders, "o_custkey", F.col("o_orderpriority")), "pan": edge(table(spark, sf, "customer"), "c_custkey", F.concat_ws("-", "c_nationkey", "c_mktsegment")),
    }


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (df.select("app_id", F.lit(kind).alias("kind"), "value") for kind, df in _edges(spark, sf).items()))


def stored_edges(spark: SparkSession, sf: str) -> DataFrame:
    """edges, written once: hubs, clusters and templates each read them, some kinds only."""
    return written_parts(_edges(spark, sf), "kind", "edges").select("app_id", "kind", "value")
