"""Queries that write, write again, and read back: cases, growing tables and the application graph."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vettra.functions import fixed
from vettra.operators import evidence as ev
from vettra.plans import lending, packets
from vettra.sources import cases
from vettra.sources.shared import fresh_path, written
from vettra.sources.tables import table
from vettra.sources.versions import Store

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT c_custkey AS k, c_name, NULL::VARCHAR AS added FROM customer UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer""")
def append_migrate(spark, sf):
    """All rows appended twice, the second time with a column more; a commit that is made again adds nothing."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_name", F.col("c_mktsegment").alias("added"))
    store = Store(spark, fresh_path(spark, "appended"), ("k",))
    store.append(c.drop("added"), "first")
    store.append(c, "second")
    store.append(c, "second")
    return store.read()


_MOVED = "nation < 5"


@query("WITH " + ",\n".join(lending.CTE[n] for n in ("docs", "graph")) + f""",
later AS (SELECT app_id, kind, CASE WHEN kind = 'property' THEN 'moved' ELSE value END AS value FROM edges JOIN cases ON packet_id = app_id WHERE {_MOVED} AND kind <> 'template'
  UNION ALL SELECT edges.* FROM edges JOIN cases ON packet_id = app_id WHERE NOT ({_MOVED}))
SELECT 1 AS version, kind, count(*) AS n_edges, count(DISTINCT value) AS n_values FROM edges GROUP BY kind UNION ALL SELECT 2, kind, count(*), count(DISTINCT value) FROM later GROUP BY kind
UNION ALL SELECT 0, 'property', 0, 0""")
def graph_store(spark, sf):
    """The graph persisted, then applications of some nations linked anew without their templates: the versions before and after."""
    docs = lending.stored_documents(spark, sf)
    edges = lending.edges(docs)
    store = Store(spark, fresh_path(spark, "graph"), ("app_id",))
    empty = store.read(empty=T.StructType.fromDDL("app_id long, kind string, value string"))
    first = store.replace(edges, "seed")
    moved = docs.where(f"ordinal = 1 AND {_MOVED}").select(F.col("packet_id").alias("app_id"))
    value = F.when(F.col("kind") == "property", "moved").otherwise(F.col("value"))
    later = edges.join(moved, "app_id", "left_semi").where("kind <> 'template'").select("app_id", "kind", value.alias("value"))
    second = store.replace(later, "relink")
    assert store.replace(later, "relink") == second == first + 1
    count = lambda df, n: df.groupBy(F.lit(n).alias("version"), "kind").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("value").alias("n_values"))
    none = empty.agg(F.lit(0).alias("version"), F.lit("property").alias("kind"), F.count("value").alias("n_edges"), F.count_distinct("value").alias("n_values"))
    return none.unionByName(count(store.read(first), 1)).unionByName(count(store.read(second), 2))


@query(packets.sql(*packets.DECIDED) + f""", {packets._FIRST}, {packets.VERIFIED},
stored AS (SELECT docs.packet_id, count(*) AS n_docs, count(*) FILTER (doc_type IN ('form16', 'identity')) AS n_named FROM docs GROUP BY 1)
SELECT 'case_' || left(sha256('packet' || chr(1) || packet_id), 12) AS case_id, CASE WHEN final >= 70 THEN 'approve' WHEN final < 40 AND (has_evidence OR has_critical OR penalty > 0) THEN 'freeze' ELSE 'manual_review' END AS action, final AS trust_score,
  'completed' AS status, loan_amount, {fixed.TENURE_MONTHS} AS tenure_months, n_docs, n_named, '{{"penalty":' || penalty || '}}' AS verification FROM folded JOIN stored USING (packet_id) JOIN applications USING (packet_id)""")
def case_store(spark, sf):
    """Every packet submitted as a case with its documents, submitted again, and read back from the store."""
    docs = lending.stored_documents(spark, sf)
    folder = fresh_path(spark, "store")
    e = written(lending.entities(docs), "entities")  # rules, verification and the stored fields each read them
    block = packets.verified(docs, e).select("packet_id", F.col("penalty").alias("points"))
    decided = ev.folded(ev.checked_decisions(packets.decisions(spark, sf, docs, entities=e)).join(block, "packet_id"), F.col("points"))
    decision = F.to_json(F.struct("packet_id", "final_action", "chain"))
    rows = decided.join(lending.applications(docs), "packet_id").select(
        "packet_id", ev.row_id("usr", "applicant_pan").alias("user_id"), F.lit("salaried_loan").alias("purpose"), F.col("final_trust").alias("trust_score"), F.col("final_action").alias("action"),
        decision.alias("decision"), F.to_json(F.struct("penalty")).alias("verification"), "loan_amount", F.lit(fixed.TENURE_MONTHS).alias("tenure_months"),
    )
    files = e.select("packet_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), "doc_type", F.to_json(F.struct("name", "pan", "property_id")).alias("fields"))
    rows, files = written(rows, "rows"), written(files, "files")
    for token in ("monday", "monday", "tuesday"):
        cases.submit(spark, folder, rows, files, token)
    case, doc = (cases.store(spark, folder, n).read() for n in ("cases", "case_docs"))
    n = doc.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("doc_type").isin("form16", "identity")).alias("n_named"))
    return case.join(n, F.col("id") == F.col("case_id")).select("case_id", "action", "trust_score", "status", "loan_amount", "tenure_months", "n_docs", "n_named", "verification")
