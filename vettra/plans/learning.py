"""Queries with fitted models: scores, decisions by a stored model, and how well it does on packets that it hasn't seen.

SQL can't express the fits; tests check paths, areas and reports by brute force.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vettra.functions import fixed
from vettra.operators import evaluation, isolation
from vettra.plans import lending, packets
from vettra.sources import models
from vettra.sources.shared import fresh_path

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NAMES = list(fixed.FEATURES)


def query(f):
    QUERIES[f.__name__] = f
    return f


def labelled(spark, sf):
    """Features of all packets with whether they were tampered with."""
    docs = lending.stored_documents(spark, sf)
    return docs, packets.features(spark, sf, docs).join(lending.truth(docs), "packet_id")


@query
def isolation_scores(spark, sf):
    """Fitted on packets that weren't tampered with, as novelty against clean ones."""
    _, v = labelled(spark, sf)
    return isolation.isolation(v, "packet_id", NAMES, fit_on=F.col("label") == 0).select("packet_id", F.round("score", 4).alias("score"), F.round("anomaly", 4).alias("anomaly"))


@query
def gbt_scores(spark, sf):
    _, v = labelled(spark, sf)
    return evaluation.boosted(v, "packet_id", NAMES, "label").select("packet_id", F.round("probability", 4).alias("probability"), "attributions")


def stored_model(spark, sf, v):
    """The risk model, fitted and stored, and resolved as scoring finds it."""
    root = fresh_path(spark, "models")
    models.fit(v, "packet_id", NAMES, "label", F.col("label") == 0, root, "risk", "1")
    return models.resolve(spark, root, "risk", "1")


@query
def model_decisions(spark, sf):
    """Decisions of all packets by the stored model: its probability and anomaly with the findings of documents, rules and graph."""
    docs, v = labelled(spark, sf)
    model = stored_model(spark, sf, v)
    out = packets.decisions(spark, sf, docs, lambda vector: models.scores(vector, "packet_id", model))
    return out.select("packet_id", "probability", "anomaly", "n_findings", F.round("graph_risk", 6).alias("graph_risk"), F.round("risk", 6).alias("risk"), "trust", "action", "chain")


@query
def model_attributions(spark, sf):
    """The leading factors of each packet by the stored model's importances."""
    _, v = labelled(spark, sf)
    shares = models.importances(spark, stored_model(spark, sf, v))
    from vettra.operators.packets import attributions

    return attributions(v, F.col("label") == 0, shares).select("packet_id", "rank", "feature", F.round("share", 6).alias("share"))


@query
def cross_validation_report(spark, sf):
    """Area under the curve and each class's report, by fold and over all, of predictions for packets that the fit left out."""
    _, v = labelled(spark, sf)
    return evaluation.fold_report(evaluation.cross_validated(v, "packet_id", NAMES, "label"), "label")


@query
def anomaly_separation(spark, sf):
    """How far the isolation forest's anomalies of clean and of tampered packets lie apart."""
    _, v = labelled(spark, sf)
    scores = isolation.isolation(v, "packet_id", NAMES, fit_on=F.col("label") == 0).join(v.select("packet_id", "label"), "packet_id")
    return evaluation.separation(scores, "anomaly", "label")
