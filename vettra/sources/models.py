"""Fitted models as stored artefacts: fitted once, resolved by name and version, scored later.

An artefact's folder holds the boosted trees, the isolation forest's nodes and the scaler;
its registry row holds what scoring must agree on: the order of the features, the size of
the subsamples and the offset of the anomaly. The row is written last, so that what it
names is whole; it resolves only while its status is ``present`` and its folder exists.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vettra.operators import isolation
from vettra.sources.versions import Store

SCHEMA = "name string, version string, status string, folder string, features array<string>, sample int, cut double"


@dataclass
class Model:
    folder: str
    features: list[str]
    sample: int
    cut: float


def registry(spark: SparkSession, root: str) -> Store:
    return Store(spark, f"{root}/registry", ("name", "version"), buckets=1)


def standardised(df: DataFrame, columns: list[str], scaler: DataFrame) -> DataFrame:
    """df with its columns as z-scores by the stored means and deviations (one row a column)."""
    of = scaler.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "deviation")))).alias("m")).scalar()  # a row a feature
    return df.withColumns({c: (F.col(c) - of[c]["mean"]) / of[c]["deviation"] for c in columns})


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(df)


def booster(label: str, trees: int, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(labelCol=label, maxIter=trees, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, seed=seed)


def fit(rows: DataFrame, key: str, columns: list[str], label: str, clean: Column, root: str, name: str, version: str, trees: int = 100, forest: int = isolation.TREES) -> Model:
    """Fits and stores a version, or resolves it where it is already stored.

    Boosted trees learn the label from all rows, the forest the clean ones; both see z-scores by the clean rows.
    """
    spark = rows.sparkSession
    if (found := resolve(spark, root, name, version)) is not None:
        return found
    folder = f"{root}/{name}/{version}"
    stats = rows.where(clean).agg(*(x for c in columns for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))))
    entries = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"{c}_m").alias("mean"), F.when(F.col(f"{c}_s") > 0, F.col(f"{c}_s")).otherwise(1.0).alias("deviation")) for c in columns))
    stats.select(F.inline(entries)).write.mode("overwrite").parquet(f"{folder}/scaler")
    z = standardised(rows, columns, spark.read.parquet(f"{folder}/scaler"))
    booster(label, trees).fit(assembled(z.withColumn(label, F.col(label).cast("double")), columns)).write().overwrite().save(f"{folder}/boosted")
    good = z.where(clean)
    isolation.fitted(good, key, columns, trees=forest).write.mode("overwrite").parquet(f"{folder}/forest")
    sample = max(1, min(isolation.SAMPLE, good.count()))
    scores = isolation.scored(good, key, columns, spark.read.parquet(f"{folder}/forest"), sample)
    cut = scores.agg(F.percentile(F.round("score", 6), F.lit(1 - isolation.CONTAMINATION))).first()[0]
    row = spark.createDataFrame([(name, version, "present", folder, columns, sample, cut)], SCHEMA)
    registry(spark, root).replace(row, f"{name}/{version}")
    return resolve(spark, root, name, version)


def resolve(spark: SparkSession, root: str, name: str, version: str) -> Model | None:
    """The stored version, or None unless it is present and its folder is there."""
    store = registry(spark, root)
    if not store.versions():
        return None
    r = store.read().where((F.col("name") == name) & (F.col("version") == version) & (F.col("status") == "present")).first()
    context = spark.sparkContext
    if r is None or not (path := context._jvm.org.apache.hadoop.fs.Path(r.folder)).getFileSystem(context._jsc.hadoopConfiguration()).exists(path):
        return None
    return Model(r.folder, list(r.features), r["sample"], r.cut)


def scores(rows: DataFrame, key: str, model: Model) -> DataFrame:
    """(key, probability, anomaly) of every row by the stored model, to four places."""
    spark = rows.sparkSession
    z = standardised(rows.select(key, *model.features), model.features, spark.read.parquet(f"{model.folder}/scaler"))
    boosted = GBTClassificationModel.load(f"{model.folder}/boosted").transform(assembled(z, model.features)).select(key, F.round(vector_to_array("probability")[1], 4).alias("probability"))
    isolated = isolation.scored(z, key, model.features, spark.read.parquet(f"{model.folder}/forest"), model.sample)
    return boosted.join(isolated, key).select(key, "probability", F.round(isolation.anomaly(F.col("score"), F.lit(model.cut)), 4).alias("anomaly"))


def importances(spark: SparkSession, model: Model) -> dict[str, float]:
    """The boosted trees' importance of each feature."""
    return dict(zip(model.features, GBTClassificationModel.load(f"{model.folder}/boosted").featureImportances.toArray().tolist(), strict=True))
