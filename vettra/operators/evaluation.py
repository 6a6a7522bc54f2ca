"""Evaluation and models: confusion, grouped rates, calibration, scaling, boosted trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vettra.operators import boxes
from vettra.sources.shared import written


def confusion(df: DataFrame, truth: str, flagged: str) -> DataFrame:
    t, p = F.col(truth), F.col(flagged)
    c = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select("tp", "fp", "tn", "fn", ratio(tp, tp + fp).alias("prec"), ratio(tp, tp + fn).alias("recall"), ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def rates(df: DataFrame, keys: list[str], flagged: str) -> DataFrame:
    """n and rate by each key on its own, in one pass."""
    out = df.groupingSets([[F.col(k)] for k in keys], *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(flagged).cast("int")), 6).alias("rate"))
    return out.select(*keys, "n", "rate")


def calibrated(df: DataFrame, score: Column, size: Column, truth: str, thresholds: tuple, sizes: tuple, most: float) -> DataFrame:
    """The (t, m) of a fixed grid with the best recall whose false-positive rate stays within `most`; ties to the larger m."""
    grid = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(m).alias("m")) for t in thresholds for m in sizes))
    rows = df.select(F.col(truth).alias("truth"), score.alias("score"), size.alias("size"), F.explode(grid).alias("g"))
    hit = ((F.col("score") < F.col("g.t")) & (F.col("size") >= F.col("g.m"))).cast("int")
    rate = lambda c: F.avg(F.when(c, hit))
    each = rows.groupBy(F.col("g.t").alias("t"), F.col("g.m").alias("m")).agg(rate(F.col("truth")).alias("recall"), rate(~F.col("truth")).alias("fpr"))
    return each.where(F.col("fpr") <= most).orderBy(F.desc("recall"), F.desc("m"), "t").limit(1).select("t", "m", F.round("recall", 6).alias("recall"), F.round("fpr", 6).alias("fpr"))


def scaled(df: DataFrame, columns: list[str], fit_on: Column) -> DataFrame:
    """z-scores by mean and population deviation of the rows where `fit_on` holds; constant columns stay unscaled."""
    stats = df.where(fit_on).agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).select(F.struct("*").alias("s"))
    one = stats.scalar()
    z = lambda c: (F.col(c) - one[f"{c}_m"]) / F.when(one[f"{c}_s"] == 0, 1.0).otherwise(one[f"{c}_s"])
    return df.withColumns({f"{c}_z": z(c) for c in columns})


def iou(a: DataFrame, b: DataFrame, group: list[str], cell: list[str]) -> DataFrame:
    """Intersection over union of two sets of cells of each group."""
    both = a.withColumn("in_a", F.lit(1)).join(b.withColumn("in_b", F.lit(1)), [*group, *cell], "full")
    return both.groupBy(*group).agg(F.round(F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()) / F.count(F.lit(1)), 6).alias("iou"))


def cell_iou(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Intersection over union of the sets of cells under two arrays of boxes with whole corners; keys without any cell have no row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(shared, every) for _, _, shared, every in boxes.shared_cells(boxes.flat(batch[a]), boxes.flat(batch[b]), batch.num_rows)] or [(np.zeros(0, np.int64),) * 2]
            shared, every = (pa.array(np.concatenate(c)) for c in zip(*found))
            yield pa.RecordBatch.from_arrays([batch[key], shared, every], [key, "shared", "every"])

    counts = rows.select(key, a, b).mapInArrow(count, f"{key} {dict(rows.dtypes)[key]}, shared long, every long")
    return counts.where("every > 0").select(key, F.round(F.col("shared") / F.col("every"), 6).alias("iou"))


def box_iou(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Intersection over union of the masks of two arrays of boxes, by the areas that they cover; missing arrays are empty, and 0 without any area."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other, n = boxes.flat(batch[a]), boxes.flat(batch[b]), batch.num_rows
            both = tuple(np.concatenate(c) for c in zip(one, other, strict=True))
            areas = [pa.array(boxes.union_areas(*side, n)) for side in (one, other, both)]
            yield pa.RecordBatch.from_arrays([batch[key], *areas], [key, "p", "q", "u"])

    areas = rows.select(key, a, b).mapInArrow(measure, f"{key} {dict(rows.dtypes)[key]}, p double, q double, u double")
    return areas.select(key, F.round(F.coalesce(F.try_divide(F.col("p") + F.col("q") - F.col("u"), "u"), F.lit(0.0)), 6).alias("iou"))


def boosted(df: DataFrame, key: str, columns: list[str], label: str) -> DataFrame:
    """Gradient-boosted trees (100 trees of depth 3, rate 0.1, subsample 0.8): probability, and each feature's share of importance times |z|."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(scaled(df.withColumn(label, F.col(label).cast("double")), columns, F.col(label) == 0))
    model = GBTClassifier(labelCol=label, maxIter=100, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, seed=42).fit(rows)
    weight = dict(zip(columns, model.featureImportances.toArray().tolist(), strict=True))
    raw = {c: F.lit(weight[c]) * F.abs(F.col(f"{c}_z")) for c in columns}
    total = sum(raw.values(), F.lit(0.0))
    shares = F.array_join(F.array(*(F.concat_ws("=", F.lit(c), F.round(F.try_divide(raw[c], total), 2).cast("string")) for c in columns)), ";")
    return model.transform(rows).select(key, vector_to_array("probability")[1].alias("probability"), shares.alias("attributions"))


def roc_report(df: DataFrame, score: str, truth: str, threshold: float = 0.5) -> DataFrame:
    """(auc, accuracy, and each class's precision and recall): the area by ranks, ties at their mean.

    Scores count to four places, so that the ranks are made over 10,001 rows at most.
    """
    rows = df.select(F.round(score, 4).alias("s"), F.col(truth).cast("boolean").alias("t"))
    each = rows.groupBy("s").agg(F.count_if("t").alias("p"), F.count_if(~F.col("t")).alias("n"))
    below = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    area = each.withColumn("under", F.coalesce(F.sum("n").over(below), F.lit(0))).agg(F.sum(F.col("p") * (F.col("under") + F.col("n") / 2)).alias("a"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    auc = area.select(F.round(F.try_divide("a", F.col("p") * F.col("n")), 6).alias("auc"))
    return auc.crossJoin(confusion(rows.select("t", (F.col("s") >= threshold).alias("f")), "t", "f"))  # two single rows


def cross_validated(df: DataFrame, key: str, columns: list[str], label: str, n: int = 5, trees: int = 100) -> DataFrame:
    """(key, label, fold, probability): boosted trees fitted on the other folds; each class is dealt to the folds on its own.

    The rows are written once, as each of the n fits reads them, and so are the predictions, which several reports read.
    The fits run side by side, so that the many short jobs of one leave no executor idle.
    """
    from functools import reduce
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    place = F.row_number().over(Window.partitionBy(label, F.pmod(F.xxhash64(key), F.lit(64))).orderBy(F.xxhash64(F.lit(7), key), key)) + F.pmod(F.xxhash64(key), F.lit(64))
    dealt = written(df.select(key, F.col(label).cast("double").alias(label), *columns, F.pmod(place, F.lit(n)).cast("int").alias("fold")), "folds")
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(dealt)
    fit = lambda i: GBTClassifier(labelCol=label, maxIter=trees, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, seed=42).fit(rows.where(F.col("fold") != i)).transform(rows.where(F.col("fold") == i))
    with ThreadPool(n) as pool:
        fitted = pool.map(inheritable_thread_target(df.sparkSession)(fit), range(n))
    return written(reduce(DataFrame.unionByName, (f.select(key, label, "fold", F.round(vector_to_array("probability")[1], 4).alias("probability")) for f in fitted)), "predictions")


def fold_report(predictions: DataFrame, label: str, threshold: float = 0.5) -> DataFrame:
    """(fold, n, auc, accuracy, and precision, recall and F1 of each class) of each fold, and of all together (fold null), in one pass.

    predictions: (label 0 or 1, fold, probability). Probabilities count to four places; the area is by ranks, ties at their mean.
    """
    both = predictions.select(F.explode(F.array(F.col("fold"), F.lit(None).cast("int"))).alias("fold"), (F.col(label) == 1).alias("t"), F.round("probability", 4).alias("s"))
    flag = F.col("s") >= threshold
    cells = {"p": F.col("t"), "n": ~F.col("t"), "tp": F.col("t") & flag, "fp": ~F.col("t") & flag}
    each = both.groupBy("fold", "s").agg(*(F.count_if(c).alias(k) for k, c in cells.items()))  # a fold has 10,001 scores at most
    below = Window.partitionBy("fold").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = each.withColumn("under", F.coalesce(F.sum("n").over(below), F.lit(0)))
    sums = ranked.groupBy("fold").agg(F.sum(F.col("p") * (F.col("under") + F.col("n") / 2)).alias("area"), *(F.sum(k).alias(k) for k in cells))
    p, n, tp, fp = (F.col(c) for c in cells)
    fn, tn = p - tp, n - fp
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    return sums.select(
        "fold", (p + n).alias("n"), ratio(F.col("area"), p * n).alias("auc"), ratio(tp + tn, p + n).alias("accuracy"), ratio(tp, tp + fp).alias("prec_1"), ratio(tp, p).alias("recall_1"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1_1"),
        ratio(tn, tn + fn).alias("prec_0"), ratio(tn, n).alias("recall_0"), ratio(2 * tn, 2 * tn + fp + fn).alias("f1_0"),
    )


def separation(scores: DataFrame, score: str, label: str) -> DataFrame:
    """One row: how far the scores of clean rows (label 0) and the others lie apart."""
    of = lambda f, v: f(F.when(F.col(label) == v, F.col(score)))
    return scores.agg(of(F.avg, 0).alias("mean_clean"), of(F.max, 0).alias("max_clean"), of(F.avg, 1).alias("mean_fraud"), of(F.min, 1).alias("min_fraud"))
