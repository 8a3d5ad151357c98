"""Downstream utility: train on synthetic, test on real; thresholds, confusion and what follows from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import ratio
from .detect import auroc

THRESHOLDS = tuple(round(0.10 + 0.05 * i, 2) for i in range(16))


def train_on_synthetic(train: DataFrame, test: DataFrame, columns: Sequence[str], target: str, weighted: bool = False, folds: int = 3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(scored test rows: label, score; one row: cv_auc, test_auc). A cross-validated grid picks the trees' depth."""
    cast = lambda df: df.withColumn("label", F.col(target).cast("double"))
    assemble = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip")
    fit_on = assemble.transform(cast(train))
    booster = GBTClassifier(maxIter=10, seed=seed)
    if weighted:
        n = fit_on.agg(F.avg("label").alias("rate")).first()["rate"] or 0.5
        fit_on = fit_on.withColumn("weight", F.when(F.col("label") == 1, F.lit((1 - n) / max(n, 1e-9))).otherwise(F.lit(1.0)))
        booster = booster.setWeightCol("weight")
    grid = ParamGridBuilder().addGrid(booster.maxDepth, [2, 4]).build()
    cv = CrossValidator(estimator=booster, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=folds, seed=seed, parallelism=2).fit(fit_on)
    scored = cv.transform(assemble.transform(cast(test))).select("label", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
    aucs = auroc(scored, "score", "label").select(F.lit(float(max(cv.avgMetrics))).alias("cv_auc"), F.col("auc").alias("test_auc"))
    return scored, aucs


def confusion_at(scored: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """A row per threshold: tn, fp, fn, tp, accuracy, precision, recall, f1; 0 where a denominator is. One pass for all thresholds."""
    p = F.col("label") == 1
    counts = []
    for i, t in enumerate(thresholds):
        hit = F.col("score") >= t
        counts += [F.count_if(~p & ~hit).alias(f"tn{i}"), F.count_if(~p & hit).alias(f"fp{i}"), F.count_if(p & ~hit).alias(f"fn{i}"), F.count_if(p & hit).alias(f"tp{i}")]
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{n}{i}").alias(n) for n in ("tn", "fp", "fn", "tp")]) for i, t in enumerate(thresholds)])
    out = scored.where("score is not null and label is not null").agg(*counts).select(F.inline(rows))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"accuracy": zero(ratio(tp + tn, tp + tn + fp + fn)), "precision": zero(ratio(tp, tp + fp)), "recall": zero(ratio(tp, tp + fn)), "f1": zero(ratio(2 * tp, 2 * tp + fp + fn))})


def optimal_threshold(scored: DataFrame, metric: str = "f1") -> DataFrame:
    """One row: the threshold with the highest metric, the first of several; 0.5 if none beats 0."""
    best = confusion_at(scored).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(metric), "threshold"))).where("rank = 1")  # over the thresholds
    return best.select(F.when(F.col(metric) > 0, F.col("threshold")).otherwise(0.5).alias("threshold"), F.col(metric).alias("value"))


def screening_report(confusion: DataFrame) -> DataFrame:
    """Percentages of a screening test, 0 where a denominator is; number_needed_to_screen is infinite without a hit."""
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    percent = lambda part, whole: F.coalesce(100 * ratio(part, whole), F.lit(0.0))
    return confusion.select(
        "threshold",
        percent(tp, tp + fn).alias("catch_rate"),
        percent(fn, tp + fn).alias("miss_rate"),
        percent(tp, tp + fp).alias("hit_rate"),
        percent(fp, tp + fp).alias("false_alarm_rate"),
        F.coalesce(ratio(tp + fp, tp), F.lit(float("inf"))).alias("number_needed_to_screen"),
        percent(tn, tn + fp).alias("specificity"),
        percent(tn, tn + fn).alias("npv"),
        percent(tp, tp + fp).alias("ppv"),
    )


def transfer_gap(cv_auc: Column, test_auc: Column) -> tuple[Column, Column]:
    """(gap, band)."""
    gap = cv_auc - test_auc
    return gap, F.when(gap < 0.05, "excellent").when(gap < 0.15, "good").when(gap < 0.25, "moderate").otherwise("poor")
