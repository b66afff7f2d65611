"""Comparing models, summarising cross-validation and keeping a run history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.functions.groups import join_on, keys, with_totals
from textlab.operators.metrics import METRICS
from textlab.operators.ranks import ranked
from textlab.plans.rules import split_verdict, stability_verdict

F1_SHARE, SPEED_SHARE = 0.7, 0.3
LEAST_LATENCY = 1.0


def compare_models(results: DataFrame, by=()) -> DataFrame:
    """Composite of F1 and speed per model, ranked best first.

    Speed is relative to the median latency of the models. Single-request latency counts if all
    models have one, else the batch figure.
    """
    by = keys(by)
    told = with_totals(results, by, _single=F.count("single_ms"), _all=F.count(F.lit(1)))
    told = told.withColumn(
        "latency_ms", F.when(F.col("_single") == F.col("_all"), F.col("single_ms")).otherwise(F.col("batch_ms"))
    )
    told = with_totals(told, by, _median=F.median("latency_ms"))
    speed = 1.0 / (1.0 + F.col("latency_ms") / F.greatest(F.col("_median"), F.lit(LEAST_LATENCY)))
    scored = told.withColumn("composite", F1_SHARE * F.col("f1") + SPEED_SHARE * speed)
    best_first = ranked(scored, [F.desc("composite"), F.col("model")], by)
    return best_first.drop("_single", "_all", "_median")


def best_model(comparison: DataFrame) -> DataFrame:
    return comparison.filter("rank = 1")


def comparison_table(comparison: DataFrame, by=()) -> DataFrame:
    """The eight columns shown to readers, the batch figure standing in for a missing single one."""
    return comparison.select(
        *keys(by),
        F.col("model").alias("Model"),
        F.col("f1").alias("F1 Score"),
        F.col("accuracy").alias("Accuracy"),
        F.col("precision").alias("Precision"),
        F.col("recall").alias("Recall"),
        F.col("batch_ms").alias("Batch Latency (ms)"),
        F.coalesce("single_ms", "batch_ms").alias("Single-Sample Latency (ms)"),
        F.col("composite").alias("Composite Score"),
    )


def attach_training(evals: DataFrame, trainings: DataFrame) -> DataFrame:
    """Evaluation of each model with its training record."""
    return evals.join(trainings, "model")


def cv_summary(folds: DataFrame, by=()) -> DataFrame:
    """Mean, population deviation, least and largest of each metric over the folds that worked."""
    by = keys(by)
    long = folds.filter("f1 is not null").unpivot(by, METRICS, "metric", "value")
    return long.groupBy(*by, "metric").agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.bround(F.avg("value"), 4).alias("mean"),
        F.bround(F.stddev_pop("value"), 4).alias("std"),
        F.bround(F.min("value"), 4).alias("min"),
        F.bround(F.max("value"), 4).alias("max"),
    )


def cv_verdict(summary: DataFrame, single: DataFrame, by=()) -> DataFrame:
    """Stability over the folds, and how the single split compares with their mean."""
    by = keys(by)
    f1 = summary.filter("metric = 'f1'").select(*by, "mean", "std")
    one = single.select(*by, F.col("f1").alias("single_f1"))
    joined = join_on(f1, one, by) if by else f1.withColumn("single_f1", one.scalar())
    diff = F.col("single_f1") - F.col("mean")
    return joined.select(
        *by,
        "mean",
        "std",
        "single_f1",
        stability_verdict(F.col("std")).alias("stability"),
        split_verdict(diff).alias("single_split"),
    )


def run_history(runs: DataFrame) -> DataFrame:
    """Finished runs, latest first."""
    return runs.select("timestamp", "run", "best_model", "f1", "accuracy").orderBy(F.desc("timestamp"), "run")
