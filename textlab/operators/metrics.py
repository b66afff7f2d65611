"""Metrics of scored tables. All single-label metrics derive from one confusion aggregate.

A scored table has ``label`` and ``prediction`` (strings) and may have ``p``, the class
probabilities in sorted class order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions.groups import join_on, keys, lookup_join, with_totals
from textlab.plans.rules import fit_diagnosis, gap_flag, lift_verdict

METRICS = ["f1", "accuracy", "precision", "recall"]
SMALL_SUPPORT = 50
THRESHOLD = 0.5


def argmax(p: Column) -> Column:
    """Position of the largest value, the first one among equals."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def decide(scored: DataFrame, classes: list[str], p: str = "p") -> DataFrame:
    names = F.array(*[F.lit(c) for c in classes])
    return scored.withColumn("prediction", F.get(names, argmax(F.col(p))))


def decide_multilabel(scored: DataFrame, names: str = "names", p: str = "p") -> DataFrame:
    """Labels whose own probability reaches the threshold."""
    chosen = F.filter(F.arrays_zip(F.col(names).alias("name"), F.col(p).alias("p")), lambda x: x["p"] >= THRESHOLD)
    return scored.withColumn("predicted", F.transform(chosen, lambda x: x["name"]))


def confusion_counts(scored: DataFrame, by=()) -> DataFrame:
    return scored.groupBy(*keys(by), "label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def per_class(counts: DataFrame, by=()) -> DataFrame:
    """Hits, support, predictions and precision, recall, F1 of every class that occurs."""
    by = keys(by)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("label").alias("class"), hit.alias("tp"), F.col("n").alias("s"), none.alias("p")),
        F.struct(F.col("prediction").alias("class"), none.alias("tp"), none.alias("s"), F.col("n").alias("p")),
    )
    sums = counts.select(*by, F.inline(sides)).groupBy(*by, "class").agg(
        F.sum("tp").alias("tp"), F.sum("s").alias("support"), F.sum("p").alias("predicted")
    )
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return sums.select(
        "*",
        _ratio(tp, predicted).alias("precision"),
        _ratio(tp, support).alias("recall"),
        _ratio(2 * tp, support + predicted).alias("f1"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def metrics(scored: DataFrame, by=()) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    return metrics_from_counts(confusion_counts(scored, by), by)


def metrics_from_counts(counts: DataFrame, by=()) -> DataFrame:
    n = F.sum("support")
    weighted = [(F.sum(F.col(m) * F.col("support")) / n).alias(m) for m in ("f1", "precision", "recall")]
    return per_class(counts, by).groupBy(*keys(by)).agg(
        n.alias("n_rows"), (F.sum("tp") / n).alias("accuracy"), *weighted
    )


def metrics_multilabel(scored: DataFrame, by=()) -> DataFrame:
    """Exact-match accuracy and micro-averaged precision, recall and F1, in one pass."""
    both = F.size(F.array_intersect("labels", "predicted"))
    same = F.array_sort(F.array_distinct("labels")) == F.array_sort(F.array_distinct("predicted"))
    sums = scored.groupBy(*keys(by)).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(same.cast("int")).alias("accuracy"),
        F.sum(both).alias("tp"),
        F.sum(F.size(F.array_except("predicted", "labels"))).alias("fp"),
        F.sum(F.size(F.array_except("labels", "predicted"))).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        "*",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def confusion_cells(scored: DataFrame, by=()) -> DataFrame:
    """The cells of the confusion matrix that occur, one row each, at any number of classes."""
    return confusion_counts(scored, by).select(*keys(by), "label", "prediction", "n")


def confusion(scored: DataFrame, by=()) -> DataFrame:
    """Confusion matrix in long form over the classes of each group, zeros included.

    It has a row for every pair of classes; where classes are many, ``confusion_cells`` is what to use.
    """
    by = keys(by)
    counts = confusion_counts(scored, by)
    seen = counts.select(*by, F.explode(F.array("label", "prediction")).alias("class"))
    classes = seen.groupBy(*by).agg(F.collect_set("class").alias("_classes"))
    rows = classes.select(*by, "_classes", F.explode("_classes").alias("label"))
    cells = rows.select(*by, "label", F.explode("_classes").alias("prediction"))
    filled = join_on(cells, counts, [*by, "label", "prediction"], "left")
    return filled.select(*by, "label", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_wide(scored: DataFrame, classes: list[str]) -> DataFrame:
    """Confusion matrix as a table, one column per predicted class."""
    return (
        confusion_counts(scored).groupBy("label").pivot("prediction", classes).agg(F.sum("n")).na.fill(0)
    )


def class_report(scored: DataFrame, by=()) -> DataFrame:
    """Per-class metrics followed by their macro and weighted averages."""
    by = keys(by)
    rows = per_class(confusion_counts(scored, by), by)
    columns = [*by, "class", "precision", "recall", "f1", "support"]
    n = F.sum("support")
    three = ("precision", "recall", "f1")
    macro = rows.groupBy(*by).agg(
        F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in three], n.alias("support")
    )
    weighted = rows.groupBy(*by).agg(
        F.lit("weighted avg").alias("class"),
        *[(F.sum(F.col(m) * F.col("support")) / n).alias(m) for m in three],
        n.alias("support"),
    )
    return rows.select(*columns).unionByName(macro.select(*columns)).unionByName(weighted.select(*columns))


def small_classes(scored: DataFrame, n: int = SMALL_SUPPORT, by=()) -> DataFrame:
    """Classes with too few scored rows for their metrics to be relied on."""
    rows = per_class(confusion_counts(scored, by), by)
    return rows.filter(F.col("support") < n).select(*keys(by), "class", "support")


def latency(batches: DataFrame, by=()) -> DataFrame:
    """Mean time per row over batches ``(rows, ms_per_row)``, weighted by their rows."""
    return batches.groupBy(*keys(by)).agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.sum("rows").alias("n_rows"),
        (F.sum(F.col("ms_per_row") * F.col("rows")) / F.sum("rows")).alias("latency_ms"),
    )


def long_metrics(wide: DataFrame, by=(), value: str = "value") -> DataFrame:
    return wide.unpivot(keys(by), METRICS, "metric", value)


def compare_metrics(train: DataFrame, val: DataFrame, base: DataFrame, by=()) -> DataFrame:
    """Train, validation and baseline value of each metric, with gap and lift."""
    by = keys(by)
    names = [*by, "metric"]
    joined = join_on(long_metrics(train, by, "train"), long_metrics(val, by, "val"), names)
    shared = base.unpivot(by, ["f1", "accuracy"], "metric", "baseline")
    joined = join_on(joined, shared, names, "left")
    return joined.select(
        *names,
        "train",
        "val",
        "baseline",
        (F.col("train") - F.col("val")).alias("gap"),
        (F.col("val") - F.col("baseline")).alias("lift"),
    )


def overfit_report(train: DataFrame, val: DataFrame, by=()) -> DataFrame:
    """Gap between training and validation per metric, flagged, with the F1 diagnosis."""
    by = keys(by)
    joined = join_on(
        long_metrics(train, by, "train"), long_metrics(val, by, "val"), [*by, "metric"]
    ).withColumn("gap", F.col("train") - F.col("val"))
    f1_gap = with_totals(joined, by, f1_gap=F.max(F.when(F.col("metric") == "f1", F.col("gap"))))
    return f1_gap.select(
        *by, "metric", "train", "val", "gap", gap_flag(F.col("gap")).alias("flag"),
        fit_diagnosis(F.col("f1_gap")).alias("diagnosis"),
    )


def majority_baseline(df: DataFrame, label: str, by=()) -> DataFrame:
    """Scores of always predicting the largest class (the smallest label among equals)."""
    by = keys(by)
    counts = df.groupBy(*by, F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*by).agg(
        F.min_by("_label", F.struct(-F.col("n"), F.col("_label"))).alias("majority_class"),
        F.max("n").alias("m"),
        F.sum("n").alias("n_rows"),
    )
    share = F.col("m") / F.col("n_rows")
    f1 = share * 2 * F.col("m") / (F.col("n_rows") + F.col("m"))
    return best.select(
        *by, "majority_class", share.alias("majority_share"), share.alias("accuracy"), f1.alias("f1")
    )


def majority_baseline_multilabel(df: DataFrame, labels: str, by=()) -> DataFrame:
    """Scores of predicting, for every row, the labels that at least half of the rows carry."""
    by = keys(by)
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    each = df.select(*by, F.explode(F.array_distinct(labels)).alias("_label"))
    counts = each.groupBy(*by, "_label").agg(F.count(F.lit(1)).alias("n"))
    counts = join_on(counts, rows, by) if by else counts.withColumn("n_rows", rows.scalar())
    prevalence = F.col("n") / F.col("n_rows")
    frequent = F.collect_list(F.when(prevalence >= 0.5, F.col("_label")))
    base = counts.groupBy(*by).agg(
        F.array_sort(frequent).alias("predicted"), F.max(prevalence).alias("majority_share")
    )
    told = df.select(*by, F.col(labels).alias("labels"))
    if by:
        told = lookup_join(told, base, by)
    else:
        told = told.withColumn("_b", base.select(F.struct("predicted", "majority_share")).scalar())
        told = told.select("labels", "_b.*")
    scores = metrics_multilabel(told, [*by, "majority_share"])
    return scores.select(*by, "majority_share", "accuracy", "f1")


def baseline_lift(model: DataFrame, base: DataFrame, by=()) -> DataFrame:
    """Gain of a model over the baseline and the verdict on it."""
    by = keys(by)
    named = base.select(*by, F.col("f1").alias("base_f1"), F.col("accuracy").alias("base_accuracy"))
    if by:
        joined = join_on(model.select(*by, "f1", "accuracy"), named, by)
    else:
        joined = model.select("f1", "accuracy", named.select(F.struct("*")).scalar().alias("b"))
        joined = joined.select("f1", "accuracy", "b.*")
    lift = F.col("f1") - F.col("base_f1")
    percent = F.when(F.col("base_f1") > 0, lift / F.col("base_f1") * 100).otherwise(F.lit(float("inf")))
    return joined.select(
        *by,
        "f1",
        "base_f1",
        lift.alias("f1_lift"),
        percent.alias("f1_lift_pct"),
        (F.col("accuracy") - F.col("base_accuracy")).alias("accuracy_lift"),
        lift_verdict(lift).alias("verdict"),
    )
