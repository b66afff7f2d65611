"""Scoring tables with a fitted model and presenting the predictions."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions.groups import keys, with_totals
from textlab.operators.metrics import THRESHOLD, argmax

PREVIEW_ROWS = 20
NO_LABEL = "(none)"


def _names(classes) -> Column:
    return F.array(*[F.lit(c) for c in classes])


def predict(model: PipelineModel, df: DataFrame, classes: list[str]) -> DataFrame:
    """Rows with the predicted class and the class probabilities in class order."""
    scored = model.transform(df)
    return scored.select(
        *df.columns,
        F.get(_names(classes), F.col("prediction").cast("int")).alias("prediction"),
        vector_to_array("probability").alias("p"),
    )


def ranked_classes(classes: list[str], k: int, p: str = "p") -> Column:
    """The ``k`` likeliest classes as (label, confidence); equal ones in class order."""
    keyed = F.transform(F.col(p), lambda x, i: F.struct((-x).alias("m"), i.alias("i")))
    best = F.slice(F.array_sort(keyed), 1, k)
    names = _names(classes)
    return F.transform(
        best, lambda x: F.struct(F.get(names, x["i"]).alias("label"), (-x["m"]).alias("confidence"))
    )


def percent(p: Column) -> Column:
    return F.bround(p * 100, 2)


def top_k(scored: DataFrame, classes: list[str], k: int = 3, p: str = "p") -> DataFrame:
    """``topN_label`` and ``topN_confidence`` per rank; ranks beyond the classes are empty."""
    told = scored.withColumn("_top", ranked_classes(classes, k, p))
    shown = []
    for i in range(k):
        item = F.get("_top", F.lit(i))
        shown.append(F.coalesce(item["label"], F.lit("")).alias(f"top{i + 1}_label"))
        shown.append(F.coalesce(percent(item["confidence"]), F.lit(0.0)).alias(f"top{i + 1}_confidence"))
    return told.select(*scored.columns, *shown)


def decode(scored: DataFrame, classes: list[str], p: str = "p") -> DataFrame:
    """Predicted label by name, and its confidence in per cent."""
    return scored.select(
        *scored.columns,
        F.get(_names(classes), argmax(F.col(p))).alias("predicted_label"),
        percent(F.array_max(p)).alias("confidence"),
    )


def decode_multilabel(scored: DataFrame, names: str = "names", p: str = "p") -> DataFrame:
    """Labels at or over the threshold, joined, and each with its confidence."""
    pairs = F.arrays_zip(F.col(names).alias("name"), F.col(p).alias("p"))
    chosen = F.filter(pairs, lambda x: x["p"] >= THRESHOLD)
    joined = F.array_join(F.transform(chosen, lambda x: x["name"]), ", ")
    detail = F.transform(chosen, lambda x: F.format_string("%s=%.1f%%", x["name"], F.bround(x["p"] * 100, 1)))
    return scored.select(
        *scored.columns,
        F.when(joined == "", NO_LABEL).otherwise(joined).alias("predicted_label"),
        F.array_join(detail, "; ").alias("label_confidences"),
    )


def prediction_distribution(decoded: DataFrame, by=(), label: str = "predicted_label") -> DataFrame:
    by = keys(by)
    counts = decoded.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    told = with_totals(counts, by, _total=F.sum("n"))
    return told.select(*by, label, "n", (F.col("n") * 100 / F.col("_total")).alias("pct"))


def preview_predictions(decoded: DataFrame, id_col: str, columns: list[str], n: int = PREVIEW_ROWS):
    return decoded.orderBy(id_col).limit(n).select(*columns)
