"""Losses of a scored table as numbers, weighted per class.

``scored`` has ``label`` and ``p`` in the order of ``classes``; ``weights`` is the class table
of ``class_weights`` or ``None``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions.groups import keys
from textlab.operators.labels import attach_weights


def true_probability(classes: list[str], label: str = "label", p: str = "p") -> Column:
    names = F.array(*[F.lit(c) for c in classes])
    return F.get(F.col(p), F.array_position(names, F.col(label)).cast("int") - 1)


#: Probabilities are kept this far from 0 and 1, where the logarithm has no value.
EDGE = 1e-15


def clipped(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1 - EDGE)), F.lit(EDGE))


def _weighted(scored: DataFrame, classes: list[str], weights: DataFrame | None) -> DataFrame:
    # A label that is none of the classes has probability 0, so it costs as much as can be.
    told = scored.withColumn("_p", clipped(F.coalesce(true_probability(classes), F.lit(0.0))))
    return told.withColumn("weight", F.lit(1.0)) if weights is None else attach_weights(told, weights)


def cross_entropy(scored: DataFrame, classes: list[str], weights=None, by=()) -> DataFrame:
    """Mean of ``-ln p`` weighted by class: divided by the sum of the weights."""
    told = _weighted(scored, classes, weights)
    loss = F.sum(-F.col("weight") * F.ln("_p")) / F.sum("weight")
    return told.groupBy(*keys(by)).agg(F.count(F.lit(1)).alias("n_rows"), loss.alias("cross_entropy"))


def focal_loss(scored: DataFrame, classes: list[str], gamma: float = 2.0, weights=None, by=()) -> DataFrame:
    """Mean of ``(1 - p)^gamma * w * -ln p``: divided by the rows."""
    told = _weighted(scored, classes, weights)
    loss = F.avg(F.pow(1 - F.col("_p"), F.lit(gamma)) * F.col("weight") * -F.ln("_p"))
    return told.groupBy(*keys(by)).agg(F.count(F.lit(1)).alias("n_rows"), loss.alias("focal_loss"))


def bce_loss(scored: DataFrame, pos_weight: DataFrame, by=()) -> DataFrame:
    """Mean binary cross-entropy over rows and labels, positives weighted per label.

    ``scored`` has ``labels``, ``names`` and ``p`` as arrays.
    """
    by = keys(by)
    pairs = F.arrays_zip(F.col("names").alias("label"), F.col("p").alias("p"))
    long = scored.select(*by, "labels", F.explode(pairs).alias("x")).select(
        *by, F.col("x.label").alias("label"), F.array_contains("labels", F.col("x.label")).alias("y"),
        F.col("x.p").alias("p"),
    )
    long = long.withColumn("p", clipped(F.col("p")))
    told = attach_weights(long, pos_weight.withColumnRenamed("pos_weight", "weight"))
    loss = F.when(F.col("y"), -F.col("weight") * F.ln("p")).otherwise(-F.ln(1 - F.col("p")))
    return told.groupBy(*by).agg(F.count(F.lit(1)).alias("n_terms"), F.avg(loss).alias("bce_loss"))
