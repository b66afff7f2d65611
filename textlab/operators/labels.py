"""Label analytics: distribution, imbalance, weights, encodings and label lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions.groups import join_on, keys, lookup_join, with_totals
from textlab.functions.labels import label_rows
from textlab.operators.classes import atomic_classes, class_dictionary, hot_vector, label_sets
from textlab.operators.classes import decode_id_lists as names_of_ids

WEIGHT_RATIO = 2.0
FOCAL_RATIO = 5.0
POS_WEIGHT_CAP = 50.0


def class_counts(df: DataFrame, label: str, by=(), multi_label: bool = False) -> DataFrame:
    """``(by, label, n)``: the class table from which the label operators derive."""
    by = keys(by)
    rows = label_rows(df, label, multi_label, by).filter("label is not null")
    return rows.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))


def class_distribution(df: DataFrame, label: str, by=(), multi_label: bool = False) -> DataFrame:
    counts = class_counts(df, label, by, multi_label)
    shares = with_totals(counts, by, total=F.sum("n"))
    return shares.select(*keys(by), "label", "n", (F.col("n") / F.col("total")).alias("share"))


def label_frequencies(df: DataFrame, label: str, by=()) -> DataFrame:
    """Frequency of each atomic label and its share of the rows (not of the labels)."""
    by = keys(by)
    counts = class_counts(df, label, by, multi_label=True)
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    if by:
        joined = join_on(counts, rows, by)
    else:
        joined = counts.withColumn("n_rows", rows.scalar())
    return joined.select(*by, "label", "n", (F.col("n") / F.col("n_rows")).alias("prevalence"))


def is_number(label: Column) -> Column:
    number = label.try_cast("double")
    return number.isNotNull() & ~F.isnan(number)


def detect_task(df: DataFrame, label: str, by=(), multi_label: bool = False) -> DataFrame:
    classes = class_counts(df, label, by, multi_label)
    facts = classes.groupBy(*keys(by)).agg(
        F.count(F.lit(1)).alias("num_classes"),
        F.sum("n").alias("label_count"),
        F.bool_and(is_number(F.col("label"))).alias("_numeric"),
    )
    if multi_label:
        task, kind = F.lit("multi_label"), F.lit("categorical")
    else:
        task = F.when(F.col("num_classes") == 2, "binary").otherwise("multiclass")
        kind = F.when(F.col("_numeric"), "numeric").otherwise("categorical")
    return facts.select(
        *keys(by), task.alias("task_type"), kind.alias("label_type"), "num_classes", "label_count"
    )


def imbalance(df: DataFrame, label: str, by=(), multi_label: bool = False) -> DataFrame:
    """Largest to smallest class, minority share of the rows, and what follows from them."""
    by = keys(by)
    sizes = class_counts(df, label, by, multi_label).groupBy(*by).agg(
        F.max("n").alias("max_class"), F.min("n").alias("min_class"), F.sum("n").alias("n_labels")
    )
    if multi_label:
        rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
        if by:
            sizes = join_on(sizes, rows, by)
        else:
            sizes = sizes.withColumn("n_rows", rows.scalar())
    else:
        sizes = sizes.withColumn("n_rows", F.col("n_labels"))
    ratio = F.col("max_class") / F.col("min_class")
    return sizes.select(
        *by,
        "max_class",
        "min_class",
        ratio.alias("imbalance_ratio"),
        (F.col("min_class") / F.col("n_rows")).alias("minority_share"),
        (ratio > WEIGHT_RATIO).alias("use_class_weights"),
        (F.lit(not multi_label) & (ratio > FOCAL_RATIO)).alias("use_focal_loss"),
    )


def weights_from_counts(counts: DataFrame, by=()) -> DataFrame:
    """Inverse frequency ``n / (k * n_c)`` per class, scaled so that the largest is 1."""
    totals = with_totals(counts, by, total=F.sum("n"), k=F.count(F.lit(1)), least=F.min("n"))
    raw = F.col("total") / (F.col("k") * F.col("n"))
    largest = F.col("total") / (F.col("k") * F.col("least"))
    return totals.select(*keys(by), "label", "n", (raw / largest).alias("weight"))


def class_weights(df: DataFrame, label: str, by=()) -> DataFrame:
    return weights_from_counts(class_counts(df, label, by), by)


def pos_weights(df: DataFrame, label: str, by=()) -> DataFrame:
    """Negatives to positives per atomic label, each at least 1, capped at 50."""
    by = keys(by)
    counts = class_counts(df, label, by, multi_label=True)
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    joined = join_on(counts, rows, by) if by else counts.withColumn("n_rows", rows.scalar())
    negative = F.greatest(F.col("n_rows") - F.col("n"), F.lit(1))
    positive = F.greatest(F.col("n"), F.lit(1))
    weight = F.least(negative / positive, F.lit(POS_WEIGHT_CAP))
    return joined.select(*by, "label", F.col("n").alias("n_pos"), weight.alias("pos_weight"))


def samples_per_class(df: DataFrame, label: str, by=(), multi_label: bool = False) -> DataFrame:
    """Rows per class (for tiers) and label occurrences per class (for recommendations)."""
    by = keys(by)
    sizes = class_counts(df, label, by, multi_label).groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_classes"), F.sum("n").alias("label_count")
    )
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    joined = join_on(sizes, rows, by) if by else sizes.withColumn("n_rows", rows.scalar())
    k = F.greatest(F.col("num_classes"), F.lit(1))
    return joined.select(
        *by,
        "n_rows",
        "label_count",
        "num_classes",
        (F.col("n_rows") / k).alias("rows_per_class"),
        (F.col("label_count") / k).alias("labels_per_class"),
    )


def class_dispersion(df: DataFrame, label: str, by=(), multi_label: bool = False) -> DataFrame:
    sizes = class_counts(df, label, by, multi_label).groupBy(*keys(by)).agg(
        F.avg("n").alias("mean_size"),
        F.stddev_pop("n").alias("std_size"),
        F.min("n").alias("min_size"),
        F.max("n").alias("max_size"),
    )
    variation = F.when(F.col("mean_size") > 0, F.col("std_size") / F.col("mean_size")).otherwise(0.0)
    return sizes.withColumn("variation", variation)


def attach_weights(df: DataFrame, weights: DataFrame, label: str = "label") -> DataFrame:
    """Weight of each row's class; 1.0 for a class without one."""
    table = weights.filter(F.col("label").isNotNull()).select(F.col("label").alias(label), "weight")
    joined = lookup_join(df, table, label, "left")
    return joined.select(*df.columns, F.coalesce("weight", F.lit(1.0)).alias("weight"))


def unseen_labels(train: DataFrame, val: DataFrame, label: str) -> DataFrame:
    """Classes of ``val`` that ``train`` lacks."""
    return val.select(label).distinct().join(train.select(label).distinct(), label, "left_anti")


def index_labels(df: DataFrame, label: str) -> DataFrame:
    """``(label, class_id)`` by sorted label: the table behind encoding and decoding."""
    return class_dictionary(df, label)


def encode_labels(df: DataFrame, label: str, classes: DataFrame) -> DataFrame:
    return lookup_join(df, classes.select(F.col("label").alias(label), "class_id"), label, "left")


def decode_ids(df: DataFrame, classes: DataFrame, id_column: str = "class_id") -> DataFrame:
    """Class name of each class id (inner join on the class table)."""
    table = classes.select(F.col("class_id").alias(id_column), F.col("label").alias("decoded"))
    return lookup_join(df.filter(F.col(id_column).isNotNull()), table, id_column)


def decode_id_lists(df: DataFrame, classes: DataFrame, ids: str = "class_ids") -> DataFrame:
    """Class names of a list of class ids."""
    return names_of_ids(df, classes, ids)


def atomic_labels(df: DataFrame, label: str) -> DataFrame:
    """``(label, class_id)`` of the atomic labels of a multi-label column, over all rows."""
    return atomic_classes(df, label)


def multi_hot(df: DataFrame, label: str) -> DataFrame:
    """0/1 vector over the sorted atomic labels of all rows, as long as there are labels.

    Where labels are many, ``label_sets`` gives the same as the ids of the labels of a row.
    """
    classes = atomic_classes(df, label)
    found = label_sets(df, label, classes, "_ids")
    return found.select(*df.columns, hot_vector(F.col("_ids"), classes.count()).alias("multi_hot"))
