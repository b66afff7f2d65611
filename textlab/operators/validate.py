"""Validation and cleaning of a labelled text table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.functions.groups import join_on, keys
from textlab.functions.labels import DELIMITER, is_list, label_rows, parse_labels
from textlab.functions.text import is_blank, text_key

MIN_ROWS = 100
MAX_NULL_RATIO = 0.95
MULTI_LABEL_SHARE = 0.10
REGRESSION_CLASSES = 20
REGRESSION_RATIO = 0.2
MANY_CLASSES = 20
VERY_MANY_CLASSES = 50
ROWS_PER_CLASS = 50


def _kept(df: DataFrame, label: str, text: str):
    """Flags of the rows that remain after the null drops and after the blank drop."""
    has_label = ~_missing(df, label)
    has_text = ~_missing(df, text)
    return has_label, has_text, ~is_blank(F.col(text).cast("string"))


def _missing(df: DataFrame, name: str):
    column = F.col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def row_guard(df: DataFrame, label: str, text: str, n: int = MIN_ROWS, by=()) -> DataFrame:
    """Rows left after loading, null drop and blank drop, each compared with the minimum."""
    has_label, has_text, not_blank = _kept(df, label, text)
    present = has_label & has_text
    counts = df.groupBy(*keys(by)).agg(
        F.count(F.lit(1)).alias("loaded"),
        F.count_if(present).alias("after_nulls"),
        F.count_if(present & not_blank).alias("after_blanks"),
    )
    stages = ["loaded", "after_nulls", "after_blanks"]
    return counts.select("*", *[(F.col(s) >= n).alias(s + "_ok") for s in stages])


def require_min_rows(df: DataFrame, n: int = MIN_ROWS, stage: str = "loading") -> DataFrame:
    """Raise if ``df`` has fewer than ``n`` rows; reads no more than ``n`` of them."""
    found = df.limit(n).count()
    if found < n:
        raise ValueError(f"{found} rows after {stage}, at least {n} are required")
    return df


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        hint = ""
        if df.columns and all(_looks_numeric(c) for c in df.columns):
            hint = " All column names are numbers: the file may lack a header row."
        raise ValueError(f"column(s) {missing} not found, there are {df.columns}.{hint}")
    return df


def _looks_numeric(name: str) -> bool:
    try:
        return float(name) == float(name)
    except ValueError:
        return False


def null_ratio(df: DataFrame, columns: list[str], by=()) -> DataFrame:
    """Share of nulls per column, all columns in one pass, and whether it is too high."""
    by = keys(by)
    shares = df.groupBy(*by).agg(
        *[F.avg(_missing(df, c).cast("int")).alias(c) for c in columns]
    )
    long = shares.unpivot(by, columns, "column", "null_ratio")
    return long.withColumn("too_empty", F.col("null_ratio") > MAX_NULL_RATIO)


def require_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    empty = null_ratio(df, columns).filter("too_empty").collect()
    if empty:
        names = ", ".join(f"{r['column']} ({r['null_ratio']:.0%})" for r in empty)
        raise ValueError(f"column(s) almost entirely null: {names}")
    return df


def multi_label_check(df: DataFrame, label: str) -> DataFrame:
    """Does the label hold several labels per row? Judged on all values, in one aggregate."""
    if is_list(df, label):
        has_several = F.col(label).isNotNull()
    else:
        has_several = F.col(label).cast("string").rlike(DELIMITER)
    told = df.filter(~_missing(df, label)).select(has_several.alias("delimited"))
    return told.agg(
        F.count(F.lit(1)).alias("n_values"),
        F.count_if("delimited").alias("n_delimited"),
        F.coalesce(F.avg(F.col("delimited").cast("int")) > MULTI_LABEL_SHARE, F.lit(False)).alias(
            "is_multi_label"
        ),
    )


def is_multi_label(df: DataFrame, label: str) -> bool:
    return is_list(df, label) or multi_label_check(df, label).first()["is_multi_label"]


def regression_guard(df: DataFrame, label: str, by=()) -> DataFrame:
    """Numeric label with many distinct values: a regression target, not a class."""
    numeric = isinstance(df.schema[label].dataType, T.NumericType)
    counts = df.groupBy(*keys(by)).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(label).alias("n_distinct")
    )
    ratio = F.col("n_distinct") / F.greatest(F.col("n_rows"), F.lit(1))
    return counts.select(
        "*",
        ratio.alias("distinct_ratio"),
        (
            F.lit(numeric)
            & (F.col("n_distinct") > REGRESSION_CLASSES)
            & (ratio > REGRESSION_RATIO)
        ).alias("is_regression"),
    )


def require_classification(df: DataFrame, label: str) -> DataFrame:
    if isinstance(df.schema[label].dataType, T.NumericType):
        row = regression_guard(df, label).first()
        if row["is_regression"]:
            raise ValueError(
                f"label '{label}' looks continuous: {row['n_distinct']} distinct numbers in "
                f"{row['n_rows']} rows; cast it to string if these are classes"
            )
    return df


def normalise_label(df: DataFrame, label: str) -> DataFrame:
    """Labels as strings; whole numbers lose their fraction part, missing stays missing."""
    kind = df.schema[label].dataType
    column = F.col(label)
    if isinstance(kind, T.IntegralType):
        return df.withColumn(label, column.cast("string"))
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        return df
    missing = _missing(df, label)
    whole = df.agg(
        F.coalesce(F.bool_and(F.when(~missing, column == F.floor(column))), F.lit(False)).alias("w")
    ).scalar()
    text = F.when(whole, column.cast("long").cast("string")).otherwise(column.cast("string"))
    return df.withColumn(label, F.when(~missing, text))


def drop_missing(df: DataFrame, label: str, text: str) -> DataFrame:
    return df.filter(~_missing(df, label) & ~_missing(df, text))


def drop_blank(df: DataFrame, text: str) -> DataFrame:
    return df.filter(~is_blank(F.col(text).cast("string")))


def dedup_text(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """Keep the row with the lowest ``id_col`` (unique) of every distinct text.

    Only a 32-byte key and the id are grouped, with map-side combine, so a text that fills a
    third of the table is no hot spot; the rows themselves move once, by their unique id.
    """
    survivors = (
        df.select(F.col(id_col), text_key(F.col(text).cast("string")).alias("_key"))
        .groupBy("_key")
        .agg(F.min(id_col).alias(id_col))
        .select(id_col)
    )
    return df.join(survivors, id_col, "left_semi")


def dedup_report(df: DataFrame, text: str, by=()) -> DataFrame:
    """Rows, distinct texts and what deduplication removes, as count and per cent."""
    counts = df.groupBy(*keys(by)).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(text_key(F.col(text).cast("string"))).alias("n_distinct"),
    )
    removed = F.col("n_rows") - F.col("n_distinct")
    return counts.select(
        "*", removed.alias("n_removed"), (removed * 100 / F.col("n_rows")).alias("pct_removed")
    )


def class_checks(df: DataFrame, label: str, by=(), multi_label: bool = False) -> DataFrame:
    """Class count, smallest class, rows per class, the two guards and the size warnings."""
    by = keys(by)
    classes = label_rows(df, label, multi_label, by).groupBy(*by, "label").count()
    per = classes.filter("label is not null").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.sum("count").alias("n_rows"),
        F.min("count").alias("min_class"),
        F.min_by("label", F.struct("count", "label")).alias("smallest_class"),
    )
    rows_per_class = F.col("n_rows") / F.col("n_classes")
    crowded = (F.col("n_classes") > MANY_CLASSES) & (rows_per_class < ROWS_PER_CLASS)
    return per.select(
        "*",
        rows_per_class.alias("rows_per_class"),
        (F.col("n_classes") >= 2).alias("enough_classes"),
        (F.lit(multi_label) | (F.col("min_class") >= 2)).alias("enough_per_class"),
        F.when(crowded, "many classes, few rows each")
        .when(F.col("n_classes") > VERY_MANY_CLASSES, "very many classes")
        .otherwise("none")
        .alias("warning"),
    )


def require_classes(df: DataFrame, label: str, multi_label: bool = False) -> DataFrame:
    """Raise unless there are two classes and, for single labels, two rows in each."""
    row = class_checks(df, label, multi_label=multi_label).first()
    if row["n_classes"] < 2:
        raise ValueError(f"label '{label}' has {row['n_classes']} class(es), 2 are required")
    if not row["enough_per_class"]:
        raise ValueError(
            f"class '{row['smallest_class']}' has {row['min_class']} row(s); a stratified "
            f"split needs 2"
        )
    return df


def cleaning_funnel(df: DataFrame, label: str, text: str, by=()) -> DataFrame:
    """Rows entering and leaving every cleaning stage, from one conditional aggregate."""
    by = keys(by)
    has_label, has_text, not_blank = _kept(df, label, text)
    clean = has_label & has_text & not_blank
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("c0"),
        F.count_if(has_label).alias("c1"),
        F.count_if(has_label & has_text).alias("c2"),
        F.count_if(clean).alias("c3"),
        F.countDistinct(F.when(clean, text_key(F.col(text).cast("string")))).alias("c4"),
    )
    names = ["drop null label", "drop null text", "drop blank text", "drop duplicate text"]
    steps = [
        F.struct(
            F.lit(i + 1).alias("stage_no"),
            F.lit(name).alias("stage"),
            F.col(f"c{i}").alias("rows_in"),
            F.col(f"c{i + 1}").alias("rows_out"),
            (F.col(f"c{i}") - F.col(f"c{i + 1}")).alias("dropped"),
        )
        for i, name in enumerate(names)
    ]
    return counts.select(*by, F.inline(F.array(*steps)))


def clean(df: DataFrame, label: str, text: str, id_col: str, dedup_on: str | None = None) -> DataFrame:
    """Null drop, blank drop and keep-first deduplication, in this order."""
    kept = drop_blank(drop_missing(df, label, text), text)
    return dedup_text(kept, dedup_on or text, id_col)


def basic_stats(df: DataFrame, label: str, text: str, by=()) -> DataFrame:
    """Rows, classes and text length per group; the distribution is ``class_distribution``."""
    length = F.length(F.coalesce(F.col(text).cast("string"), F.lit("nan")))
    by = keys(by)
    per_class = df.groupBy(*by, F.col(label).alias("_label")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(length.cast("long")).alias("chars"),
        F.min(length).alias("lo"),
        F.max(length).alias("hi"),
    )
    return per_class.groupBy(*by).agg(
        F.sum("n").alias("num_rows"),
        F.count("_label").alias("num_classes"),
        (F.sum("chars") / F.sum("n")).alias("avg_text_length"),
        F.min("lo").alias("min_text_length"),
        F.max("hi").alias("max_text_length"),
    )
