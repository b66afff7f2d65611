"""Column profiles and the roles that columns play in a text table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions.groups import join_on, keys
from textlab.functions.text import text_key, word_count
from textlab.operators.ranks import sample_n, top_n

# Limits of the column classes.
ID_UNIQUENESS, ID_LENGTH, ID_WORDS = 0.85, 40, 1.3
TEXT_LENGTH, TEXT_TOP_SHARE = 20, 0.5
CATEGORY_LENGTH, CATEGORY_VALUES, CATEGORY_TOP_SHARE = 1, 2, 0.95
PROMOTED_LENGTH = 5
#: Standard error of the distinct counts and counters of the heavy-hitter sketch of approximate profiles.
DISTINCT_ERROR, TRACKED = 0.01, 12_288
#: Of a map of 16 384 places, three quarters of which are used as counters.
TOP_ERROR = 3.5 / 16_384


def profile_columns(df: DataFrame, exclude=(), by=(), approximate: bool = False) -> DataFrame:
    """One row per column: lengths, words, distinct values, uniqueness and top-value share.

    The columns are unpivoted to (column, value) and counted per value key, so one shuffle of
    32-byte keys, combined on the map side, serves all columns. ``approximate`` shuffles no values:
    distinct counts come from a sketch with a standard error of DISTINCT_ERROR, and top shares from
    a heavy-hitter sketch of TRACKED counters, within TOP_ERROR of the true share. Both are kept per
    task and merged.
    """
    by = keys(by)
    names = [c for c in df.columns if c not in set(by) | set(exclude)]
    texts = df.select(*by, *[F.col(c).cast("string").alias(c) for c in names])
    long = texts.unpivot(by, names, "column", "value")
    shown = F.coalesce("value", F.lit("nan"))
    measured = long.select(
        *by,
        "column",
        text_key(F.col("value")).alias("_key"),
        F.length(shown).cast("long").alias("_chars"),
        word_count(shown).cast("long").alias("_words"),
    )
    group = [*by, "column"]
    if approximate:
        stats = measured.groupBy(*group).agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count("_key").alias("non_null"),
            F.least(F.approx_count_distinct("_key", DISTINCT_ERROR), F.count("_key")).alias("num_unique"),
            F.sum("_chars").alias("_sum_chars"),
            F.sum("_words").alias("_sum_words"),
            F.min("_chars").alias("min_length"),
            F.max("_chars").alias("max_length"),
            # The sketch takes no binary values; nulls have a hash of their own.
            F.expr(f"coalesce(get(approx_top_k(xxhash64(_key), 1, {TRACKED}), 0).count, 1)").alias("_top"),
        )
    else:
        values = measured.groupBy(*group, "_key").agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("_chars").alias("_sum_chars"),
            F.sum("_words").alias("_sum_words"),
            F.min("_chars").alias("_min"),
            F.max("_chars").alias("_max"),
        )
        stats = values.groupBy(*group).agg(
            F.sum("_n").alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("_key").isNotNull(), F.col("_n"))), F.lit(0)).alias("non_null"),
            F.count("_key").alias("num_unique"),
            F.sum("_sum_chars").alias("_sum_chars"),
            F.sum("_sum_words").alias("_sum_words"),
            F.min("_min").alias("min_length"),
            F.max("_max").alias("max_length"),
            F.max("_n").alias("_top"),
        )
    n = F.col("n_rows")
    return stats.select(
        *group,
        "n_rows",
        "non_null",
        "num_unique",
        (F.col("num_unique") / F.greatest(n, F.lit(1))).alias("uniqueness"),
        (F.col("_sum_chars") / n).alias("avg_length"),
        "min_length",
        "max_length",
        (F.col("_sum_words") / n).alias("avg_words"),
        (F.col("_top") / n).alias("top_share"),
    )


def column_kind() -> Column:
    """Class of a profiled column: id, text, categorical or ignored, tested in this order."""
    is_id = (
        (F.col("uniqueness") > ID_UNIQUENESS)
        & (F.col("avg_length") < ID_LENGTH)
        & (F.col("avg_words") <= ID_WORDS)
    )
    is_category = (
        (F.col("avg_length") > CATEGORY_LENGTH)
        & (F.col("num_unique") >= CATEGORY_VALUES)
        & (F.col("top_share") <= CATEGORY_TOP_SHARE)
    )
    return (
        F.when(is_id, "id")
        .when(F.col("avg_length") > TEXT_LENGTH, "text")
        .when(is_category, "categorical")
        .otherwise("ignored")
    )


def classify_columns(profile: DataFrame) -> DataFrame:
    """Profile with the class of each column and a note on near-constant text."""
    constant = (F.col("kind") == "text") & (F.col("top_share") > TEXT_TOP_SHARE)
    return profile.withColumn("kind", column_kind()).withColumn("near_constant", constant)


def resolve_text_column(profile: DataFrame, by=()) -> DataFrame:
    """The primary text column, and how it was found: detected, promoted or fallback.

    The longest text column; without one the longest categorical, else the longest column that
    is no id and averages at least 5 characters (``usable``).
    """
    rank = F.when(F.col("kind") == "text", 0).when(F.col("kind") == "categorical", 1).otherwise(2)
    ranked = classify_columns(profile).filter("kind <> 'id' and avg_length > 0").withColumn("_class", rank)
    best = top_n(ranked, [F.col("_class"), F.desc("avg_length"), F.col("column")], 1, by)
    how = F.element_at(F.array(F.lit("detected"), F.lit("promoted"), F.lit("fallback")), F.col("_class") + 1)
    return best.select(
        *keys(by),
        F.col("column").alias("text_column"),
        "avg_length",
        how.alias("found"),
        ((F.col("_class") < 2) | (F.col("avg_length") >= PROMOTED_LENGTH)).alias("usable"),
    )


def detect_text_column(profile: DataFrame, by=()) -> DataFrame:
    """The column with the longest average, whatever its class (used when scoring)."""
    best = F.max_by("column", F.struct("avg_length", "column"))
    return profile.groupBy(*keys(by)).agg(
        best.alias("text_column"), F.max("avg_length").alias("avg_length")
    )


def text_column_of(df: DataFrame, label: str, id_col: str | None = None) -> str:
    """Name of the text column of ``df``; raises if no column can serve."""
    exclude = [c for c in (label, id_col) if c]
    row = resolve_text_column(profile_columns(df, exclude)).first()
    if row is None:
        raise ValueError("no column besides the label can serve as text")
    if not row["usable"]:
        raise ValueError(
            f"all columns are too short to be text; the best is '{row['text_column']}' with "
            f"{row['avg_length']:.1f} characters on average"
        )
    return row["text_column"]


def leakage_columns(profile: DataFrame, columns: list[str]) -> DataFrame:
    """Near-unique short columns among those to be merged: they may identify the row."""
    return profile.filter(
        F.col("column").isin(columns)
        & (F.col("uniqueness") > ID_UNIQUENESS)
        & (F.col("avg_length") < ID_LENGTH)
    )


def preview_stats(df: DataFrame, label: str, text: str, by=()) -> DataFrame:
    """Rows, classes, average text length and missing cells of the whole table, in one pass."""
    by = keys(by)
    missing = sum(F.col(c).isNull().cast("long") for c in df.columns)
    shown = F.length(F.coalesce(F.col(text).cast("string"), F.lit("nan"))).cast("long")
    per_class = df.groupBy(*by, F.col(label).alias("_label")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(shown).alias("chars"), F.sum(missing).alias("gaps")
    )
    return per_class.groupBy(*by).agg(
        F.sum("n").alias("n_rows"),
        F.count("_label").alias("n_classes"),
        F.floor(F.sum("chars") / F.sum("n")).alias("avg_text_length"),
        F.sum("gaps").alias("missing_cells"),
    )


def preview_rows(df: DataFrame, id_col: str, n: int = 10) -> DataFrame:
    return df.orderBy(id_col).limit(n)
