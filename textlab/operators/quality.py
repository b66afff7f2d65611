"""Data-quality audit of a labelled text table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.functions.groups import join_on, keys, salted_join, with_totals
from textlab.functions.labels import parse_labels
from textlab.functions.text import bar, normalise, strip, text_key
from textlab.operators.labels import class_counts

SHORT_TEXT = 5
TINY_CLASS = 20
MULTI_LABEL_SHARE = 0.05
BAR_WIDTH = 30


def _text(df: DataFrame, text: str):
    return F.coalesce(F.col(text).cast("string"), F.lit("nan"))


def short_texts(df: DataFrame, text: str, n: int = SHORT_TEXT, by=()) -> DataFrame:
    short = F.length(strip(_text(df, text))) < n
    counts = df.groupBy(*keys(by)).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(short).alias("n_short")
    )
    return counts.withColumn("pct_short", F.col("n_short") * 100 / F.col("n_rows"))


def text_groups(df: DataFrame, text: str, label: str, by=()) -> DataFrame:
    """Rows and distinct labels per normalised text: one aggregate for both text checks.

    The shuffle carries a 32-byte key, the label and a count, combined on the map side.
    """
    by = keys(by)
    pairs = df.select(
        *by,
        text_key(normalise(_text(df, text))).alias("text_key"),
        F.coalesce(F.col(label).cast("string"), F.lit("nan")).alias("_label"),
    )
    per_label = pairs.groupBy(*by, "text_key", "_label").agg(F.count(F.lit(1)).alias("n"))
    return per_label.groupBy(*by, "text_key").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_labels")
    )


def text_checks(df: DataFrame, text: str, label: str, by=()) -> DataFrame:
    """Rows in near-duplicate groups, and normalised texts with conflicting labels."""
    return text_groups(df, text, label, by).groupBy(*keys(by)).agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("near_duplicates"),
        F.count_if(F.col("n_labels") > 1).alias("label_conflicts"),
    )


def near_duplicate_count(df: DataFrame, text: str, by=()) -> DataFrame:
    """Rows whose normalised text occurs more than once, and the number of such texts."""
    by = keys(by)
    groups = df.groupBy(*by, text_key(normalise(_text(df, text))).alias("text_key")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return groups.groupBy(*by).agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_texts"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("near_duplicates"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
    )


def near_duplicates(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """The near-duplicate rows themselves, with the group's key and size.

    Groups are counted on keys only; the join back by key carries the id, not the text. The rows
    of a large group are dealt out over many join keys, see ``salted_join``.
    """
    keyed = df.select(F.col(id_col), text_key(normalise(_text(df, text))).alias("text_key"))
    groups = (
        keyed.groupBy("text_key").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    )
    found = salted_join(keyed, groups, ["text_key"])
    return found.select(id_col, F.hex("text_key").alias("text_key"), "group_size")


def label_conflicts(df: DataFrame, text: str, label: str, by=()) -> DataFrame:
    """Normalised texts that carry more than one label."""
    groups = text_groups(df, text, label, by).filter("n_labels > 1")
    return groups.select(*keys(by), F.hex("text_key").alias("text_key"), "n", "n_labels")


def has_several_labels(df: DataFrame, label: str) -> DataFrame:
    """Share of rows that parse to several labels; above 5 % the audit counts atomic labels."""
    several = F.avg((F.size(parse_labels(df, label)) > 1).cast("int"))
    return df.agg(several.alias("share_several"), (several > MULTI_LABEL_SHARE).alias("atomic"))


def tiny_classes(
    df: DataFrame, label: str, n: int = TINY_CLASS, by=(), multi_label: bool | None = None
) -> DataFrame:
    """Classes with fewer than ``n`` rows. ``multi_label=None`` applies the 5 % rule."""
    if multi_label is None:
        multi_label = bool(has_several_labels(df, label).first()["atomic"])
    return class_counts(df, label, by, multi_label).filter(F.col("n") < n)


def quality_report(
    df: DataFrame, text: str, label: str, by=(), multi_label: bool = False
) -> DataFrame:
    """All findings as rows ``(check, subject, n)``; each tiny class is a finding of its own.

    Two passes: one aggregate over the texts and labels, one over the classes.
    """
    by = keys(by)
    short = F.length(strip(_text(df, text))) < SHORT_TEXT
    pairs = df.select(
        *by,
        text_key(normalise(_text(df, text))).alias("text_key"),
        F.coalesce(F.col(label).cast("string"), F.lit("nan")).alias("_label"),
        short.cast("long").alias("_short"),
    )
    per_label = pairs.groupBy(*by, "text_key", "_label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_short").alias("n_short")
    )
    per_text = per_label.groupBy(*by, "text_key").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_labels"), F.sum("n_short").alias("n_short")
    )
    totals = per_text.groupBy(*by).agg(
        F.sum("n_short").alias("s"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("d"),
        F.count_if(F.col("n_labels") > 1).alias("c"),
    )
    checks = [("short texts", "s"), ("near duplicates", "d"), ("label conflicts", "c")]
    findings = [
        F.struct(F.lit(name).alias("check"), F.lit("").alias("subject"), F.col(c).alias("n"))
        for name, c in checks
    ]
    text_rows = totals.select(*by, F.inline(F.array(*findings))).filter("n > 0")
    tiny = tiny_classes(df, label, by=by, multi_label=multi_label).select(
        *by, F.lit("tiny class").alias("check"), F.col("label").alias("subject"), "n"
    )
    return text_rows.unionByName(tiny)


def quality_verdict(df: DataFrame, report: DataFrame, by=()) -> DataFrame:
    """Number of warnings and whether the audit passed, also for groups without findings."""
    by = keys(by)
    found = report.groupBy(*by).agg(F.count(F.lit(1)).alias("total_warnings"))
    if by:
        found = join_on(df.select(*by).distinct(), found, by, "left")
    total = F.coalesce("total_warnings", F.lit(0))
    return found.select(*by, total.alias("total_warnings"), (total == 0).alias("passed"))


def class_bars(df: DataFrame, label: str, by=(), multi_label: bool = False) -> DataFrame:
    """Bars for the class distribution: of the largest class, and of the total."""
    sized = with_totals(
        class_counts(df, label, by, multi_label), by, largest=F.max("n"), total=F.sum("n")
    )
    return sized.select(
        *keys(by),
        "label",
        "n",
        bar(F.col("n") / F.col("largest"), BAR_WIDTH).alias("bar_of_largest"),
        bar(F.col("n") / F.col("total"), BAR_WIDTH).alias("bar_of_total"),
    )
