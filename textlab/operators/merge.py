"""Merging text columns into one and keeping texts within a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions.groups import keys
from textlab.functions.text import CHARS_PER_TOKEN, merged_text
from textlab.operators.profile import classify_columns, profile_columns, resolve_text_column

MAX_TOKENS = 512
KEEP = 0.8


def merged_name(df: DataFrame) -> str:
    """Name of the merged column, which must not hide a column of the table."""
    name = "combined_text"
    while name in df.columns:
        name += "_merged"
    return name


def merge_text(df: DataFrame, columns: list[str], name: str | None = None) -> DataFrame:
    return df.withColumn(name or merged_name(df), merged_text(columns))


def token_estimate(text: Column) -> Column:
    """Tokens of a text by its length; no tokenizer is involved."""
    return F.length(text) / CHARS_PER_TOKEN


def token_budget(df: DataFrame, text: str, max_tokens: int = MAX_TOKENS, by=()) -> DataFrame:
    """Average, largest and over-limit token counts."""
    used = token_estimate(F.col(text))
    over = F.count_if(used > max_tokens)
    return df.groupBy(*keys(by)).agg(
        F.avg(used).alias("avg_tokens"),
        F.max(used).alias("max_tokens"),
        over.alias("n_over"),
        (over * 100 / F.count(F.lit(1))).alias("pct_over"),
    )


def truncate_text(
    df: DataFrame, text: str, max_tokens: int = MAX_TOKENS, keep: float = KEEP, mode: str = "own"
) -> DataFrame:
    """Cut texts over the budget to ``keep`` of it.

    ``mode='own'`` leaves texts within the budget alone. ``mode='reference'`` cuts every text
    longer than the kept part as soon as any text of the table is over the budget.
    """
    column, limit = F.col(text), int(max_tokens * CHARS_PER_TOKEN * keep)
    shortened = F.substring(column, 1, limit)
    over = F.length(column) > max_tokens * CHARS_PER_TOKEN
    if mode == "reference":
        any_over = df.agg(F.coalesce(F.bool_or(over), F.lit(False)).alias("any")).scalar()
        cut = any_over & (F.length(column) > limit)
    else:
        cut = over
    return df.withColumn(text, F.when(cut, shortened).otherwise(column))


def auto_columns(profile: DataFrame) -> list[str]:
    """Categorical columns, shortest first, and the primary text column at the end."""
    kinds = classify_columns(profile)
    text = resolve_text_column(profile).first()["text_column"]
    found = kinds.filter(F.col("kind") == "categorical").orderBy("avg_length", "column").collect()
    return [r["column"] for r in found if r["column"] != text] + [text]


def auto_text(df: DataFrame, label: str, id_col: str) -> DataFrame:
    """Merge all categorical columns and the text column, chosen by profile."""
    return merge_text(df, auto_columns(profile_columns(df, exclude=[label, id_col])))
