"""Label expressions: single labels, delimited labels and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.functions.text import strip

DELIMITER = "[,|]"


def is_list(df: DataFrame, label: str) -> bool:
    return isinstance(df.schema[label].dataType, T.ArrayType)


def parse_labels(df: DataFrame, label: str) -> Column:
    """List of trimmed, non-empty labels from a delimited string or from a list."""
    if is_list(df, label):
        parts = F.transform(F.col(label), lambda x: strip(x.cast("string")))
    else:
        parts = F.transform(F.split(F.col(label).cast("string"), DELIMITER), strip)
    return F.filter(parts, lambda x: x != "")


def label_rows(df: DataFrame, label: str, multi_label: bool, keep=()) -> DataFrame:
    """One row per label: the column itself, or one row per parsed label of a list."""
    if multi_label:
        value = F.explode(parse_labels(df, label))
    else:
        value = F.col(label).cast("string")
    return df.select(*keep, value.alias("label"))
