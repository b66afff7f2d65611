"""Tables in files, and the files written for readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def write_predictions(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Predictions as one file per partition; CSV gets a header and quoted quotes."""
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


NOTE = "Every entry is a decision made automatically, with the measurement that led to it."


def decisions_document(log: DataFrame) -> DataFrame:
    """The decision log as one document with its count and a note."""
    entry = F.struct(*log.columns)
    return log.agg(
        F.count(F.lit(1)).alias("total_decisions"),
        F.lit(NOTE).alias("note"),
        F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["decision_no"] < b["decision_no"], -1).otherwise(1)).alias("decisions"),
    )


def write_decisions(log: DataFrame, path: str) -> None:
    """A log of one table has at most six entries, so its document is one line of JSON."""
    decisions_document(log).write.mode("errorifexists").json(path)
