"""Structured Streaming: score rows as they arrive, and count labels per window."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textlab.operators.predict import predict


def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def table_stream(spark: SparkSession, folder: str, name: str, schema, files_per_batch: int = 100) -> DataFrame:
    """A table as a stream, be it one file or a folder of files."""
    # A pattern, as a stream takes a plain path for a folder.
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder.rstrip('/')}/{{{name}.parquet}}")


def predict_stream(model: PipelineModel, stream: DataFrame, classes: list[str]) -> DataFrame:
    """The batch scoring plan on a stream; it keeps no state."""
    return predict(model, stream, classes)


def label_windows(df: DataFrame, label: str, ts: str, window: str = "1 day") -> DataFrame:
    """Rows per label and tumbling window."""
    counted = df.groupBy(F.window(ts, window), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "label", "n"
    )


def distribution_stream(
    stream: DataFrame, label: str, ts: str, path: str, checkpoint: str, window: str = "1 day"
) -> StreamingQuery:
    """Count rows per label and tumbling window as they arrive, however late and in any order.

    The counts of each batch are a folder of their own under ``path``, which a repeated batch
    writes anew, so every row counts once; no state is kept and no row comes too late.
    """

    def add(batch: DataFrame, number: int) -> None:
        label_windows(batch, label, ts, window).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def distribution(spark: SparkSession, path: str) -> DataFrame:
    """The counts so far: the sum over the batches."""
    counts = spark.read.parquet(path)
    return counts.groupBy("window_start", "window_end", "label").agg(F.sum("n").alias("n"))


def write_stream(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there, then stop. The checkpoint makes a restart continue, not repeat."""
    return (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
