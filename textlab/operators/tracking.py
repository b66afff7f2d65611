"""State of runs, from an append-only table of step events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The steps of a run, in order.
STEPS = [
    "data_validation",
    "data_intelligence",
    "data_preparation",
    "model_training",
    "model_evaluation",
    "best_model_selection",
    "report_generation",
]


def run_state(events: DataFrame) -> DataFrame:
    """Status, start, end and error of every step of every run.

    ``events`` is ``(run, step, status, ts, error)``; an event without a step concerns the run.
    A step without events is pending. Steps of other names follow the seven, by name. If a run
    failed as a whole, its first step still running failed with it. Two map-side combined
    aggregates; a run keeps a row per step.
    """
    ended = F.col("status").isin("completed", "failed")
    failed = F.col("status") == "failed"
    latest = events.groupBy("run", "step").agg(
        F.max(F.struct("ts", "status")).alias("last"),
        F.max(F.when(F.col("status") == "running", F.col("ts"))).alias("begun"),
        F.max(F.when(ended, F.col("ts"))).alias("finished_at"),
        F.max(F.when(failed, F.struct("ts", "error"))).alias("fault"),
    )
    runs = latest.groupBy("run").agg(
        F.collect_list(F.when(F.col("step").isNotNull(), F.struct("step", "last", "begun", "finished_at", "fault"))).alias("steps"),
        F.max(F.when(F.col("step").isNull() & (F.col("last.status") == "failed"), F.col("fault"))).alias("abort"),
    )
    fixed = F.array(*[F.lit(s) for s in STEPS])
    own = F.array_sort(F.array_except(F.transform("steps", lambda s: s["step"]), fixed))
    runs = runs.withColumn("names", F.concat(fixed, own))
    names = F.col("names")
    told = runs.select("run", "abort", "steps", "names", F.posexplode(names).alias("step_no", "step"))
    told = told.withColumn("e", F.get(F.filter("steps", lambda s: s["step"] == F.col("step")), F.lit(0)))
    running = F.transform(
        F.filter("steps", lambda s: s["last"]["status"] == "running"),
        lambda s: F.array_position(names, s["step"]).cast("int") - 1,
    )
    aborted = F.col("abort").isNotNull() & (F.col("step_no") == F.array_min(running))
    status = F.coalesce(F.col("e.last.status"), F.lit("pending"))
    ends = F.when(F.col("e.last.status") != "running", F.col("e.finished_at"))
    return told.select(
        "run",
        (F.col("step_no") + 1).alias("step_no"),
        "step",
        F.when(F.coalesce(aborted, F.lit(False)), "failed").otherwise(status).alias("status"),
        F.coalesce("e.begun", "e.finished_at").alias("started_at"),
        F.when(F.coalesce(aborted, F.lit(False)), F.col("abort.ts")).otherwise(ends).alias("finished_at"),
        F.when(F.coalesce(aborted, F.lit(False)), F.col("abort.error"))
        .when(status == "failed", F.col("e.fault.error"))
        .alias("error"),
    )
