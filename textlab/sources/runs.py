"""Saving finished runs and loading one of their models again.

A folder holds any number of runs. Each save writes its models and its analysis into a folder of its
own and only then appends one line, the manifest, to the table of runs. What has no manifest was
never saved: a run that is killed half-way leaves files but can't be loaded, and the runs saved
before it stay as they are.
"""

from __future__ import annotations

import datetime
import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.operators.train import Config, Trained, TrainedLabels


@dataclass
class SavedRun:
    name: str
    best: str
    text: str
    multi_label: bool
    models: dict[str, Trained | TrainedLabels] = field(default_factory=dict)
    analysis: DataFrame | None = None
    seed: int | None = None
    started_at: datetime.datetime | None = None
    finished_at: datetime.datetime | None = None
    #: ``model -> {metric: value}``.
    metrics: dict[str, dict[str, float]] = field(default_factory=dict)


TRAINED = "struct<model: string, classes: array<string>, path: string, seconds: double, config: string, metrics: map<string, double>>"
MANIFEST = (
    "version string, run string, best string, text string, multi_label boolean, seed bigint, started_at timestamp, "
    f"finished_at timestamp, status string, analysis string, models array<{TRAINED}>"
)


def save_run(spark: SparkSession, run: SavedRun, path: str) -> str:
    """Every fitted model with its config, class order and metrics, and the analysis; returns the version."""
    version = uuid.uuid4().hex
    models = []
    for name, trained in run.models.items():
        where = f"{path}/versions/{version}/models/{name}"
        trained.model.write().save(where)
        config = json.dumps(asdict(trained.config)) if trained.config else None
        found = {k: float(v) for k, v in run.metrics.get(name, {}).items() if v is not None}
        models.append((name, list(trained.classes), where, float(trained.seconds), config, found))
    analysis = None
    if run.analysis is not None:
        analysis = f"{path}/versions/{version}/analysis"
        run.analysis.write.parquet(analysis)
    ended = run.finished_at or datetime.datetime.now()
    line = (version, run.name, run.best, run.text, run.multi_label, run.seed, run.started_at or ended, ended, "success", analysis, models)
    # The commit: one file, which appears under its name when it is whole.
    spark.createDataFrame([line], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/runs")
    return version


def saved_runs(spark: SparkSession, path: str) -> DataFrame:
    """The manifests of all runs saved under ``path``, one row each; none where nothing was saved."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/runs")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _config(text: str | None) -> Config | None:
    if text is None:
        return None
    told = json.loads(text)
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in told.items()})


def load_run(spark: SparkSession, path: str, model: str | None = None, version: str | None = None) -> SavedRun:
    """The run of a version, else the one saved last, with the named model, else its best one."""
    runs = saved_runs(spark, path)
    if version is not None:
        runs = runs.filter(F.col("version") == version)
    line = runs.orderBy(F.desc("finished_at"), "version").first()
    if line is None:
        raise ValueError(f"{path} has no saved run {version or ''}".rstrip())
    row = next((m for m in line["models"] if m["model"] == (model or line["best"])), None)
    if row is None:
        raise ValueError(f"run {path} has no model {model or 'recorded as best'}")
    made = TrainedLabels.of if line["multi_label"] else Trained
    trained = made(row["model"], PipelineModel.load(row["path"]), list(row["classes"]))
    trained.seconds, trained.config = row["seconds"], _config(row["config"])
    return SavedRun(
        line["run"], line["best"], line["text"], line["multi_label"], {row["model"]: trained},
        spark.read.parquet(line["analysis"]) if line["analysis"] else None,
        line["seed"], line["started_at"], line["finished_at"], {m["model"]: dict(m["metrics"]) for m in line["models"]},
    )
