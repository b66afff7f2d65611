"""A whole run: clean, analyse, split, search, train, evaluate, explain, cross-validate."""

from __future__ import annotations

import datetime
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.functions.labels import parse_labels
from textlab.functions.text import fill_empty
from textlab.operators import compare, explain, metrics, profile, quality, split, train, validate
from textlab.operators.fitting import race
from textlab.operators.merge import auto_columns, merge_text, merged_name
from textlab.operators.tracking import STEPS, run_state
from textlab.plans import analysis, reports, rules
from textlab.session import hold, written
from textlab.sources.runs import SavedRun, save_run

EVENT_SCHEMA = "run string, step string, status string, ts timestamp, error string"
RESULT_SCHEMA = (
    "model string, f1 double, accuracy double, precision double, recall double, "
    "batch_ms double, single_ms double"
)
TRAINING_SCHEMA = "model string, seconds double, error string"


class Tracker:
    """Collects the step events of one run; a run has a handful of them."""

    def __init__(self, spark: SparkSession, run: str):
        self.spark, self.run, self.rows = spark, run, []

    def log(self, step: str | None, status: str, error: str | None = None) -> None:
        self.rows.append((self.run, step, status, datetime.datetime.now(), error))

    def state(self) -> DataFrame:
        return run_state(self.spark.createDataFrame(self.rows, EVENT_SCHEMA))


def run(
    df: DataFrame,
    label: str,
    text: str | None = None,
    text_columns: list[str] | None = None,
    id_col: str | None = None,
    name: str = "run",
    use_cv: bool | None = None,
    cv_folds: int | None = None,
    use_search: bool | None = None,
    n_trials: int | None = None,
    models: list[str] | None = None,
    seed: int = 42,
    auto_merge: bool = False,
    min_rows: int = validate.MIN_ROWS,
    path: str | None = None,
) -> dict:
    """Run all steps on a labelled text table and return the result record.

    ``None`` means: decide by the analysis. With ``path`` the models and reports are saved
    there. A failure is returned as a record with ``status`` and ``error``, not raised.
    """
    tracker = Tracker(df.sparkSession, name)
    held: list[DataFrame] = []
    current = [STEPS[0]]

    def step(i: int) -> None:
        if i:
            tracker.log(STEPS[i - 1], "completed")
        current[0] = STEPS[i]
        tracker.log(STEPS[i], "running")

    def keep(frame: DataFrame) -> DataFrame:
        held.append(hold(frame))
        return held[-1]

    try:
        step(0)
        table, text, id_col, multi = _validated(df, label, text, text_columns, id_col, auto_merge, min_rows)
        table = keep(table)
        validate.require_classes(table, label, multi)
        findings = quality.quality_report(table, text, label, multi_label=multi)

        step(1)
        record = analysis.analyze(table, label, text, multi_label=multi)
        facts = record.first()
        cfg = replace(train.Config.of(facts), seed=seed)
        names = models or list(facts["models"])
        # Also those that are named by hand, which the analysis has no say in.
        oversized = df.sparkSession.range(1).select(
            rules.oversized_models(F.lit(facts["n_rows"]), F.array(*[F.lit(n) for n in names])).alias("m")
        ).first()["m"] or []
        decide_cv = facts["use_cv"] if use_cv is None else use_cv
        decide_search = facts["use_search"] if use_search is None else use_search

        step(2)
        table = table.withColumn(text, fill_empty(F.col(text)))
        if multi:
            parts = keep(split.random_split(table, id_col, seed=seed))
        else:
            parts = split.stratified_split(table, label, id_col, seed=seed)
            parts = keep(split.repair_split(parts, label, id_col, seed))
        split.require_validation(parts)
        part = {p: parts.filter(F.col("split") == p).drop("split") for p in ("train", "val")}

        step(3)
        if multi:
            # Search and choice of candidates go by single classes: only what is named is fitted.
            if use_search:
                raise ValueError("use_search is not there for multi-label tables")
            fitted = train.fit_multilabels(models or ["lr_unigram"], part["train"], text, label, cfg)
        else:
            configs = {
                n: _searched(part["train"], text, label, id_col, cfg, n, n_trials) if decide_search else cfg
                for n in names
            }
            fitted = train.fit_models(names, part["train"], text, label, configs)
        usable = [t for t in fitted if t.error is None]
        if not usable:
            raise RuntimeError("no candidate could be trained: " + "; ".join(t.error for t in fitted))

        step(4)
        results = _evaluated(df.sparkSession, usable, part["val"], text, label, multi)
        trainings = df.sparkSession.createDataFrame(
            [(t.name, float(t.seconds), t.error) for t in fitted], TRAINING_SCHEMA
        )

        step(5)
        comparison = compare.compare_models(results)
        winner = compare.best_model(comparison).first()
        best = next(t for t in usable if t.name == winner["model"])
        base, lift = _baseline(part["val"], label, multi, results.filter(F.col("model") == best.name))

        step(6)
        scored = None if multi else {p: keep(_labelled(best, part[p], label)) for p in part}
        told = _reports(table, text, label, multi, findings, scored, comparison, record, base, lift, best, part["val"], id_col)
        cv = None
        if decide_cv:
            k = cv_folds or facts["cv_folds"]
            if multi:
                folded = split.random_folds(table, id_col, k, seed)
                folds = train.cross_validate_multilabel(folded, text, label, best.name, best.config)
            else:
                folded = split.stratified_folds(table, label, id_col, k, seed)
                folds = train.cross_validate(folded, text, label, best.name, best.config)
            summary = compare.cv_summary(folds)
            cv = {
                "folds": folds,
                "summary": summary,
                "verdict": compare.cv_verdict(summary, results.filter(F.col("model") == best.name).select("f1")),
            }
            told["cross_validation"] = reports.cv_report(folds, summary)
        if path:
            _save(path, name, best, usable, text, multi, record, told, seed, tracker, results)
        tracker.log(STEPS[-1], "completed")
        return {
            "status": "success",
            "run": name,
            "best_model_name": best.name,
            "best_model": best,
            "best_model_metrics": {
                "f1": winner["f1"], "accuracy": winner["accuracy"], "latency_ms": winner["batch_ms"],
            },
            "analysis": analysis.analysis_record(record),
            "decisions": analysis.decision_log(record),
            "comparison": compare.attach_training(comparison, trainings),
            "comparison_table": compare.comparison_table(comparison),
            "oversized_models": list(oversized),
            "quality": findings,
            "reports": told,
            "cv": cv,
            "state": tracker.state(),
            "path": path,
        }
    except Exception as error:
        tracker.log(current[0], "failed", str(error))
        return {"status": "failed", "run": name, "error": str(error), "state": tracker.state()}
    finally:
        for frame in held:
            frame.unpersist()


def _validated(df, label, text, text_columns, id_col, auto_merge, min_rows):
    """Cleaned table, text column, id column and whether the label is multi-label."""
    validate.require_min_rows(df, min_rows)
    validate.require_columns(df, [label, *([text] if text else []), *(text_columns or []), *([id_col] if id_col else [])])
    if id_col is None:
        # Depends on the layout of the input; written once, so that every later read agrees.
        id_col = "_row_id"
        df = written(df.withColumn(id_col, F.monotonically_increasing_id()), "rows")
    multi = validate.is_multi_label(df, label)
    if not multi:
        validate.require_classification(df, label)
        df = validate.normalise_label(df, label)
    columns = text_columns
    if text is None and not columns:
        shape = profile.profile_columns(df, exclude=[label, id_col])
        columns = auto_columns(shape) if auto_merge else None
        text = profile.text_column_of(df, label, id_col)
    first = text or columns[0]
    cleaned = validate.drop_missing(df, label, first)
    validate.require_min_rows(cleaned, min_rows, "dropping nulls")
    cleaned = validate.drop_blank(cleaned, first)
    validate.require_min_rows(cleaned, min_rows, "dropping blank texts")
    cleaned = validate.dedup_text(cleaned.withColumn(first, F.col(first).cast("string")), first, id_col)
    if columns:
        validate.require_filled(cleaned, columns)
        if len(columns) > 1:
            merged = merged_name(cleaned)
            cleaned = merge_text(cleaned, columns, merged)
            first = merged
    return cleaned, first, id_col, multi


def _searched(train_part, text, label, id_col, cfg, name, n_trials):
    """Settings by a race on the training rows alone, a part of which it holds out for itself."""
    parts = split.stratified_split(train_part, label, id_col, seed=cfg.seed + 1)
    found, _ = race(parts, text, label, id_col, cfg, name, n_trials)
    return found


def _labelled(best, part, label):
    """Scored rows with the columns the metric operators expect."""
    if label != "label":
        part = part.withColumn("label", F.col(label).cast("string"))
    return best.score(part)


def _evaluated(spark, usable, val, text, label, multi):
    """Metrics and batch time per row of every candidate; scoring is timed end to end."""
    rows = []
    for one in usable:
        started = time.monotonic()
        if multi:
            told = one.score(val.withColumn("labels", parse_labels(val, label)))
            row = metrics.metrics_multilabel(told).first()
            ms = (time.monotonic() - started) * 1000 / max(row["n_rows"], 1)
            scores = {m: row[m] for m in metrics.METRICS}
        else:
            scores, ms = train.evaluate(one, val, label)
        rows.append((one.name, *[float(scores[m]) for m in metrics.METRICS], float(ms), None))
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def _baseline(val, label, multi, result):
    if multi:
        base = metrics.majority_baseline_multilabel(val.withColumn("labels", parse_labels(val, label)), "labels")
        base = base.withColumn("majority_class", F.lit("(per label)"))
    else:
        base = metrics.majority_baseline(val, label)
    return base, metrics.baseline_lift(result, base)


def _reports(table, text, label, multi, findings, scored, comparison, record, base, lift, best, val, id_col):
    told = {"quality": reports.quality_report(table, text, label, multi)}
    told["baseline"] = reports.baseline_report(comparison.filter("rank = 1"), base)
    if not multi:
        told["model"] = reports.model_report(scored["val"], scored["train"], comparison, analysis.decision_log(record))
        words = explain.word_importance(best.model, val, id_col, text)
        told["explanation"] = reports.explain_report(scored["val"], words)
    return told


def _save(path, name, best, usable, text, multi, record, told, seed, tracker, results):
    """The reports, then the run, whose manifest comes last of all."""
    for kind, report in told.items():
        reports.write_report(report, f"{path}/reports/{kind}", f"{kind.replace('_', ' ')} of {name}")
    # A row per candidate.
    scores = {r["model"]: {k: v for k, v in r.asDict().items() if isinstance(v, float)} for r in results.collect()}
    saved = SavedRun(
        name, best.name, text, multi, {t.name: t for t in usable}, analysis.analysis_long(record),
        seed, tracker.rows[0][3], datetime.datetime.now(), scores,
    )
    save_run(record.sparkSession, saved, path)
