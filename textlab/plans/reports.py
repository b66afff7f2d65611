"""Reports as long tables ``(section, ord, key, value)``, and their text form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.operators import explain, metrics, quality
from textlab.operators.labels import class_counts
from textlab.operators.ranks import ranked

COLUMNS = ["section", "ord", "key", "value"]


def _number(value: Column, places: int = 4) -> Column:
    return F.format_string(f"%.{places}f", F.bround(value.cast("double"), places))


def _rows(df: DataFrame, section: str, order, key: Column, value: Column) -> DataFrame:
    """Rows of a class- or model-level table in a fixed order."""
    told = ranked(df.withColumn("_key", key.cast("string")).withColumn("_value", value.cast("string")), order, name="ord")
    return told.select(F.lit(section).alias("section"), "ord", F.col("_key").alias("key"), F.col("_value").alias("value"))


def _pairs(df: DataFrame, section: str, pairs: dict[str, Column]) -> DataFrame:
    """The columns of a one-row table as rows."""
    entries = [
        F.struct(F.lit(section).alias("section"), F.lit(i + 1).alias("ord"), F.lit(k).alias("key"), v.cast("string").alias("value"))
        for i, (k, v) in enumerate(pairs.items())
    ]
    return df.select(F.inline(F.array(*entries)))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])


def quality_report(df: DataFrame, text: str, label: str, multi_label: bool = False) -> DataFrame:
    """Overview, class bars, findings and verdict of the data-quality audit."""
    counts = class_counts(df, label, multi_label=multi_label)
    overview = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    found = quality.quality_report(df, text, label, multi_label=multi_label)
    bars = quality.class_bars(df, label, multi_label=multi_label)
    verdict = quality.quality_verdict(df, found)
    return _union([
        _pairs(overview, "overview", {"labels": F.col("n"), "classes": F.col("k")}),
        _rows(bars, "classes", [F.desc("n"), F.col("label")], F.col("label"), F.concat_ws(" ", "n", "bar_of_largest")),
        _rows(found, "findings", [F.col("check"), F.col("subject")], F.concat_ws(" ", "check", "subject"), F.col("n")),
        _pairs(verdict, "verdict", {"warnings": F.col("total_warnings"), "passed": F.col("passed")}),
    ])


def baseline_report(model: DataFrame, base: DataFrame) -> DataFrame:
    """Baseline, model, improvement and verdict."""
    lift = metrics.baseline_lift(model, base)
    return _union([
        _pairs(base, "baseline", {
            "majority class": F.col("majority_class"), "majority share": _number(F.col("majority_share")),
            "accuracy": _number(F.col("accuracy")), "f1": _number(F.col("f1")),
        }),
        _pairs(model, "model", {"accuracy": _number(F.col("accuracy")), "f1": _number(F.col("f1"))}),
        _pairs(lift, "improvement", {
            "f1 lift": _number(F.col("f1_lift")), "f1 lift %": _number(F.col("f1_lift_pct"), 1),
            "accuracy lift": _number(F.col("accuracy_lift")),
        }),
        _pairs(lift, "verdict", {"verdict": F.col("verdict")}),
    ])


def _class_rows(scored: DataFrame, section: str) -> DataFrame:
    shown = F.format_string("%.4f %.4f %.4f %d", "precision", "recall", "f1", "support")
    last = F.col("class").isin("macro avg", "weighted avg")
    return _rows(metrics.class_report(scored), section, [last, F.col("class")], F.col("class"), shown)


def model_report(val: DataFrame, train: DataFrame | None = None, comparison: DataFrame | None = None,
                 decisions: DataFrame | None = None) -> DataFrame:
    """Report on the best model: fit, classes, confusion, candidates and decisions."""
    val_metrics = metrics.metrics(val)
    parts = [_pairs(val_metrics, "validation", {m: _number(F.col(m)) for m in metrics.METRICS})]
    if train is not None:
        fit = metrics.overfit_report(metrics.metrics(train), val_metrics)
        shown = F.format_string("%.4f %.4f %+.4f %s", "train", "val", "gap", "flag")
        parts.append(_rows(fit, "train vs validation", [F.col("metric")], F.col("metric"), shown))
        parts.append(_pairs(fit.filter("metric = 'f1'"), "diagnosis", {"diagnosis": F.col("diagnosis")}))
        parts.append(_class_rows(train, "classes in training"))
        parts.append(_confusion_rows(train, "confusion in training"))
    parts.append(_class_rows(val, "classes in validation"))
    small = metrics.small_classes(val)
    parts.append(_rows(small, "small classes", [F.col("class")], F.col("class"), F.col("support")))
    parts.append(_confusion_rows(val, "confusion in validation"))
    if comparison is not None:
        shown = F.format_string("%.4f %.4f %.4f", "f1", "accuracy", "composite")
        parts.append(_rows(comparison, "candidates", [F.col("rank")], F.col("model"), shown))
    if decisions is not None:
        shown = F.concat_ws(": ", "decision", "reason")
        parts.append(_rows(decisions, "decisions", [F.col("decision_no")], F.col("category"), shown))
    return _union(parts)


def _confusion_rows(scored: DataFrame, section: str) -> DataFrame:
    cells = metrics.confusion(scored)
    key = F.concat_ws(" -> ", "label", "prediction")
    return _rows(cells, section, [F.col("label"), F.col("prediction")], key, F.col("n"))


def explain_report(scored: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Confidence figures, histogram, calibration and, if given, the explained rows."""
    stats = explain.confidence_stats(scored)
    bins = explain.confidence_histogram(scored)
    shown = F.concat_ws(" ", "n", F.repeat(F.lit("█"), F.floor(F.col("n") / F.col("_all") * 40).cast("int")))
    told = bins.withColumn("_all", stats.select("n_samples").scalar())
    names = [c for c in stats.columns]
    parts = [
        _pairs(stats, "confidence", {c: _plain(stats, c) for c in names}),
        _rows(told, "histogram", [F.col("bin")], F.col("range"), shown),
        _pairs(explain.calibration_error(scored), "calibration", {"ece": _number(F.col("ece")), "verdict": F.col("verdict")}),
    ]
    if words is not None:
        top = words.filter("in_top")
        id_col = words.columns[0]
        key = F.concat_ws(" ", F.col(id_col).cast("string"), "word")
        parts.append(_rows(top, "top words", [F.col(id_col), F.col("rank")], key, _number(F.col("score"))))
    return _union(parts)


def _plain(df: DataFrame, name: str) -> Column:
    return _number(F.col(name)) if df.schema[name].dataType.typeName() == "double" else F.col(name)


def cv_report(folds: DataFrame, summary: DataFrame) -> DataFrame:
    """Fold counts, metric summary and the folds one by one."""
    counts = folds.agg(F.count(F.lit(1)).alias("k"), F.count("f1").alias("ok"))
    spread = F.format_string("%.4f ± %.4f (%.4f to %.4f)", "mean", "std", "min", "max")
    each = F.when(F.col("f1").isNull(), F.concat(F.lit("failed: "), F.col("error"))).otherwise(
        F.format_string("%d %d %.4f %.4f", "n_train", "n_val", "f1", "accuracy")
    )
    return _union([
        _pairs(counts, "folds", {"folds": F.col("k"), "successful": F.col("ok")}),
        _rows(summary, "summary", [F.col("metric")], F.col("metric"), spread),
        _rows(folds, "per fold", [F.col("fold")], F.col("fold"), each),
    ])


# Sections in the order in which a reader meets them.
SECTION_ORDER = [
    "overview", "classes", "findings", "baseline", "model", "improvement", "verdict",
    "validation", "train vs validation", "diagnosis", "classes in validation", "small classes",
    "confusion in validation", "classes in training", "confusion in training", "candidates", "decisions",
    "confidence", "histogram", "calibration", "top words", "folds", "summary", "per fold",
]


def render(report: DataFrame, title: str) -> str:
    """Text form of a report, which has rows per class, metric or model, not per text."""
    rows = sorted(report.collect(), key=lambda r: (SECTION_ORDER.index(r["section"]), r["ord"]))
    lines, section = [title, "=" * len(title)], None
    for row in rows:
        if row["section"] != section:
            section = row["section"]
            lines += ["", section.upper(), "-" * len(title)]
        lines.append(f"  {row['key']:<28} {row['value']}")
    return "\n".join(lines) + "\n"


def write_report(report: DataFrame, path: str, title: str) -> None:
    """The report as rows in JSON and as text."""
    report.coalesce(1).write.mode("overwrite").json(f"{path}/rows")
    text = report.sparkSession.createDataFrame([(render(report, title),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{path}/text")
