import math

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, MultilabelClassificationEvaluator
from pyspark.sql import functions as F

from __spark_entry__ import queries
from textlab.catalog.inputs import ATOMIC, LANGS, scored, scored_multi
from textlab.operators import compare, explain, losses, metrics, predict
from textlab.operators.tracking import run_state


def test_metrics_agree_with_spark_evaluators(spark, small):
    df = scored(spark, small)
    names = F.array(*[F.lit(c) for c in LANGS])
    coded = df.select(
        (F.array_position(names, F.col("label")) - 1).cast("double").alias("label"),
        (F.array_position(names, F.col("prediction")) - 1).cast("double").alias("prediction"),
    )
    row = metrics.metrics(df).first()
    for mine, theirs in (("accuracy", "accuracy"), ("f1", "f1"), ("precision", "weightedPrecision"), ("recall", "weightedRecall")):
        assert row[mine] == pytest.approx(MulticlassClassificationEvaluator(metricName=theirs).evaluate(coded))


def test_multilabel_metrics_agree_with_spark_evaluator(spark, small):
    df = scored_multi(spark, small)
    code = {c: float(i) for i, c in enumerate(ATOMIC)}
    table = F.create_map(*[x for c, i in code.items() for x in (F.lit(c), F.lit(i))])
    # The evaluator compares lists in order.
    coded = df.select(
        F.transform(F.array_sort("labels"), lambda c: table[c]).alias("label"),
        F.transform(F.array_sort("predicted"), lambda c: table[c]).alias("prediction"),
    )
    row = metrics.metrics_multilabel(df).first()
    for mine, theirs in (("accuracy", "subsetAccuracy"), ("f1", "microF1Measure"), ("precision", "microPrecision"), ("recall", "microRecall")):
        assert row[mine] == pytest.approx(MultilabelClassificationEvaluator(metricName=theirs).evaluate(coded))


def small_scored(spark):
    rows = [("a", "a", [0.9, 0.1]), ("a", "b", [0.4, 0.6]), ("b", "b", [0.3, 0.7]), ("c", "a", [0.5, 0.5])]
    return spark.createDataFrame(rows, "label string, prediction string, p array<double>")


def test_absent_and_unpredicted_classes_score_zero(spark):
    rows = {r["class"]: r for r in metrics.class_report(small_scored(spark)).collect()}
    assert rows["a"]["precision"] == 0.5 and rows["a"]["recall"] == 0.5
    assert (rows["c"]["precision"], rows["c"]["recall"], rows["c"]["f1"], rows["c"]["support"]) == (0.0, 0.0, 0.0, 1)
    assert rows["weighted avg"]["support"] == 4
    cells = {(r["label"], r["prediction"]): r["n"] for r in metrics.confusion(small_scored(spark)).collect()}
    assert len(cells) == 9 and cells[("c", "a")] == 1 and cells[("b", "c")] == 0


def test_decision_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([0.2, 0.8],)], "p array<double>")
    assert [r["prediction"] for r in metrics.decide(df, ["a", "b"]).collect()] == ["a", "b"]
    both = spark.createDataFrame([(["x", "y"], [0.5, 0.49])], "names array<string>, p array<double>")
    assert metrics.decide_multilabel(both).first()["predicted"] == ["x"]


def test_losses_by_hand(spark):
    df = small_scored(spark).filter("label <> 'c'")
    weights = spark.createDataFrame([("a", 0.5)], "label string, weight double")
    p = [(0.9, 0.5), (0.4, 0.5), (0.7, 1.0)]
    ce = sum(-w * math.log(x) for x, w in p) / sum(w for _, w in p)
    focal = sum((1 - x) ** 2 * w * -math.log(x) for x, w in p) / 3
    assert losses.cross_entropy(df, ["a", "b"], weights).first()["cross_entropy"] == pytest.approx(ce)
    assert losses.focal_loss(df, ["a", "b"], 2.0, weights).first()["focal_loss"] == pytest.approx(focal)


def test_bin_edges(spark):
    values = [0.0, 0.1, 0.3, 0.6, 0.7, 0.8, 0.9, 1.0]
    df = spark.createDataFrame([([v],) for v in values], "p array<double>")
    got = [r[0] for r in df.select(explain.bin_of(F.col("p")[0])).collect()]
    assert got == [0, 1, 2, 5, 6, 8, 9, 9]
    histogram = explain.confidence_histogram(df).collect()
    assert len(histogram) == 10 and sum(r["n"] for r in histogram) == len(values)


def test_calibration_by_hand(spark):
    rows = [("a", "a", [0.95]), ("a", "b", [0.95]), ("a", "a", [0.55])]
    df = spark.createDataFrame(rows, "label string, prediction string, p array<double>")
    error = (abs(0.5 - 0.95) * 2 + abs(1 - 0.55)) / 3
    row = explain.calibration_error(df).first()
    assert row["ece"] == pytest.approx(error) and row["verdict"] == "poor"


@pytest.mark.parametrize("n", [1, 2, 3])
def test_composite_uses_the_median_latency(spark, n):
    latencies = [0.5, 4.0, 10.0][:n]
    rows = [(f"m{i}", 0.8, 0.8, 0.8, 0.8, x, x) for i, x in enumerate(latencies)]
    df = spark.createDataFrame(rows, "model string, f1 double, accuracy double, precision double, recall double, batch_ms double, single_ms double")
    middle = max(sorted(latencies)[n // 2] if n % 2 else sum(latencies[:2]) / 2, 1.0)
    got = compare.compare_models(df).collect()
    assert [r["model"] for r in sorted(got, key=lambda r: r["rank"])] == [f"m{i}" for i in range(n)]
    for r in got:
        assert r["composite"] == pytest.approx(0.56 + 0.3 / (1 + r["latency_ms"] / middle))


def test_failed_folds_are_left_out(spark):
    rows = [(0, 0.8, 0.8, 0.8, 0.8), (1, 0.9, 0.8, 0.8, 0.8), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "fold int, f1 double, accuracy double, precision double, recall double")
    f1 = compare.cv_summary(df).filter("metric = 'f1'").first()
    assert (f1["n_folds"], f1["mean"], f1["std"], f1["min"], f1["max"]) == (2, 0.85, 0.05, 0.8, 0.9)


def test_baseline_lift_is_infinite_over_nothing(spark):
    one = spark.createDataFrame([(0.5, 0.5)], "f1 double, accuracy double")
    none = spark.createDataFrame([(0.0, 0.1)], "f1 double, accuracy double")
    assert metrics.baseline_lift(one, none).first()["f1_lift_pct"] == math.inf


def test_subwords(spark):
    rows = [(1, 0, "##x", 1.0), (1, 1, "play", 2.0), (1, 2, "##ing", 3.0), (1, 3, "now", 4.0), (2, 0, "a", 1.0)]
    df = spark.createDataFrame(rows, "id int, pos int, token string, score double")
    got = sorted((r["id"], r["word_no"], r["word"], r["score"]) for r in explain.merge_subwords(df).collect())
    assert got == [(1, 1, "##x", 1.0), (1, 2, "playing", 5.0), (1, 3, "now", 4.0), (2, 1, "a", 1.0)]


def test_subwords_of_lists_stay_in_their_row(spark, small):
    """Pieces of a text are put together where the text is: no shuffle, no window, any order, any score."""
    told = queries()["x2_merge_subwords"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in told and "Window" not in told
    rows = [(1, 3, "##c", None), (1, 1, "a", 2), (1, 2, "##b", 3), (1, 5, None, None), (1, 4, "d", None), (2, 0, "##x", 1)]
    df = spark.createDataFrame(rows, "id int, pos int, token string, score int")
    got = sorted((r["id"], r["word_no"], r["word"], r["score"]) for r in explain.merge_subwords(df).collect())
    assert got == [(1, 1, "abc", 5), (1, 2, "d", None), (2, 1, "##x", 1)]


def test_top_k_pads_and_breaks_ties_by_class(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],)], "p array<double>")
    row = predict.top_k(df, ["a", "b", "c"], 4).first()
    assert [row[f"top{i}_label"] for i in range(1, 5)] == ["a", "b", "c", ""]
    assert [row[f"top{i}_confidence"] for i in range(1, 5)] == [40.0, 40.0, 20.0, 0.0]


def test_aborted_run(spark):
    rows = [
        ("r", None, "started", 1, None), ("r", "data_validation", "running", 2, None),
        ("r", "data_validation", "completed", 3, None), ("r", "data_intelligence", "running", 4, None),
        ("r", "no such step", "running", 5, None), ("r", None, "failed", 6, "e" * 600),
    ]
    df = spark.createDataFrame(rows, "run string, step string, status string, ts long, error string")
    state = {r["step_no"]: r for r in run_state(df).collect()}
    assert len(state) == 8 and state[8]["step"] == "no such step" and state[8]["status"] == "running"
    assert state[1]["status"] == "completed" and state[1]["finished_at"] == 3
    assert (state[2]["status"], state[2]["finished_at"], len(state[2]["error"])) == ("failed", 6, 600)
    assert state[3]["status"] == "pending" and state[3]["started_at"] is None


def test_losses_at_the_edges(spark):
    """Probabilities of exactly 0 and 1, and a label that is no class."""
    import math

    from textlab.operators import losses

    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.5, 0.5])]
    scored = spark.createDataFrame(rows, "label string, p array<double>")
    most = -math.log(1e-15)
    row = losses.cross_entropy(scored, ["a", "b"]).first()
    assert row["n_rows"] == 3 and row["cross_entropy"] == pytest.approx(2 * most / 3)
    assert losses.focal_loss(scored, ["a", "b"]).first()["focal_loss"] == pytest.approx(2 * most / 3)
    several = spark.createDataFrame([(["x"], ["x", "y"], [0.0, 1.0])], "labels array<string>, names array<string>, p array<double>")
    weights = spark.createDataFrame([("x", 1.0), ("y", 1.0)], "label string, pos_weight double")
    assert losses.bce_loss(several, weights).first()["bce_loss"] == pytest.approx(most, rel=1e-2)
