"""Every threshold at, just below and just above its boundary."""

import pytest
from pyspark.sql import functions as F

from textlab.plans import analysis, rules


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", expression(F.col("v"))).orderBy("i").collect()]


CASES = [
    (rules.val_split, "long", {199: 0.15, 200: 0.2, 25_000: 0.2, 25_001: 5000 / 25_001, 200_000: 0.05}),
    (lambda v: rules.by_tier(v, lambda t: t.name), "double",
     {49.9: "CRITICAL", 50.0: "SMALL", 199.9: "SMALL", 200.0: "MODERATE", 499.9: "MODERATE", 500.0: "GOOD"}),
    (lambda v: rules.by_imbalance(v, 1, 0.0), "double", {5.0: 0.0, 5.1: 0.01, 10.0: 0.01, 10.1: 0.02, 20.0: 0.02, 20.1: 0.03}),
    (lambda v: rules.by_imbalance(v, 3, 2.0), "double", {5.0: 2.0, 10.0: 2.0, 10.1: 3.0, 20.0: 3.0, 20.1: 4.0}),
    (lambda v: F.size(rules.candidate_models(v)), "long", {1999: 3, 2000: 4, 9999: 4, 10_000: 3}),
    (rules.clamp_length, "long", {15: 16, 16: 16, 512: 512, 513: 512}),
    (rules.gap_flag, "double", {0.0501: "overfit", 0.05: "ok", -0.05: "ok", -0.0501: "underfit"}),
    (rules.fit_diagnosis, "double", {0.101: "HIGH OVERFITTING", 0.1: "MILD OVERFITTING", 0.05: "GOOD FIT",
                                     -0.05: "GOOD FIT", -0.051: "UNDERFITTING"}),
    (rules.lift_verdict, "double", {0.0199: "WARNING", 0.02: "MARGINAL", 0.0999: "MARGINAL", 0.1: "SOLID"}),
    (rules.stability_verdict, "double", {0.01: "stable", 0.011: "reasonably stable", 0.03: "reasonably stable", 0.031: "high variance"}),
    (rules.split_verdict, "double", {0.02: "representative", -0.02: "representative", 0.021: "lucky", -0.021: "conservative"}),
    (rules.calibration_verdict, "double", {0.0499: "well calibrated", 0.05: "acceptable", 0.0999: "acceptable", 0.1: "poor"}),
]


@pytest.mark.parametrize("expression,kind,expected", CASES)
def test_boundaries(spark, expression, kind, expected):
    assert column(spark, list(expected), kind, expression) == pytest.approx(list(expected.values()))


def test_patience_grows_with_imbalance_and_has_a_floor(spark):
    df = spark.createDataFrame([(600.0, 1.0), (600.0, 10.1), (300.0, 10.1), (10.0, 21.0), (600.0, 10.0)], "s double, r double")
    got = [r[0] for r in df.select(rules.patience(F.col("s"), F.col("r"))).collect()]
    assert got == [3, 5, 6, 9, 3]


def test_large_models_are_named_only_for_few_rows(spark):
    df = spark.createDataFrame([(1999,), (2000,)], "n long")
    pinned = F.array(F.lit("lr_unigram"), F.lit("lr_bigram_large"))
    got = [r[0] for r in df.select(rules.oversized_models(F.col("n"), pinned)).collect()]
    assert got == [["lr_bigram_large"], []]


def recommended(spark, n, ratio, spc=600.0):
    table = spark.createDataFrame(
        [(n, ratio, spc, spc, 100, 10, n, 2, "GOOD")],
        "n_rows long, imbalance_ratio double, rows_per_class double, labels_per_class double, max_class long,"
        " min_class long, label_count long, num_classes long, strategy string",
    )
    return analysis.run_recommendations(table).first()


@pytest.mark.parametrize("n,ratio,cv,word", [
    (299, 1.0, True, "only"), (300, 1.0, True, "few"), (599, 1.0, True, "few"), (600, 1.0, False, "adequate"),
    (600, 5.1, True, "uneven"), (599, 5.1, True, "smallest"), (5000, 5.0, False, "adequate"), (5001, 1.0, False, "reliable"),
])
def test_cross_validation_advice(spark, n, ratio, cv, word):
    row = recommended(spark, n, ratio)
    assert row["use_cv"] is cv and word in row["cv_reason"] and row["cv_folds"] == 5


@pytest.mark.parametrize("spc,search,trials", [(49.0, False, 3), (50.0, False, 5), (200.0, True, 8), (500.0, True, 10)])
def test_search_advice(spark, spc, search, trials):
    row = recommended(spark, 1000, 1.0, spc)
    assert (row["use_search"], row["search_trials"]) == (search, trials)
