"""Rules and thresholds that turn measurements into decisions, as column expressions.

Being expressions, they decide for one table or for any number of groups at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


# Validation share by row count.
VAL_SMALL_ROWS, VAL_SMALL_SHARE = 200, 0.15
VAL_LARGE_ROWS, VAL_LARGE_TARGET, VAL_LARGE_LEAST = 25_000, 5_000, 0.05
VAL_SHARE = 0.20

# Token length limits.
MIN_LENGTH, MAX_LENGTH = 16, 512


def val_split(n: Column) -> Column:
    """Share of the rows to validate on."""
    large = F.greatest(F.lit(VAL_LARGE_LEAST), F.lit(VAL_LARGE_TARGET) / n)
    return (
        F.when(n < VAL_SMALL_ROWS, F.lit(VAL_SMALL_SHARE))
        .when(n > VAL_LARGE_ROWS, large)
        .otherwise(F.lit(VAL_SHARE))
    )


@dataclass(frozen=True)
class Tier:
    name: str
    below: float  # rows per class; the tier applies below this
    epochs: tuple[int, int]
    batch: int
    learning_rate: float
    patience: int
    grad_clip: float
    lr_bounds: tuple[float, float]
    decay_bounds: tuple[float, float]
    schedule: str
    dropout: float
    search: bool
    trials: int


# Training settings by rows per class.
TIERS = [
    Tier("CRITICAL", 50, (15, 20), 4, 5e-4, 7, 0.5, (2e-4, 5e-4), (0.01, 0.04), "cosine", 0.2, False, 3),
    Tier("SMALL", 200, (10, 15), 8, 2e-4, 6, 0.75, (1e-4, 5e-4), (0.005, 0.03), "cosine", 0.15, False, 5),
    Tier("MODERATE", 500, (8, 12), 16, 1e-4, 4, 1.0, (5e-5, 2e-4), (0.0, 0.02), "linear", 0.1, True, 8),
    Tier("GOOD", float("inf"), (5, 8), 32, 1e-4, 3, 1.0, (1e-5, 1e-4), (0.0, 0.02), "linear", 0.0, True, 10),
]
WARMUP_RATIO = 0.06
LABEL_SMOOTHING = 0.0

# What class imbalance adds (ratio above, weight decay, patience added, focal gamma).
IMBALANCE_STEPS = [(20.0, 0.03, 2, 4.0), (10.0, 0.02, 2, 3.0), (5.0, 0.01, 0, 2.0)]
PATIENCE_LEAST = 5
FOCAL_GAMMA = 2.0

# When to cross-validate.
CV_FOLDS = 5
CV_TINY_VAL, CV_SMALL_VAL, CV_IMBALANCE, CV_LARGE_ROWS = 60, 120, 5.0, 5_000

# The candidate models, small to large, and the slices of the roster used by row count.
ROSTER = ["nb_multinomial", "nb_complement", "lr_unigram", "lr_bigram", "lr_bigram_large"]
ROSTER_SLICES = [(2_000, (0, 3)), (10_000, (1, 5)), (None, (2, 5))]
LARGE_MODELS = ROSTER[3:]
LARGE_MODEL_ROWS = 2_000


def by_tier(rows_per_class: Column, value) -> Column:
    """``value(tier)`` of the tier that the rows per class fall into."""
    expression = None
    for tier in TIERS[:-1]:
        test, result = rows_per_class < tier.below, F.lit(value(tier))
        expression = F.when(test, result) if expression is None else expression.when(test, result)
    return expression.otherwise(F.lit(value(TIERS[-1])))


def by_imbalance(ratio: Column, position: int, default) -> Column:
    expression = None
    for step in IMBALANCE_STEPS:
        test, result = ratio > step[0], F.lit(step[position])
        expression = F.when(test, result) if expression is None else expression.when(test, result)
    return expression.otherwise(F.lit(default))


def patience(rows_per_class: Column, ratio: Column) -> Column:
    base = by_tier(rows_per_class, lambda t: t.patience)
    added = by_imbalance(ratio, 2, 0)
    return F.when(added > 0, F.greatest(base + added, F.lit(PATIENCE_LEAST))).otherwise(base)


def candidate_models(n: Column) -> Column:
    expression = None
    for limit, (start, stop) in ROSTER_SLICES:
        models = F.array(*[F.lit(m) for m in ROSTER[start:stop]])
        if limit is None:
            return expression.otherwise(models)
        test = n < limit
        expression = F.when(test, models) if expression is None else expression.when(test, models)


def oversized_models(n: Column, models: Column) -> Column:
    """The large models among ``models`` when there are few rows for them."""
    large = F.array(*[F.lit(m) for m in LARGE_MODELS])
    return F.when(n < LARGE_MODEL_ROWS, F.array_intersect(models, large)).otherwise(
        F.array().cast("array<string>")
    )


def clamp_length(tokens: Column) -> Column:
    return F.greatest(F.least(tokens, F.lit(MAX_LENGTH)), F.lit(MIN_LENGTH))


def gap_flag(gap: Column) -> Column:
    """Train minus validation, per metric."""
    return F.when(gap > 0.05, "overfit").when(F.abs(gap) <= 0.05, "ok").otherwise("underfit")


def fit_diagnosis(gap: Column) -> Column:
    """Train minus validation F1."""
    return (
        F.when(gap > 0.10, "HIGH OVERFITTING")
        .when(gap > 0.05, "MILD OVERFITTING")
        .when(gap < -0.05, "UNDERFITTING")
        .otherwise("GOOD FIT")
    )


def lift_verdict(lift: Column) -> Column:
    return F.when(lift < 0.02, "WARNING").when(lift < 0.10, "MARGINAL").otherwise("SOLID")


def stability_verdict(std: Column) -> Column:
    return (
        F.when(std <= 0.01, "stable").when(std <= 0.03, "reasonably stable").otherwise("high variance")
    )


def split_verdict(diff: Column) -> Column:
    """Single-split F1 minus the cross-validated mean."""
    return F.when(F.abs(diff) <= 0.02, "representative").when(diff > 0.02, "lucky").otherwise("conservative")


def calibration_verdict(error: Column) -> Column:
    return F.when(error < 0.05, "well calibrated").when(error < 0.10, "acceptable").otherwise("poor")
