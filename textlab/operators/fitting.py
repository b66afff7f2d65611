"""Fits that are repeated: early stopping on a validation curve, and a race of settings.

Both hash the texts once and fit on the held counts. The rows of a race are prefixes of the order by
``md5(seed:id)``, so a smaller rung is part of every larger one and no row moves.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.operators import train
from textlab.operators.losses import cross_entropy
from textlab.operators.predict import predict
from textlab.operators.ranks import hash_key
from textlab.session import hold

CURVE = "model string, step int, iterations int, train_loss double, val_loss double, best boolean"


@dataclass
class Stopped:
    """The model of the best step, and the curve it was chosen from."""

    trained: train.Trained
    steps: list[dict] = field(default_factory=list)

    @property
    def best_step(self) -> int:
        return min(self.steps, key=lambda s: (s["val_loss"], s["step"]))["step"]

    def curve(self, spark: SparkSession) -> DataFrame:
        rows = [
            (self.trained.name, s["step"], s["iterations"], s["train_loss"], s["val_loss"], s["step"] == self.best_step)
            for s in self.steps
        ]
        return spark.createDataFrame(rows, CURVE)


def _loss(model: PipelineModel, held: DataFrame, classes: list[str]) -> float:
    return cross_entropy(predict(model, held, classes), classes).first()["cross_entropy"]


def fit_early_stopped(
    name: str, parts: DataFrame, text: str, label: str, cfg: train.Config = train.Config(), step: int = train.ITERATIONS_PER_EPOCH
) -> Stopped:
    """The candidate after as many iterations as serve the validation rows best.

    ``parts`` has a ``split`` column. Fits of ``step``, ``2 * step`` and so on iterations, up to those
    of the settings, are compared by their cross-entropy on the validation rows; after
    ``cfg.patience`` of them without a new least one no more are made. Naive Bayes has one step. A
    validation row whose class the training part lacks costs as much as can be.
    """
    started = time.monotonic()
    data = parts.select(text, F.col(label).cast("string").alias("label"), "split")
    index = train.index_classes(data.filter("split = 'train'"), "label")
    weighted = train.weighted_part(data, "label", cfg, "split = 'train'")
    classes, kind = list(index.labels), train.CANDIDATES[name][0]
    steps, best, since = [], None, 0
    with train.Features(name, weighted, text, ["label", "weight", "split"]) as features:
        scaling, ready = features.fitted("split = 'train'")
        ready = index.transform(ready)
        held = {p: features.held.filter(F.col("split") == p) for p in ("train", "val")}
        last = cfg.iterations if kind == "logistic" else step
        for number, iterations in enumerate(range(step, last + step, step)):
            # A tolerance of 0 makes each fit go exactly as far as it is told.
            now = replace(cfg, max_iter=min(iterations, last), exact_iterations=True)
            model = PipelineModel(stages=[*scaling, train.fit_estimator(name, ready, now, None, features.at_a_time)])
            loss = {p: _loss(model, held[p].drop("weight"), classes) for p in held}
            steps.append({"step": number, "iterations": now.iterations, "train_loss": loss["train"], "val_loss": loss["val"]})
            if best is None or loss["val"] < min(s["val_loss"] for s in steps[:-1]):
                best, since = model, 0
            else:
                since += 1
                if since >= cfg.patience:
                    break
        fitted = PipelineModel(stages=[*features.stages, *best.stages])
    seconds = time.monotonic() - started
    return Stopped(train.Trained(name, fitted, classes, seconds, config=cfg), steps)


def hash_share(id_col: str, seed: int) -> Column:
    """A number from 0 to 1 for each id, the same in any layout; its order is that of the hash ranks."""
    return F.conv(F.substring(hash_key(id_col, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def rungs(trials: int, least: float) -> list[tuple[int, float]]:
    """How many settings run on what share of the rows: half of them leave after each rung, the rows
    double, and the last rung has all rows."""
    shares = [1.0]
    while shares[0] / 2 >= least and 2 ** len(shares) <= trials:
        shares.insert(0, shares[0] / 2)
    return [(max(1, -(-trials // 2**i)), share) for i, share in enumerate(shares)]


def race(
    parts: DataFrame, text: str, label: str, id_col: str, cfg: train.Config, name: str = "lr_unigram",
    trials: int | None = None, least: float = 0.125,
) -> tuple[train.Config, list[dict]]:
    """Settings with the best weighted F1, and a record of every fit of the race.

    ``parts`` has a ``split`` column. All trials start on a share of both parts, ``least`` of them at
    least; the weaker half leaves each time, and what is left in the end has been fitted on all
    training rows and compared on all validation rows. Ties go to the earlier trial. The tier with
    the fewest rows is not searched; failed trials leave; without a success the given settings stand.
    """
    if cfg.strategy == "CRITICAL" or train.CANDIDATES[name][0] != "logistic":
        return cfg, []
    settings = train.trial_settings(cfg, cfg.trials if trials is None else trials)
    rows = parts.select(text, F.col(label).cast("string").alias(label), "split", hash_share(id_col, cfg.seed).alias("_share"))
    index = train.index_classes(rows.filter("split = 'train'"), label)
    weighted = train.weighted_part(rows, label, cfg, "split = 'train'")
    left, record = list(range(len(settings))), []
    with train.Features(name, weighted, text, [label, "weight", "split", "_share"]) as features:
        for rung, (count, share) in enumerate(rungs(len(settings), least)):
            left = left[:count]
            scaling, data = features.fitted(f"split = 'train' and _share < {share}")
            data = hold(index.transform(data))
            val = features.held.filter((F.col("split") == "val") & (F.col("_share") < share))

            def one(i: int) -> dict:
                entry = {
                    "trial": i, "rung": rung, "share": share, "weight_decay": settings[i].weight_decay,
                    "elastic_net": settings[i].elastic_net, "max_iter": settings[i].iterations, "f1": None, "error": None,
                }
                try:
                    model = PipelineModel(stages=[*scaling, train.fit_estimator(name, data, settings[i], None, features.at_a_time)])
                    scores, _ = train.evaluate(train.Trained(name, model, list(index.labels)), val, label)
                    entry["f1"] = scores["f1"]
                except Exception as error:
                    entry["error"] = str(error)
                return entry

            done = train.together(one, left, features.at_a_time)
            data.unpersist()
            record += done
            ranked = sorted((r for r in done if r["f1"] is not None), key=lambda r: (-r["f1"], r["trial"]))
            left = [r["trial"] for r in ranked]
            if not left:
                return cfg, record
    return settings[left[0]], record
