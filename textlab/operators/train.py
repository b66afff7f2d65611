"""Training, search and cross-validation of Spark ML text classifiers."""

from __future__ import annotations

import random
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import IDF, HashingTF, NGram, SQLTransformer, StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.functions.labels import parse_labels
from textlab.functions.text import TOKEN
from textlab.operators.labels import (
    atomic_labels,
    attach_weights,
    multi_hot,
    pos_weights,
    weights_from_counts,
)
from textlab.operators.losses import clipped
from textlab.operators.metrics import METRICS, decide_multilabel, metrics, metrics_multilabel
from textlab.operators.predict import predict
from textlab.plans.rules import ROSTER
from textlab.session import hold

# The candidates: estimator, hashed feature bits, and whether word pairs are features too.
CANDIDATES = {
    "nb_multinomial": ("multinomial", 16, False),
    "nb_complement": ("complement", 14, False),
    "lr_unigram": ("logistic", 14, False),
    "lr_bigram": ("logistic", 16, True),
    "lr_bigram_large": ("logistic", 18, True),
}
ITERATIONS_PER_EPOCH = 5
#: Independent fits that are given to Spark at a time.
PARALLEL_FITS = 3
#: Partitions of hashed texts for each core, and the rows that one of them has at least and at most.
PARTS_A_CORE, ROWS_A_PART, MOST_ROWS_A_PART = 4, 250, 10_000
#: Of the blocks of rows that the fit of a large table holds, which have 1 MB else. As of the batches of a held table, each task keeps 100 of them.
BLOCK_MB = 0.25
#: Bytes of held counts for each core up to which fits run at a time; each holds a copy of the counts.
COPIED_A_CORE = 32 << 20


@dataclass(frozen=True)
class Config:
    """Training settings as far as Spark ML has them.

    ``max_length`` is reported only: texts are read whole in training and scoring.
    """

    epochs: tuple[int, int] = (5, 8)
    decay_bounds: tuple[float, float] = (0.0, 0.02)
    weight_decay: float = 0.0
    elastic_net: float = 0.0
    max_iter: int | None = None
    max_length: int = 512
    use_class_weights: bool = False
    use_focal_loss: bool = False
    focal_gamma: float = 2.0
    patience: int = 3
    strategy: str = "GOOD"
    trials: int = 10
    seed: int = 42
    exact_iterations: bool = False
    focal_rounds: int = 20

    @property
    def iterations(self) -> int:
        return self.max_iter or self.epochs[1] * ITERATIONS_PER_EPOCH

    @property
    def tolerance(self) -> float:
        """A shorter patience stops at a larger change; ``exact_iterations`` at none."""
        return 0.0 if self.exact_iterations else 10.0 ** -self.patience

    @classmethod
    def of(cls, analysis_row) -> "Config":
        r = analysis_row
        return cls(
            epochs=(r["epochs_min"], r["epochs_max"]),
            decay_bounds=(r["decay_min"], r["decay_max"]),
            weight_decay=r["weight_decay"],
            max_length=r["max_length"],
            use_class_weights=r["use_class_weights"],
            use_focal_loss=r["use_focal_loss"],
            focal_gamma=r["focal_gamma"],
            patience=r["patience"],
            strategy=r["strategy"],
            trials=r["search_trials"],
        )


@dataclass
class Trained:
    """A fitted candidate, or the error that kept it from being fitted."""

    name: str
    model: PipelineModel | None = None
    classes: list[str] = field(default_factory=list)
    seconds: float = 0.0
    error: str | None = None
    config: Config | None = None
    #: Focal loss after each round of focal training.
    rounds: list[float] = field(default_factory=list)

    def score(self, df: DataFrame) -> DataFrame:
        return predict(self.model, df, self.classes)


def tokenizer(text: str) -> SQLTransformer:
    """All lower-cased tokens, as a stage that can be saved."""
    pattern = TOKEN.replace("\\", "\\\\")
    return SQLTransformer(statement=f"SELECT *, regexp_extract_all(lower({text}), '({pattern})', 1) AS tokens FROM __THIS__")


def _pair_stages() -> list:
    return [
        NGram(n=2, inputCol="tokens", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(tokens, pairs) AS terms FROM __THIS__"),
    ]


def hashing_stages(name: str, text: str) -> list:
    """Text to hashed term counts. None of the stages has to be fitted."""
    kind, bits, pairs = CANDIDATES[name]
    stages, source = ([*_pair_stages()], "terms") if pairs else ([], "tokens")
    return [tokenizer(text), *stages, HashingTF(inputCol=source, outputCol=_counted(kind), numFeatures=1 << bits)]


def _counted(kind: str) -> str:
    return "counts" if kind == "logistic" else "features"


def shared_counts(name: str) -> str:
    """The column of ``shared_stages`` that a candidate counts its terms in."""
    _, bits, pairs = CANDIDATES[name]
    return f"_pairs{bits}" if pairs else f"_tokens{bits}"


def shared_stages(names, text: str) -> list:
    """Text to the hashed term counts of several candidates: tokens are found once for all of them, and
    counted once for those that count alike."""
    found = {shared_counts(n): CANDIDATES[n][1:] for n in names}
    stages = [tokenizer(text), *(_pair_stages() if any(pairs for _, pairs in found.values()) else [])]
    for column, (bits, pairs) in found.items():
        stages.append(HashingTF(inputCol="terms" if pairs else "tokens", outputCol=column, numFeatures=1 << bits))
    return stages


class Features:
    """Hashed counts of a training table, held while models are fitted on them.

    Tokens are hashed in one pass; inverse document frequencies are fitted and applied on the
    held counts. Counts that are held already, for several candidates, are given as ``held``.
    """

    def __init__(self, name: str, ready: DataFrame, text: str, columns: list[str], held: DataFrame | None = None):
        self.name, self.columns, self.own = name, columns, held is None
        self.stages = hashing_stages(name, text)
        if held is None:
            counted = PipelineModel(stages=self.stages).transform(dealt_out(ready))
            held = hold(counted.select(_counted(CANDIDATES[name][0]), *columns))
        self.held = held
        self.at_a_time = fits_at_a_time(held)

    def fitted(self, rows: str = "true") -> tuple[list, DataFrame]:
        """The stages that are fitted on some of the held rows, and these rows with features."""
        part = self.held.filter(rows)
        if CANDIDATES[self.name][0] != "logistic":
            return [], part
        idf = IDF(inputCol="counts", outputCol="features").fit(part)
        return [idf], idf.transform(part).select("features", *self.columns)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.own:
            self.held.unpersist()


def estimator(name: str, cfg: Config):
    kind = CANDIDATES[name][0]
    if kind == "logistic":
        return LogisticRegression(
            featuresCol="features", labelCol="class_id", weightCol="weight", regParam=cfg.weight_decay,
            elasticNetParam=cfg.elastic_net, maxIter=cfg.iterations, tol=cfg.tolerance,
        )
    return NaiveBayes(featuresCol="features", labelCol="class_id", weightCol="weight", modelType=kind)


def train_weights(train: DataFrame, label: str, cfg: Config) -> DataFrame:
    """``weight`` per row from the class sizes of the training part only."""
    if not cfg.use_class_weights:
        return train.withColumn("weight", F.lit(1.0))
    counts = train.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return attach_weights(train, weights_from_counts(counts), label)


def _prepared(train: DataFrame, text: str, label: str, cfg: Config, index: StringIndexerModel) -> DataFrame:
    narrow = train.select(F.col(text), F.col(label).cast("string").alias(label))
    return index.transform(train_weights(narrow, label, cfg))


def index_classes(train: DataFrame, label: str) -> StringIndexerModel:
    """Class ids by sorted label, from the training part."""
    return StringIndexer(
        inputCol=label, outputCol="class_id", stringOrderType="alphabetAsc", handleInvalid="skip"
    ).fit(train.select(F.col(label).cast("string").alias(label)))


def fit_model(name: str, train: DataFrame, text: str, label: str, cfg: Config) -> Trained:
    """Train one candidate: token and feature stages, then the weighted estimator."""
    started = time.monotonic()
    index = index_classes(train, label)
    ready = _prepared(train, text, label, cfg, index)
    with Features(name, ready, text, ["class_id", "weight"]) as features:
        return _fitted(features, index, cfg, started)


def _fitted(features: Features, index: StringIndexerModel, cfg: Config, started: float) -> Trained:
    scaling, data = features.fitted()
    rounds: list[float] = []
    last = fit_estimator(features.name, data, cfg, rounds, features.at_a_time)
    model = PipelineModel(stages=[*features.stages, *scaling, last])
    return Trained(features.name, model, list(index.labels), time.monotonic() - started, config=cfg, rounds=rounds)


def dealt_out(texts: DataFrame) -> DataFrame:
    """``texts`` in equal partitions, the same number for each core, and in fewer where rows are few.

    Hashing, every pass over the counts and every iteration of a fit take as long as their largest task. Files
    differ in size, may be one more than there are cores, or hold one part of a split only. A partition is kept,
    and sent to another executor, as a whole, so it has a bound.
    """
    cores, n = max(1, texts.sparkSession.sparkContext.defaultParallelism), texts.count()
    a_core = max(PARTS_A_CORE, -(-n // (MOST_ROWS_A_PART * cores)))
    return texts.repartition(max(1, min(cores * a_core, -(-n // ROWS_A_PART))))


def fits_at_a_time(held: DataFrame) -> int:
    """PARALLEL_FITS, or one where ``held`` is so large that their copies of it would not stay in memory.

    One fit has a task for each core anyway. Tasks of several wait for the executor that has their copy, and
    are then given to another one, which has to be sent the whole partition.
    """
    size = int(held.select("*")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = max(1, held.sparkSession.sparkContext.defaultParallelism)
    return PARALLEL_FITS if size <= COPIED_A_CORE * cores else 1


def by_cores(data: DataFrame) -> DataFrame:
    """``data`` in no more partitions than there are cores, as each of them sends all slopes in each step."""
    return data.coalesce(max(1, data.sparkSession.sparkContext.defaultParallelism))


def fit_estimator(name: str, data: DataFrame, cfg: Config, rounds: list[float] | None = None, at_a_time: int = PARALLEL_FITS):
    """The estimator fitted on ``features``, ``class_id`` and ``weight``; focal losses go to ``rounds``."""
    fitted = in_blocks(estimator(name, cfg), at_a_time).fit(by_cores(data))
    if cfg.use_focal_loss and CANDIDATES[name][0] == "logistic":
        fitted = _focal(name, data, fitted, cfg, [] if rounds is None else rounds, min(at_a_time, STEPS_AT_A_TIME))
    return fitted


def in_blocks(one, at_a_time: int):
    """The estimator ``one``, with small blocks where the table is so large that its fits go one at a time."""
    return one.setMaxBlockSizeInMB(BLOCK_MB) if at_a_time == 1 and isinstance(one, LogisticRegression) else one


def refit(name: str, data: DataFrame, cfg: Config, last, at_a_time: int = PARALLEL_FITS):
    """A few more iterations of the estimator, from the coefficients of ``last`` on."""
    one = in_blocks(estimator(name, replace(cfg, max_iter=min(cfg.iterations, ITERATIONS_PER_EPOCH))), at_a_time)
    one._java_obj.setInitialModel(last._java_obj)
    return one.fit(by_cores(data))


def _true_p(model, data: DataFrame) -> DataFrame:
    p = F.get(vector_to_array("probability"), F.col("class_id").cast("int"))
    return model.transform(data).select("features", "class_id", "weight", "_made", clipped(p).alias("p"))


def _focal_factor(p: Column, gamma: float) -> Column:
    """What the slope of the focal loss is as a multiple of that of the cross-entropy."""
    return F.pow(1 - p, F.lit(gamma)) * (1 + gamma * p * -F.ln(p) / (1 - p))


#: Focal training ends when a round lowers the loss by less than this share of it.
FOCAL_TOLERANCE = 1e-4
FOCAL_STEPS = (1.0, 0.5, 0.25, 0.125)
STEPS_AT_A_TIME = 2


def step_order(taken: int) -> list[float]:
    """All FOCAL_STEPS for the round after one that took the step of this number."""
    start = max(taken - 1, 0)
    return [*FOCAL_STEPS[start:], *reversed(FOCAL_STEPS[:start])]


#: Numbers of the models that are sent along to weigh the rows anew, as for contributions of words.
SENT_NUMBERS = 1 << 24


def _remade(rows: DataFrame, steps: list[tuple], gamma: float) -> DataFrame:
    """``rows`` with the weights ``_made`` after some steps, each ``(model, mean, step)``: a model, the mean factor
    under it, and how far the step goes towards its factors."""
    for model, mean, step in steps:
        new = _focal_factor(F.col("p"), gamma) / mean
        # All the way takes nothing of the weights before.
        made = new if step == 1 else (1 - step) * F.col("_made") + step * new
        rows = _true_p(model, rows).select("features", "class_id", "weight", made.alias("_made"))
    return rows


def _focal(name: str, data: DataFrame, first, cfg: Config, rounds: list[float], at_a_time: int = STEPS_AT_A_TIME):
    """Focal training by reweighting, round by round to a fixed point.

    A row weighs the quotient of the slopes of its focal loss and of its cross-entropy, so where the
    weights no longer change the slope of the focal loss is zero. A round goes from the weights that
    made the present model towards the new ones, all the way or half of it and so on, until the
    focal loss falls; where it falls at none of FOCAL_STEPS, training is over. A round begins one step
    above the one that the round before took, and tries the larger ones last; ``at_a_time`` steps are tried
    at a time, of which the earliest counts. A penalty is relative
    to the weighted loss, as in any fit with weights. The fit of a round goes on from the coefficients
    of the round before, and so do the rounds until the loss stands still; none starts from zero.

    Rows are weighed anew in each pass, by the models since the last step all the way, instead of held with their
    weights, which would be a copy of all features for each step. They are held only where these models have more
    than SENT_NUMBERS coefficients.
    """
    gamma, p = cfg.focal_gamma, F.col("p")
    loss_of = F.sum(F.col("weight") * F.pow(1 - p, F.lit(gamma)) * -F.ln(p)) / F.sum("weight")
    mean_of = F.sum(F.col("weight") * _focal_factor(p, gamma)) / F.sum("weight")

    plain = data.withColumn("_made", F.lit(1.0))

    def judged(model):
        return _true_p(model, plain).agg(loss_of.alias("loss"), mean_of.alias("mean")).first()

    def tried(step: float) -> tuple:
        steps = [*([] if step == 1 else made), (model, now["mean"], step)]
        told = _remade(plain if step == 1 else rows, steps, gamma)
        fitted = refit(name, told.withColumn("weight", F.col("weight") * F.col("_made")), cfg, model, at_a_time)
        return steps, fitted, judged(fitted)

    rows, made, model, now, at = plain, [], first, judged(first), 0
    rounds.append(now["loss"])
    try:
        for _ in range(cfg.focal_rounds):
            order = step_order(at)
            for i in range(0, len(order), at_a_time):
                done = together(tried, order[i : i + at_a_time])
                falls = [k for k, (_, _, after) in enumerate(done) if after["loss"] < now["loss"]]
                if falls:
                    break
            else:
                break
            steps, fitted, after = done[falls[0]]
            gain, step = (now["loss"] - after["loss"]) / now["loss"], order[i + falls[0]]
            if step == 1 and rows is not plain:
                rows.unpersist()
                rows = plain
            made, model, now, at = steps, fitted, after, FOCAL_STEPS.index(step)
            rounds.append(now["loss"])
            if gain < FOCAL_TOLERANCE:
                break
            if sum(m.coefficientMatrix.numRows * m.coefficientMatrix.numCols for m, _, _ in made) > SENT_NUMBERS:
                before, rows, made = rows, hold(_remade(rows, made, gamma)), []
                if before is not plain:
                    before.unpersist()
    finally:
        if rows is not plain:
            rows.unpersist()
    return model


def fit_focal(train: DataFrame, text: str, label: str, gamma: float, name: str = "lr_unigram", cfg=Config()) -> Trained:
    return fit_model(name, train, text, label, replace(cfg, use_focal_loss=True, focal_gamma=gamma))


def fit_models(names, train: DataFrame, text: str, label: str, configs) -> list[Trained]:
    """Train the candidates, PARALLEL_FITS at a time; one that fails is kept with its error.

    ``configs`` is one ``Config`` for all, or one per name. The narrow training table is persisted once
    for all candidates, and hashed once for those on tokens and once for those on pairs, which are fitted
    after the former have left the memory. The seconds of a candidate contain the hashing it shares.
    """
    cfgs = {n: configs if isinstance(configs, Config) else configs[n] for n in names}
    done = {n: Trained(n, error=f"there is no candidate {n}", config=cfgs[n]) for n in cfgs if n not in CANDIDATES}
    shared = hold(train.select(text, label))
    try:
        for pairs in (False, True):
            group = {n: cfg for n, cfg in cfgs.items() if n not in done and CANDIDATES[n][2] == pairs}
            done |= _fit_group(group, shared, text, label) if group else {}
    finally:
        shared.unpersist()
    return [done[n] for n in names]


def _fit_group(cfgs: dict[str, Config], train: DataFrame, text: str, label: str) -> dict[str, Trained]:
    """Candidates of the same terms, fitted on counts that one pass over the texts has made."""
    started, held = time.monotonic(), None

    def one(name: str) -> Trained:
        cfg, kind = cfgs[name], CANDIDATES[name][0]
        try:
            weight = F.col("weight") if cfg.use_class_weights else F.lit(1.0)
            mine = held.select(F.col(shared_counts(name)).alias(_counted(kind)), "class_id", weight.alias("weight"))
            with Features(name, train, text, ["class_id", "weight"], mine) as features:
                return _fitted(features, index, cfg, started)
        except Exception as error:  # a failing candidate must not end the run
            return Trained(name, error=str(error), config=cfg)

    try:
        index = index_classes(train, label)
        weighted = any(cfg.use_class_weights for cfg in cfgs.values())
        ready = _prepared(train, text, label, Config(use_class_weights=weighted), index)
        counted = PipelineModel(stages=shared_stages(cfgs, text)).transform(dealt_out(ready))
        columns = dict.fromkeys(shared_counts(n) for n in cfgs)
        held = hold(counted.select(*columns, "class_id", "weight"))
        return dict(zip(cfgs, together(one, list(cfgs), fits_at_a_time(held))))
    except Exception as error:
        return {n: Trained(n, error=str(error), config=cfg) for n, cfg in cfgs.items()}
    finally:
        if held is not None:
            held.unpersist()


def predictions(fitted: list[Trained], df: DataFrame, text: str) -> DataFrame:
    """Each row of ``df`` once per candidate, with ``model`` and ``prediction``, from one pass over the texts.

    The rows are those of ``score`` of every candidate. One that could not be fitted is an error.
    """
    for one in fitted:
        if one.model is None:
            raise ValueError(f"{one.name} was not fitted: {one.error}")
    stages, told = shared_stages([one.name for one in fitted], text), []
    for i, one in enumerate(fitted):
        source, own = shared_counts(one.name), one.model.stages[len(hashing_stages(one.name, text)) :]
        for scaling in own[:-1]:
            stages.append(scaling.copy().setInputCol(source).setOutputCol(f"_features{i}"))
            source = f"_features{i}"
        last = own[-1].copy().setFeaturesCol(source).setProbabilityCol("")
        stages.append(last.setRawPredictionCol(f"_raw{i}").setPredictionCol(f"_at{i}"))
        names = F.array(*[F.lit(c) for c in one.classes])
        told.append(F.struct(F.lit(one.name).alias("model"), F.get(names, F.col(f"_at{i}").cast("int")).alias("prediction")))
    return PipelineModel(stages=stages).transform(df).select(*df.columns, F.inline(F.array(*told)))


def together(work, items, at_a_time: int = PARALLEL_FITS) -> list:
    """Results in the order of the items; each item is a series of Spark jobs of its own."""
    with ThreadPoolExecutor(at_a_time) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(work), items))


@dataclass
class TrainedLabels:
    """One binary model per atomic label over shared features."""

    features: PipelineModel
    models: list
    classes: list[str]
    seconds: float = 0.0
    name: str = "lr_unigram"
    error: str | None = None
    config: Config | None = None

    @property
    def model(self) -> PipelineModel:
        """The feature stages, then the models in the order of the classes: what is saved."""
        return PipelineModel(stages=[*self.features.stages, *self.models])

    @classmethod
    def of(cls, name: str, model: PipelineModel, classes: list[str]) -> TrainedLabels:
        """The inverse of ``model``."""
        at = len(model.stages) - len(classes)
        return cls(PipelineModel(stages=model.stages[:at]), model.stages[at:], classes, name=name)

    def score(self, df: DataFrame) -> DataFrame:
        """Rows with ``names``, ``p`` and the ``predicted`` labels."""
        scored = self.features.transform(df)
        for i, model in enumerate(self.models):
            model = model.copy()
            for setter, stem in (("setRawPredictionCol", "_raw"), ("setProbabilityCol", "_prob"), ("setPredictionCol", "_pred")):
                getattr(model, setter)(f"{stem}{i}")
            scored = model.transform(scored)
        p = F.array(*[F.get(vector_to_array(f"_prob{i}"), F.lit(1)) for i in range(len(self.models))])
        names = F.array(*[F.lit(c) for c in self.classes])
        return decide_multilabel(scored.select(*df.columns, names.alias("names"), p.alias("p")))


def fit_multilabel(train: DataFrame, text: str, label: str, cfg: Config = Config(), name: str = "lr_unigram") -> TrainedLabels:
    """A weighted logistic model per atomic label; positives count ``pos_weight`` times."""
    started = time.monotonic()
    weights = {r["label"]: r["pos_weight"] for r in pos_weights(train, label).collect()}
    classes = [r["label"] for r in atomic_labels(train, label).orderBy("class_id").collect()]
    hot = multi_hot(train, label).select(text, "multi_hot")
    with Features(name, hot, text, ["multi_hot"]) as features:
        scaling, data = features.fitted()

        def one(i: int):
            y = F.get("multi_hot", F.lit(i)).cast("double")
            rows = data.select("features", y.alias("class_id"))
            weight = F.when(F.col("class_id") == 1, F.lit(float(weights[classes[i]]))).otherwise(1.0)
            return in_blocks(estimator(name, cfg), features.at_a_time).fit(rows.withColumn("weight", weight))

        models = together(one, range(len(classes)), features.at_a_time)
    return TrainedLabels(PipelineModel(stages=[*features.stages, *scaling]), models, classes, time.monotonic() - started, name, config=cfg)


def fit_multilabels(names, train: DataFrame, text: str, label: str, cfg: Config) -> list:
    """The candidates one by one, as each fits its labels together; one that fails is kept with its error."""
    fitted = []
    for name in names:
        try:
            fitted.append(fit_multilabel(train, text, label, cfg, name))
        except Exception as error:
            fitted.append(Trained(name, error=str(error), config=cfg))
    return fitted


def training_curve(spark: SparkSession, trained: Trained) -> DataFrame:
    """Objective per iteration of a logistic model, with the step of the lowest value."""
    history = list(trained.model.stages[-1].summary.objectiveHistory)
    best = min(range(len(history)), key=history.__getitem__)
    rows = [(trained.name, i, float(v), i == best) for i, v in enumerate(history)]
    return spark.createDataFrame(rows, "model string, step int, objective double, best boolean")


def evaluate(trained: Trained, df: DataFrame, label: str) -> tuple[dict, float]:
    """Metrics of one model on a labelled table, and the scoring time per row in ms."""
    started = time.monotonic()
    row = metrics(trained.score(df.select(F.col(label).cast("string").alias("label"), *_others(df, label)))).first()
    n = max(row["n_rows"], 1)
    return {m: row[m] for m in METRICS}, (time.monotonic() - started) * 1000 / n


def _others(df: DataFrame, label: str) -> list[str]:
    return [c for c in df.columns if c not in (label, "label", "prediction", "p")]


def trial_settings(cfg: Config, trials: int) -> list[Config]:
    """Seeded settings to try: decay and elastic net uniform, iterations within the epochs."""
    draw = random.Random(cfg.seed)
    low, high = cfg.decay_bounds
    return [
        replace(
            cfg,
            weight_decay=draw.uniform(low, high),
            elastic_net=draw.uniform(0.0, 1.0),
            max_iter=draw.randint(*cfg.epochs) * ITERATIONS_PER_EPOCH,
        )
        for _ in range(trials)
    ]


def search(proxy: DataFrame, text: str, label: str, cfg: Config, name: str = "lr_unigram", trials: int | None = None) -> tuple[Config, list[dict]]:
    """Settings with the best weighted F1 on the search sample, and the record of all trials.

    ``proxy`` is a table with the roles of ``proxy_sample``. The tier with the fewest rows is
    not searched; failed trials are left out; without a success the given settings stand.
    """
    if cfg.strategy == "CRITICAL" or CANDIDATES[name][0] != "logistic":
        return cfg, []
    settings = trial_settings(cfg, cfg.trials if trials is None else trials)
    sample = proxy.filter("role <> 'unused'").select(text, F.col(label).cast("string").alias(label), "role")
    in_train, in_val = "role in ('proxy_train', 'both')", "role in ('proxy_val', 'both')"
    index = index_classes(sample.filter(in_train), label)
    weighted = weighted_part(sample, label, cfg, in_train)
    with Features(name, weighted, text, [label, "weight", "role"]) as features:
        scaling, data = features.fitted(in_train)
        data = index.transform(data)

        def one(i: int) -> dict:
            entry = {
                "trial": i, "weight_decay": settings[i].weight_decay, "elastic_net": settings[i].elastic_net,
                "max_iter": settings[i].iterations, "f1": None, "error": None,
            }
            try:
                model = PipelineModel(stages=[*scaling, fit_estimator(name, data, settings[i], None, features.at_a_time)])
                scores, _ = evaluate(Trained(name, model, list(index.labels)), features.held.filter(in_val), label)
                entry["f1"] = scores["f1"]
            except Exception as error:
                entry["error"] = str(error)
            return entry

        record = together(one, range(len(settings)), features.at_a_time)
    done = [r for r in record if r["f1"] is not None]
    best = max(done, key=lambda r: (r["f1"], -r["trial"]), default=None)
    return cfg if best is None else settings[best["trial"]], record


def weighted_part(df: DataFrame, label: str, cfg: Config, rows: str) -> DataFrame:
    """``weight`` from the class sizes of some of the rows; classes without any count once."""
    if not cfg.use_class_weights:
        return df.withColumn("weight", F.lit(1.0))
    counts = df.filter(rows).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return attach_weights(df, weights_from_counts(counts), label).fillna(1.0, ["weight"])


FOLD_SCHEMA = (
    "fold int, f1 double, accuracy double, precision double, recall double, "
    "n_train long, n_val long, error string"
)


def cross_validate(folded: DataFrame, text: str, label: str, name: str, cfg: Config) -> DataFrame:
    """Metrics per fold of a table with a ``fold`` column; weights are those of each fold's train
    part. A failing fold is recorded with its error."""
    data = folded.select(text, F.col(label).cast("string").alias(label), "fold")
    index = index_classes(data, label)
    sizes = {r["fold"]: r["count"] for r in data.groupBy("fold").count().collect()}
    total = sum(sizes.values())
    try:
        features = Features(name, index.transform(data), text, [label, "class_id", "fold"])
    except Exception as error:
        rows = [(fold, None, None, None, None, total - n, n, str(error)) for fold, n in sorted(sizes.items())]
        return folded.sparkSession.createDataFrame(rows, FOLD_SCHEMA)
    # Texts are hashed once; folds differ in the rows that the rest is fitted on.
    with features:

        def one(fold: int) -> tuple:
            n_val = sizes[fold]
            try:
                scaling, rest = features.fitted(f"fold <> {int(fold)}")
                model = PipelineModel(stages=[*scaling, fit_estimator(name, weighted_part(rest, label, cfg, "true"), cfg, None, features.at_a_time)])
                val = features.held.filter(F.col("fold") == fold)
                scores, _ = evaluate(Trained(name, model, list(index.labels)), val, label)
                return (fold, *[scores[m] for m in METRICS], total - n_val, n_val, None)
            except Exception as error:
                return (fold, None, None, None, None, total - n_val, n_val, str(error))

        rows = together(one, sorted(sizes), features.at_a_time)
    return folded.sparkSession.createDataFrame(rows, FOLD_SCHEMA)


def cross_validate_multilabel(folded: DataFrame, text: str, label: str, name: str, cfg: Config) -> DataFrame:
    """``cross_validate`` for a multi-label column; each fold has the labels and weights of its
    train part."""
    sizes = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}
    total, rows = sum(sizes.values()), []
    for fold, n_val in sorted(sizes.items()):
        try:
            fitted = fit_multilabel(folded.filter(F.col("fold") != fold), text, label, cfg, name)
            val = folded.filter(F.col("fold") == fold)
            scores = metrics_multilabel(fitted.score(val.withColumn("labels", parse_labels(val, label)))).first()
            rows.append((fold, *[float(scores[m]) for m in METRICS], total - n_val, n_val, None))
        except Exception as error:
            rows.append((fold, None, None, None, None, total - n_val, n_val, str(error)))
    return folded.sparkSession.createDataFrame(rows, FOLD_SCHEMA)
