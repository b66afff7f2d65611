"""Dataset analysis: measurements of a table and the training decisions they lead to.

Each function adds columns to one row per group, so a whole table and any number of segments
are analysed by the same plan. Reasons name whole numbers only, so that they do not depend on
how an engine rounds when it formats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions.groups import join_on, keys
from textlab.functions.text import CHARS_PER_TOKEN, token_count
from textlab.operators.labels import FOCAL_RATIO, WEIGHT_RATIO, class_counts, is_number
from textlab.plans import rules


def text_length(df: DataFrame, text: str, by=(), mode: str = "token") -> DataFrame:
    """Length statistics and the maximum length: p95 of the token counts, within 16..512.

    Rows are first counted per length, so the exact percentiles see distinct lengths only.
    ``mode='char4'`` estimates tokens by a quarter of the characters.
    """
    by = keys(by)
    shown = F.coalesce(F.col(text).cast("string"), F.lit("nan"))
    size = token_count(shown) if mode == "token" else F.length(shown)
    lengths = df.groupBy(*by, size.cast("long").alias("_size")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.length(shown).cast("long")).alias("_chars")
    )
    n = F.sum("_n")
    high = F.percentile("_size", F.array(F.lit(0.95), F.lit(0.99)), F.col("_n"))
    over = F.sum(F.when(F.col("_size") > rules.MAX_LENGTH, F.col("_n")).otherwise(0))
    stats = lengths.groupBy(*by).agg(
        n.alias("n_rows"),
        (F.sum(F.col("_size") * F.col("_n")) / n).alias("avg_length"),
        F.min("_size").alias("min_length"),
        F.transform(high, lambda p: F.floor(F.round(p, 6))).alias("_high"),
        (over / n).alias("share_over"),
        (F.sum("_chars") / n).alias("avg_chars"),
    )
    p95, p99 = F.col("_high")[0], F.col("_high")[1]
    if mode == "token":
        raw, top, longest = p95, F.least(p99, F.lit(rules.MAX_LENGTH)), rules.clamp_length(p95)
    else:
        longest = rules.clamp_length(F.floor(p95 / CHARS_PER_TOKEN))
        raw, top = longest, rules.clamp_length(F.floor(p99 / CHARS_PER_TOKEN))
    return stats.select(
        *by, "n_rows", "avg_length", "min_length", raw.alias("p95_raw"), top.alias("p99_length"),
        longest.alias("max_length"), "share_over", "avg_chars",
    )


def class_facts(df: DataFrame, label: str, by=(), multi_label: bool = False) -> DataFrame:
    """Everything that follows from the class table alone, in one aggregate over it."""
    by = keys(by)
    counts = class_counts(df, label, by, multi_label)
    return counts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_classes"),
        F.sum("n").alias("label_count"),
        F.max("n").alias("max_class"),
        F.min("n").alias("min_class"),
        F.avg("n").alias("mean_class"),
        F.stddev_pop("n").alias("std_class"),
        F.bool_and(is_number(F.col("label"))).alias("numeric_labels"),
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "label"))).alias("_classes"),
    )


def facts(df: DataFrame, label: str, text: str, by=(), multi_label: bool = False, mode: str = "token") -> DataFrame:
    """Task, imbalance, sizes and text lengths per group: two passes, labels and texts."""
    by = keys(by)
    classes, lengths = class_facts(df, label, by, multi_label), text_length(df, text, by, mode)
    if by:
        joined = join_on(classes, lengths, by)
    else:
        told = classes.withColumn("_t", lengths.select(F.struct("*")).scalar())
        joined = told.select(*classes.columns, "_t.*")
    k = F.greatest(F.col("num_classes"), F.lit(1))
    ratio = F.col("max_class") / F.col("min_class")
    if multi_label:
        task, kind = F.lit("multi_label"), F.lit("categorical")
    else:
        task = F.when(F.col("num_classes") == 2, "binary").otherwise("multiclass")
        kind = F.when(F.col("numeric_labels"), "numeric").otherwise("categorical")
    named = F.transform("_classes", lambda c: F.struct(c["label"].alias("label"), (-c["m"]).alias("n")))
    return joined.select(
        *by,
        "n_rows",
        task.alias("task_type"),
        kind.alias("label_type"),
        "num_classes",
        "label_count",
        named.alias("class_distribution"),
        "max_class",
        "min_class",
        (F.col("std_class") / F.col("mean_class")).alias("class_variation"),
        (F.col("n_rows") / k).alias("rows_per_class"),
        (F.col("label_count") / k).alias("labels_per_class"),
        ratio.alias("imbalance_ratio"),
        (F.col("min_class") / F.col("n_rows")).alias("minority_share"),
        (ratio > WEIGHT_RATIO).alias("use_class_weights"),
        (F.lit(not multi_label) & (ratio > FOCAL_RATIO)).alias("use_focal_loss"),
        *[c for c in lengths.columns if c not in [*by, "n_rows"]],
    )


def select_models(table: DataFrame) -> DataFrame:
    models = rules.candidate_models(F.col("n_rows"))
    return table.withColumn("models", models).withColumn(
        "oversized_models", rules.oversized_models(F.col("n_rows"), models)
    )


def training_config(table: DataFrame) -> DataFrame:
    """Tier and training settings by rows per class, adjusted for imbalance."""
    size, ratio = F.col("rows_per_class"), F.col("imbalance_ratio")

    def tier(value) -> Column:
        return rules.by_tier(size, value)

    return table.select(
        "*",
        tier(lambda t: t.name).alias("strategy"),
        tier(lambda t: t.epochs[0]).alias("epochs_min"),
        tier(lambda t: t.epochs[1]).alias("epochs_max"),
        tier(lambda t: t.batch).alias("batch_size"),
        tier(lambda t: t.learning_rate).alias("learning_rate"),
        tier(lambda t: t.lr_bounds[0]).alias("lr_min"),
        tier(lambda t: t.lr_bounds[1]).alias("lr_max"),
        rules.by_imbalance(ratio, 1, 0.0).alias("weight_decay"),
        tier(lambda t: t.decay_bounds[0]).alias("decay_min"),
        tier(lambda t: t.decay_bounds[1]).alias("decay_max"),
        F.lit(rules.WARMUP_RATIO).alias("warmup_ratio"),
        tier(lambda t: t.grad_clip).alias("grad_clip"),
        rules.patience(size, ratio).alias("patience"),
        tier(lambda t: t.schedule).alias("schedule"),
        tier(lambda t: t.dropout).alias("dropout"),
        rules.by_imbalance(ratio, 3, rules.FOCAL_GAMMA).alias("focal_gamma"),
        F.lit(rules.LABEL_SMOOTHING).alias("label_smoothing"),
    )


def run_recommendations(table: DataFrame) -> DataFrame:
    """Whether to cross-validate and to search, with the reason for either."""
    n, share, ratio = F.col("n_rows"), F.col("val_share"), F.col("imbalance_ratio")
    held = F.col("val_rows")
    tiny, small = held < rules.CV_TINY_VAL, held < rules.CV_SMALL_VAL
    skewed = ratio > rules.CV_IMBALANCE
    sizes = F.format_string("largest class %d, smallest %d", "max_class", "min_class")
    reason = (
        F.when(tiny, F.format_string("%d rows leave only %d to validate on", n, held))
        .when(small & skewed, F.format_string("%d validation rows, %s", held, sizes))
        .when(small, F.format_string("%d validation rows are few", held))
        .when(skewed, F.concat(F.lit("classes are uneven: "), sizes))
        .when(n > rules.CV_LARGE_ROWS, F.format_string("%d validation rows are reliable", held))
        .otherwise(F.format_string("%d validation rows are adequate", held))
    )
    told = table.withColumn("val_share", rules.val_split(n))
    told = told.withColumn("val_rows", F.floor(n * share))
    size = F.col("rows_per_class")
    return told.select(
        "*",
        (tiny | small | skewed).alias("use_cv"),
        F.lit(rules.CV_FOLDS).alias("cv_folds"),
        reason.alias("cv_reason"),
        rules.by_tier(size, lambda t: t.search).alias("use_search"),
        rules.by_tier(size, lambda t: t.trials).alias("search_trials"),
        F.format_string("%d labels in %d classes, tier %s", "label_count", "num_classes", "strategy").alias("search_reason"),
    )


def analyze(df: DataFrame, label: str, text: str, by=(), multi_label: bool = False, mode: str = "token") -> DataFrame:
    """The whole analysis, one flat row per group."""
    measured = facts(df, label, text, by, multi_label, mode)
    return run_recommendations(training_config(select_models(measured)))


# Sections of the analysis record and the columns they hold.
SECTIONS = {
    "task_info": ["task_type", "label_type", "num_classes", "label_count", "class_distribution"],
    "imbalance_info": [
        "imbalance_ratio", "minority_share", "use_class_weights", "use_focal_loss", "class_variation",
    ],
    "text_info": [
        "avg_length", "min_length", "p95_raw", "p99_length", "max_length", "share_over", "avg_chars",
    ],
    "model_selection": ["models", "oversized_models"],
    "training_config": [
        "strategy", "rows_per_class", "epochs_min", "epochs_max", "batch_size", "learning_rate",
        "lr_min", "lr_max", "weight_decay", "decay_min", "decay_max", "warmup_ratio", "grad_clip",
        "patience", "schedule", "dropout", "focal_gamma", "label_smoothing",
    ],
    "run_recommendations": [
        "val_share", "val_rows", "use_cv", "cv_folds", "cv_reason", "use_search", "search_trials",
        "search_reason",
    ],
}


def analysis_record(analysis: DataFrame, by=()) -> DataFrame:
    """The flat analysis as one nested record per group."""
    sections = [F.struct(*names).alias(section) for section, names in SECTIONS.items()]
    return analysis.select(*keys(by), "n_rows", *sections)


def analysis_long(analysis: DataFrame, by=()) -> DataFrame:
    """The analysis as ``(section, key, value)`` rows with values as text."""
    entries = [
        F.struct(F.lit(section).alias("section"), F.lit(name).alias("key"), _shown(analysis, name).alias("value"))
        for section, names in SECTIONS.items()
        for name in names
    ]
    return analysis.select(*keys(by), F.inline(F.array(*entries)))


def _shown(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    if kind == "array":
        return F.to_json(F.col(name))
    if kind == "double":
        return F.format_string("%.6f", F.col(name))
    return F.col(name).cast("string")


def decision_log(analysis: DataFrame, by=()) -> DataFrame:
    """One row per automatic decision: what, why, the value, and the alternatives not taken."""

    def entry(no, category, decision, reason, value, alternatives, when=None):
        row = F.struct(
            F.lit(no).alias("decision_no"), F.lit(category).alias("category"), decision.alias("decision"),
            reason.alias("reason"), value.alias("value"), alternatives.cast("array<string>").alias("alternatives"),
        )
        return row if when is None else F.when(when, row)

    def texts(*values):
        return F.array(*[F.lit(v) for v in values])

    task = F.col("task_type")
    weighted = F.col("use_class_weights")
    roster = texts(*rules.ROSTER)
    unused = F.array_except(roster, "models")
    entries = [
        entry(1, "task_detection", F.format_string("task is %s", task),
              F.format_string("%d classes; two are binary, more are multiclass", "num_classes"), task,
              F.when(task == "binary", texts("binary", "multiclass")).otherwise(texts("binary"))),
        entry(2, "class_imbalance",
              F.when(weighted, "class weights on").otherwise("class weights off"),
              F.format_string("largest class %d, smallest %d of %d rows; on above a ratio of %.0f",
                              "max_class", "min_class", "n_rows", F.lit(WEIGHT_RATIO)),
              weighted.cast("string"),
              F.when(weighted, texts()).otherwise(texts("class weights on"))),
        entry(3, "class_imbalance", F.lit("focal loss on"),
              F.format_string("%d to %d is above a ratio of %.0f", "max_class", "min_class", F.lit(FOCAL_RATIO)),
              F.lit("true"), texts(), when=F.col("use_focal_loss")),
        entry(4, "sequence_length", F.format_string("maximum length %d", "max_length"),
              F.format_string("p95 is %d, limits are %d to %d", "p95_raw", F.lit(rules.MIN_LENGTH), F.lit(rules.MAX_LENGTH)),
              F.col("max_length").cast("string"), texts()),
        entry(5, "model_selection", F.concat(F.lit("candidates "), F.array_join("models", ", ")),
              F.format_string("%d rows, tier %s", "n_rows", "strategy"), F.array_join("models", ","),
              F.when(F.size(unused) > 0, unused).otherwise(texts("(all selected)"))),
        entry(6, "hyperparameters", F.format_string("settings of tier %s", "strategy"),
              F.format_string("%d rows in %d classes, %d in the smallest", "n_rows", "num_classes", "min_class"),
              F.to_json(F.struct("strategy", "epochs_min", "epochs_max", "learning_rate", "batch_size",
                                 "weight_decay", "patience")),
              texts()),
    ]
    log = analysis.select(*keys(by), F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"))
    return log.select(*keys(by), "e.*")
