"""Train/validation splits, folds and search samples with exact sizes per class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.functions.groups import keys, small_table, with_totals
from textlab.operators.ranks import cuts_passed, row_key
from textlab.plans.rules import val_split

SMALL_VALIDATION = 5
MIN_FOLDS = 2
# Bounds of the search samples (share of the rows, least, most).
PROXY_VAL = (0.1, 20, 500)
PROXY_TRAIN = (0.3, 40, 2000)


def quotas(counts: DataFrame, wanted: Column, by=(), size: str = "n", name: str = "quota") -> DataFrame:
    """Share out ``wanted`` rows over the classes by largest remainder, ties by label.

    ``counts`` is the class table with ``total``; ranking it is a sort of the classes only.
    """
    exact = F.col("_wanted") * F.col(size) / F.col("_total")
    base = with_totals(counts, by, _total=F.sum(size)).withColumn("_wanted", wanted)
    base = base.withColumn("_floor", F.floor(exact)).withColumn("_rest", exact - F.col("_floor"))
    given = with_totals(base, by, _given=F.sum("_floor"))
    order = Window.partitionBy(*keys(by)).orderBy(F.desc("_rest"), "label")
    extra = (F.row_number().over(order) <= F.col("_wanted") - F.col("_given")).cast("long")
    return given.withColumn(name, F.col("_floor") + extra).drop(
        "_total", "_wanted", "_floor", "_rest", "_given"
    )


def _classes(df: DataFrame, label: str, by) -> DataFrame:
    """The class table, from one pass; what is planned on it does not read ``df`` again."""
    return small_table(df.groupBy(*by, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")))


def _per_class(df: DataFrame, cuts: DataFrame, label: str, id_col: str, by, seed: int, name: str):
    """``cuts_passed`` with the classes of ``label`` inside the groups of ``by``."""
    renamed = cuts.withColumnRenamed("label", label) if label != "label" else cuts
    return cuts_passed(df, id_col, renamed, [*by, label], seed, name)


def stratified_split(
    df: DataFrame, label: str, id_col: str, ratio: float | None = None, seed: int = 42, by=()
) -> DataFrame:
    """Add ``split``: ``ceil(ratio * n)`` validation rows, shared out over the classes."""
    by = keys(by)
    share = F.lit(float(ratio)) if ratio is not None else val_split(F.col("_total"))
    plan = quotas(_classes(df, label, by), F.ceil(share * F.col("_total")), by)
    cuts = plan.select(*by, "label", (F.col("n") - F.col("quota")).alias("rank"))
    return _with_part(_per_class(df, cuts, label, id_col, by, seed, "_passed"))


def _with_part(marked: DataFrame) -> DataFrame:
    """The rows before the cut train, those after it validate."""
    part = F.when(F.col("_passed") == 0, "train").otherwise("val")
    return marked.withColumn("split", part).drop("_passed")


def random_split(
    df: DataFrame, id_col: str, ratio: float | None = None, seed: int = 42, by=()
) -> DataFrame:
    """Add ``split`` without regard to labels: the first ``int(n * (1 - ratio))`` train."""
    by = keys(by)
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    share = F.lit(float(ratio)) if ratio is not None else val_split(F.col("n"))
    cuts = n.select(*by, F.floor(F.col("n") * (1 - share)).alias("rank"))
    return _with_part(cuts_passed(df, id_col, cuts, by, seed, "_passed"))


def repair_split(df: DataFrame, label: str, id_col: str, seed: int = 42) -> DataFrame:
    """Move the last-ranked row of every class that has validation rows only to train.

    At most one row per class moves, so the rows pass a broadcast join and are not shuffled.
    """
    moved = (
        df.groupBy(label)
        .agg(F.count_if(F.col("split") == "train").alias("_n"), F.max(row_key(id_col, seed)).alias("_last"))
        .filter("_n = 0")
        .select(F.col("_last.id").alias(id_col), F.lit("train").alias("_split"))
    )
    joined = df.join(small_table(moved), id_col, "left")
    kept = [c for c in df.columns if c != "split"]
    return joined.select(*kept, F.coalesce("_split", "split").alias("split"))


def split_report(df: DataFrame, by=()) -> DataFrame:
    """Sizes of both parts and the verdict on the validation part."""
    n_val = F.count_if(F.col("split") == "val")
    return df.groupBy(*keys(by)).agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        n_val.alias("n_val"),
        F.when(n_val == 0, "empty")
        .when(n_val < SMALL_VALIDATION, "unreliable")
        .otherwise("ok")
        .alias("verdict"),
    )


def require_validation(df: DataFrame) -> DataFrame:
    if split_report(df).first()["verdict"] == "empty":
        raise ValueError("the validation part is empty; use more data or cross-validation")
    return df


def _fold_cuts(sizes: DataFrame, group) -> DataFrame:
    """Ranks at which a class of ``n`` rows changes fold: ``ceil(j * n / k)`` for j = 1..k-1."""
    borders = F.transform(
        F.sequence(F.lit(1), F.col("k").cast("int") - 1),
        lambda j: F.ceil(j * F.col("n") / F.col("k")),
    )
    return sizes.select(*group, F.explode(borders).alias("rank"))


def stratified_folds(
    df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = 42, by=()
) -> DataFrame:
    """Add ``fold`` 0..k-1: equal stretches of each class in hash order.

    ``k`` shrinks to the smallest class, to 2 at least.
    """
    by = keys(by)
    sizes = with_totals(_classes(df, label, by), by, least=F.min("n"))
    sizes = sizes.withColumn("k", F.greatest(F.lit(MIN_FOLDS), F.least(F.lit(k), F.col("least"))))
    return _per_class(df, _fold_cuts(sizes, [*by, "label"]), label, id_col, by, seed, "fold")


def random_folds(df: DataFrame, id_col: str, k: int = 5, seed: int = 42, by=()) -> DataFrame:
    """Add ``fold`` 0..k-1 without regard to labels."""
    by = keys(by)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("k", F.greatest(F.lit(MIN_FOLDS), F.least(F.lit(k), F.col("n"))))
    return cuts_passed(df, id_col, _fold_cuts(sizes, by), by, seed, "fold")


def _clamped(n: Column, bounds) -> Column:
    share, least, most = bounds
    return F.greatest(F.lit(least), F.least(F.lit(most), F.floor(n * F.lit(share))))


def proxy_sample(
    train: DataFrame, label: str, id_col: str, seed: int = 42, by=(), val_bounds=PROXY_VAL, train_bounds=PROXY_TRAIN
) -> DataFrame:
    """Add ``role`` for the search: ``proxy_val`` and ``proxy_train`` of fixed sizes, stratified.

    Both come from the training rows. The bounds are the share of the rows, the least and the most of
    them. A table too small for both parts gets ``both`` everywhere.
    """
    by = keys(by)
    counts = with_totals(_classes(train, label, by), by, total=F.sum("n"))
    n_val, n_train = _clamped(F.col("total"), val_bounds), _clamped(F.col("total"), train_bounds)
    plan = quotas(counts, n_val, by, name="q_val").withColumn("rest", F.col("n") - F.col("q_val"))
    plan = quotas(plan, n_train, by, size="rest", name="q_train")
    whole = n_val + n_train >= F.col("total")
    ranks = F.when(whole, F.array(F.lit(0), F.lit(0), F.lit(0))).otherwise(
        F.array(F.col("q_val"), F.col("q_val") + F.col("q_train"))
    )
    cuts = plan.select(*by, "label", F.explode(ranks).alias("rank"))
    marked = _per_class(train, cuts, label, id_col, by, seed, "_passed")
    role = (
        F.when(F.col("_passed") == 0, "proxy_val")
        .when(F.col("_passed") == 1, "proxy_train")
        .when(F.col("_passed") == 2, "unused")
        .otherwise("both")
    )
    return marked.withColumn("role", role).drop("_passed")
