"""Confidence, calibration and word importance of scored tables."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.functions.groups import join_on, keys
from textlab.operators.contributions import word_contributions
from textlab.operators.ranks import exact_median, ranked
from textlab.plans.rules import calibration_verdict

LOW_CONFIDENCE = 0.80
BINS = 10
CONTINUATION = "##"


def confidence(p: str = "p") -> Column:
    return F.array_max(F.col(p))


def confidence_stats(scored: DataFrame, threshold: float = LOW_CONFIDENCE, by=(), p: str = "p") -> DataFrame:
    """Spread of the confidences, rounded to 4 places, and the rows below ``threshold``."""
    by = keys(by)
    told = scored.select(*by, confidence(p).alias("c"))
    low = F.count_if(F.col("c") < threshold)
    stats = told.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.bround(F.avg("c"), 4).alias("mean_confidence"),
        F.bround(F.min("c"), 4).alias("min_confidence"),
        F.bround(F.max("c"), 4).alias("max_confidence"),
        F.bround(F.stddev_pop("c"), 4).alias("std_confidence"),
        low.alias("low_confidence_count"),
        F.bround(low / F.count(F.lit(1)) * 100, 2).alias("low_confidence_pct"),
    )
    middle = exact_median(told, "c", by)
    joined = join_on(stats, middle, by) if by else stats.withColumn("median", middle.scalar())
    return joined.withColumn("median_confidence", F.bround("median", 4)).drop("median")


def bin_of(value: Column) -> Column:
    """Bin 0..9 of a value in [0, 1]: the number of inner edges ``i * 0.1`` it reaches.

    The edges are products of doubles, so 0.3 lies below the third one, as in histograms built
    on evenly spaced doubles. The last bin includes 1.
    """
    edges = [F.lit(i * 0.1) for i in range(1, BINS)]
    return sum((value >= e).cast("int") for e in edges)


def confidence_histogram(scored: DataFrame, by=(), p: str = "p") -> DataFrame:
    """Rows per confidence bin, empty bins included; one aggregate with a count per bin."""
    by = keys(by)
    told = scored.select(*by, bin_of(confidence(p)).alias("b"))
    counts = told.groupBy(*by).agg(*[F.count_if(F.col("b") == i).alias(f"b{i}") for i in range(BINS)])
    bins = [
        F.struct(
            F.lit(i).alias("bin"),
            F.lit(f"{i / BINS:.1f}–{(i + 1) / BINS:.1f}").alias("range"),
            F.col(f"b{i}").alias("n"),
        )
        for i in range(BINS)
    ]
    return counts.select(*by, F.inline(F.array(*bins)))


def calibration_bins(scored: DataFrame, by=(), p: str = "p") -> DataFrame:
    by = keys(by)
    told = scored.select(
        *by, confidence(p).alias("c"), (F.col("label") == F.col("prediction")).cast("int").alias("hit")
    )
    return told.groupBy(*by, bin_of(F.col("c")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("c").alias("confidence"), F.avg("hit").alias("accuracy")
    )


def calibration_error(scored: DataFrame, by=(), p: str = "p") -> DataFrame:
    """Expected calibration error over the ten bins, with its verdict."""
    bins = calibration_bins(scored, by, p)
    error = F.sum(F.abs(F.col("accuracy") - F.col("confidence")) * F.col("n")) / F.sum("n")
    totals = bins.groupBy(*keys(by)).agg(F.sum("n").alias("n_rows"), error.alias("ece"))
    return totals.withColumn("verdict", calibration_verdict(F.col("ece")))


def subword_groups(lists: DataFrame) -> DataFrame:
    """``(id, words)``: the words of each text in order, as ``(word, score)``, from the list of its
    ``##`` pieces, ``(id, pieces)`` with ``pos``, ``token`` and ``score`` in any order.

    A text stays in its row: its pieces are sorted and cut as one array, and nothing is shuffled.
    """
    one = lists.select(F.explode("pieces").alias("p")).select("p.*")
    kind = one.select(F.sum("score").alias("s")).schema["s"].dataType
    each = F.col("pieces")
    if one.columns != ["pos", "token", "score"] or one.schema["score"].dataType != kind:
        each = F.transform(each, lambda p: F.struct(p["pos"].alias("pos"), p["token"].alias("token"), p["score"].cast(kind).alias("score")))
    sorted_ = lists.select("id", F.sort_array(each).alias("_p"))
    first = lambda p, i: (i == 0) | F.coalesce(~p["token"].startswith(CONTINUATION), F.lit(False))
    at = F.filter(F.transform("_p", lambda p, i: F.when(first(p, i), i)), lambda i: i.isNotNull())
    cut = sorted_.select("id", "_p", at.alias("_at"))
    size = F.size("_p")

    token, score = (lambda i, c=c: F.get("_p", i)[c] for c in ("token", "score"))

    def word(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_at", k + 1), size)
        # By place, as a slice would copy the whole array for each word; most words are one piece.
        rest = F.sequence(start + 1, end - 1)
        parts = F.concat(F.array(token(start)), F.transform(rest, lambda i: F.substring(token(i), 3, 2**31 - 1)))
        total = F.aggregate(rest, score(start), lambda a, i: F.coalesce(a + score(i), a, score(i)).cast(kind))
        alone = F.struct(F.coalesce(token(start), F.lit("")).alias("word"), score(start).alias("score"))
        return F.when(end == start + 1, alone).otherwise(F.struct(F.array_join(parts, "").alias("word"), total.alias("score")))

    return cut.select("id", F.transform("_at", word).alias("words"))


def merge_subwords(pieces: DataFrame) -> DataFrame:
    """Join ``##`` pieces ``(id, pos, token, score)`` to the word before them, adding scores.

    A continuation at the very start of a text stays a word of its own.
    """
    lists = pieces.groupBy("id").agg(F.collect_list(F.struct("pos", "token", "score")).alias("pieces"))
    long = subword_groups(lists).select("id", F.posexplode("words").alias("_i", "_w"))
    return long.select("id", (F.col("_i") + 1).cast("long").alias("word_no"), "_w.word", "_w.score")


def word_scores(model: PipelineModel, rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, word, score, contribution)``: each word's share of the linear score of the predicted
    class, with its sign and without."""
    shares = word_contributions(model, rows, id_col, text)
    return shares.select(id_col, "word", F.abs("contribution").alias("score"), "contribution")


def word_importance(
    model: PipelineModel, df: DataFrame, id_col: str, text: str, n: int | None = None, k: int = 5
) -> DataFrame:
    """Scores of the words of all rows, or the first ``n``, normalised to 1 per row, best first.

    ``in_top`` marks the ``k`` strongest words of each row.
    """
    rows = df if n is None else df.orderBy(id_col).limit(n)
    scores = word_scores(model, rows, id_col, text)
    total = F.sum("score").over(Window.partitionBy(id_col))
    shares = scores.withColumn("score", F.when(total > 0, F.col("score") / total).otherwise(0.0))
    best_first = ranked(shares, [F.desc("score"), F.col("word")], id_col)
    return best_first.withColumn("in_top", F.col("rank") <= k)


def explanations(
    model: PipelineModel, df: DataFrame, id_col: str, text: str, classes: list[str], label: str = "label",
    n: int | None = None, k: int = 5, excerpt: int | None = None,
) -> DataFrame:
    """One row per explained text: the text or an excerpt, prediction, truth, top and all words."""
    names = F.array(*[F.lit(c) for c in classes])
    shown = df if n is None else df.orderBy(id_col).limit(n)
    rows = model.transform(shown).select(
        id_col,
        (F.col(text) if excerpt is None else F.substring(text, 1, excerpt)).alias("excerpt"),
        F.get(names, F.col("prediction").cast("int")).alias("predicted"),
        F.col(label).alias("actual"),
    )
    words = word_importance(model, df, id_col, text, n, k)
    lists = words.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("rank", "word", "score"))).alias("words")
    )
    told = rows.join(lists, id_col, "left")
    return told.select(
        "*",
        (F.col("predicted") == F.col("actual")).alias("correct"),
        F.slice("words", 1, k).alias("top_words"),
    )
