"""Mixing sources to target weights by Pareto order sampling.

A source that is to give 1.3 times its words gives every document once and a sample of the rest.
The sample has unequal probabilities: documents are ranked by their random odds divided by the
odds of their inclusion probability, and the first ones that fill the rest are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlab.functions.groups import join_on
from textlab.llm.common import ranked, stored, word_count

#: Fixed values of the mix: weights of the sources in order, words in all as a share of all words,
#: and the most copies of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SEED = 17
#: A document of this many words has half the preference of a very long one.
HALF_PREFERENCE = 100
#: The place in the order is found digit by digit, LEVELS of them with BITS bits each.
BITS, LEVELS = 8, 3


def preference(size: Column) -> Column:
    """How much a document is preferred over others of its source: short ones less."""
    return size / (size + HALF_PREFERENCE)


def water_level(sources: DataFrame, budget: float) -> float:
    """Words per unit of weight, once the excess of capped sources is shared among the others."""
    capped, free, level = 0.0, None, None
    while True:
        over = F.lit(False) if level is None else F.col("weight") * level > MOST * F.col("source_size")
        row = sources.agg(
            F.sum(F.when(over, MOST * F.col("source_size"))).alias("capped"),
            F.sum(F.when(~over, F.col("weight"))).alias("free"),
            F.count_if(over).alias("n"),
        ).first()
        if row["free"] is None:
            return level or 0.0
        if free is not None and row["n"] == capped:
            return level
        capped, free = row["n"], row["free"]
        level = (budget - (row["capped"] or 0)) / free


def source_targets(sizes: DataFrame, share: float = SHARE, weights=WEIGHTS) -> DataFrame:
    """``source``, ``source_size``, ``preferred`` and ``target`` from a table of sizes by source.

    Sources are in the order of their code points, null last, and take the weights in turn.
    """
    found = ranked(sizes, [F.col("source").asc_nulls_last()], "at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    found = stored(found.withColumn("weight", weight), "weights")
    budget = share * (found.agg(F.sum("source_size").alias("n")).first()["n"] or 0)
    level = water_level(found, budget)
    target = F.least(F.col("weight") * level, (MOST * F.col("source_size")).cast("double"))
    return found.select("source", "source_size", "preferred", target.alias("target"))


def order_value(id_column: Column, size: Column, seed: int = SEED) -> Column:
    """Place of a document in the order of its source, 0 to 1, from the columns of its target.

    With uniform u and inclusion probability p the order is that of (u / (1 - u)) / (p / (1 - p)),
    here as x / (1 + x). The probabilities are in proportion to the preference and fill the rest
    of the target in the mean.
    """
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_column), 11) + F.lit(0.5)) / F.lit(2.0**53)
    p = F.least(F.col("rest") * preference(size) / F.col("preferred"), F.lit(1.0))
    x = u / (1 - u) * (1 - p) / p
    return F.when(p >= 1, F.lit(0.0)).when(p > 0, x / (1 + x)).otherwise(F.lit(1.0))


def mix_plan(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, share: float = SHARE, weights=WEIGHTS) -> DataFrame:
    """One row per source: ``target``, the ``copies`` of each document, and up to which place and
    id its documents are taken once more.

    The cut is found digit by digit from sums over the digits, so a source of any size meets as
    at most 2 ** BITS rows, and only documents that agree in all digits are put in order.
    """
    size = word_count(F.col(text))
    rows = df.select(F.col(source).cast("string").alias("source"), F.col(id_col).alias("id"), size.alias("size"))
    rows = stored(rows, "sizes")
    # Summed as whole numbers, so that the order of the sum doesn't matter.
    share_of = F.floor(1024 * F.col("size") * F.coalesce(preference(F.col("size")), F.lit(0.0)))
    preferred = F.sum(share_of) / 1024
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), preferred.alias("preferred"))
    plan = source_targets(sizes, share, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0)
    plan = plan.withColumn("copies", F.least(whole, F.lit(MOST)).cast("int"))
    plan = plan.withColumn("rest", F.greatest(F.col("target") - F.col("copies") * F.col("source_size"), F.lit(0.0)))
    plan = stored(plan, "plan")

    scale = 1 << (BITS * LEVELS)
    placed = join_on(rows.filter(F.col("size") > 0), plan.select("source", "rest", "preferred"), "source")
    placed = placed.withColumn("value", order_value(F.col("id"), F.col("size"), seed))
    placed = placed.withColumn("digits", F.least(F.floor(F.col("value") * scale), F.lit(scale - 1)))
    placed = stored(placed.select("source", "id", "size", "value", "digits"), "placed")
    cut = plan.select("source", F.lit(0).cast("long").alias("prefix"), F.col("rest").alias("left"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = join_on(placed, cut, "source").filter(F.shiftright(F.col("digits"), shift + BITS) == F.col("prefix"))
        sums = inside.groupBy("source", "left", F.shiftright(F.col("digits"), shift).alias("prefix")).agg(F.sum("size").alias("n"))
        until = F.sum("n").over(W.partitionBy("source").orderBy("prefix"))
        crossed = sums.withColumn("until", until).filter((F.col("until") > F.col("left")) & (F.col("until") - F.col("n") <= F.col("left")))
        found = crossed.select("source", "prefix", (F.col("left") - F.col("until") + F.col("n")).alias("left"))
        # A source whose rest takes in all there is has no cut.
        cut = stored(found, "cut")
    last = join_on(placed, cut, "source").filter(F.col("digits") == F.col("prefix"))
    order = W.partitionBy("source").orderBy("value", "id")
    before = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    taken = last.withColumn("before", before).filter(F.col("before") + F.col("size") / 2 <= F.col("left"))
    ends = taken.groupBy("source").agg(F.max(F.struct("value", "id")).alias("end"))
    ends = join_on(cut.select("source", (F.col("prefix") / scale).alias("floor")), ends, "source", "left")
    return join_on(plan, ends, "source", "left")


def with_copies(df: DataFrame, plan: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    Null and empty texts have no words and are taken 0 times. Repeated rows share one place in
    the order. Null sources are a source of their own. Columns named like the results are
    replaced; no document is taken more than MOST times.
    """
    results = ["size", "source_size", "target", "copies", "taken"]
    df = df.drop(*results)
    renamed = plan.select(*[F.col(c).alias("__" + c) for c in plan.columns])
    sized = df.withColumn("size", word_count(F.col(text)))
    joined = sized.join(renamed, sized[source].cast("string").eqNullSafe(F.col("__source")), "left")
    joined = joined.withColumns({"rest": F.col("__rest"), "preferred": F.col("__preferred")})
    joined = joined.withColumn("__value", order_value(F.col(id_col), F.col("size"), seed))
    below = F.col("__value") < F.col("__floor")
    inside = (F.col("__value") < F.col("__end.value")) | ((F.col("__value") == F.col("__end.value")) & (F.col(id_col) <= F.col("__end.id")))
    # Without a cut the rest takes in every document, or there is no rest.
    more = F.when(F.col("__floor").isNull(), F.col("__rest") > 0).otherwise(below | F.coalesce(inside, F.lit(False)))
    copies = F.when(F.col("size") > 0, F.col("__copies") + more.cast("int")).otherwise(0)
    copies = F.least(copies, F.lit(MOST)).cast("int")
    return joined.withColumn("copies", copies).select(
        *df.columns, "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"),
    )


def mixture(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """The mixed table itself: every row as often as it is taken, with its own columns only."""
    counted = with_copies(df.select(F.struct(*df.columns).alias("row"), F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source")), mix_plan(df, id_col, text, source, seed), seed=seed)
    return counted.filter(F.col("copies") > 0).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def document_mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How many words of each document the mix takes."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
    plan = stored(mix_plan(rows), "mix")
    return with_copies(rows, plan).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
