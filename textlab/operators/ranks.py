"""Exact, repeatable ranks by hash, and what rests on them: cut points and samples.

Rows are ordered by ``md5(seed:id)``, then by id. Splits, folds and samples only need to know
which side of a few ranks a row lies on. So the rows are never sorted or moved: the rows per
hash prefix are counted, the prefixes that hold the wanted ranks are found, the exact key is
looked up inside those prefixes, and every row is compared with the keys of its class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.functions.groups import join_on, keys, lookup_join, small_table

PREFIX = 4  # hex digits: 65 536 buckets of equal expected size per class


def hash_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))


def row_key(id_col: str, seed: int) -> Column:
    return F.struct(hash_key(id_col, seed).alias("h"), F.col(id_col).alias("id"))


def cut_keys(df: DataFrame, id_col: str, cuts: DataFrame, by=(), seed: int = 42) -> DataFrame:
    """Row key at each wanted rank: ``cuts(by, rank)`` gives ``(by, cuts: array<struct>)``.

    A rank of 0 or less gives a key before all rows, one beyond the class gives none.
    """
    by = keys(by)
    keyed = df.select(*by, F.col(id_col).alias("id"), hash_key(id_col, seed).alias("h"))
    keyed = keyed.withColumn("prefix", F.substring("h", 1, PREFIX))
    counts = keyed.groupBy(*by, "prefix").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy(*by).orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    spans = counts.withColumn("upto", F.sum("n").over(running))
    spans = spans.withColumn("below", F.col("upto") - F.col("n"))

    per_rank = small_table(cuts.groupBy(*by, "rank").agg(F.count(F.lit(1)).alias("times")))
    ranks = per_rank.groupBy(*by).agg(F.collect_list(F.struct("rank", "times")).alias("ranks"))
    spans = join_on(spans, ranks, by) if by else spans.withColumn("ranks", ranks.scalar())
    here = F.filter(
        "ranks", lambda r: (r["rank"] > F.col("below")) & (r["rank"] <= F.col("upto"))
    )
    wanted = spans.select(*by, "prefix", "below", F.explode(here).alias("r")).select(
        *by, "prefix", (F.col("r.rank") - F.col("below")).alias("at"), "r.times"
    )
    in_prefix = join_on(keyed, small_table(wanted), [*by, "prefix"])
    order = Window.partitionBy(*by, "prefix", "at").orderBy("h", "id")
    found = in_prefix.withColumn("pos", F.row_number().over(order)).filter("pos = at")
    found = found.select(*by, "h", "id", "times")
    first = per_rank.filter("rank <= 0").select(
        *by, F.lit("").alias("h"), F.lit(None).cast(df.schema[id_col].dataType).alias("id"), "times"
    )
    repeated = F.expr("array_repeat(struct(h, id), cast(times as int))")
    return (
        found.unionByName(first)
        .groupBy(*by)
        .agg(F.array_sort(F.flatten(F.collect_list(repeated))).alias("cuts"))
    )


def cuts_passed(
    df: DataFrame, id_col: str, cuts: DataFrame, by=(), seed: int = 42, name: str = "passed"
) -> DataFrame:
    """Number of wanted ranks that lie before each row (0 if it is among the first)."""
    by = keys(by)
    key = row_key(id_col, seed)
    table = cut_keys(df, id_col, cuts, by, seed)
    if by:
        marked = lookup_join(df, table, by, "left")
    else:
        marked = df.withColumn("cuts", table.select("cuts").scalar())
    passed = F.size(F.filter(F.coalesce("cuts", F.array()), lambda c: c < key))
    return marked.withColumn(name, passed).drop("cuts")


def hash_rank(df: DataFrame, id_col: str, by=(), seed: int = 42, name: str = "rank") -> DataFrame:
    """Exact rank of every row inside its class, for when the number itself is wanted.

    Two phases: the rank inside (class, hash prefix), plus the rows of the lower prefixes.
    """
    by = keys(by)
    keyed = df.withColumn("_h", hash_key(id_col, seed)).withColumn(
        "_prefix", F.substring("_h", 1, PREFIX)
    )
    counts = keyed.groupBy(*by, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*by).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *by, "_prefix", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_below")
    )
    inside = Window.partitionBy(*by, "_prefix").orderBy("_h", id_col)
    joined = join_on(keyed, offsets, [*by, "_prefix"])
    ranked = joined.withColumn(name, F.row_number().over(inside) + F.col("_below"))
    return ranked.select(*df.columns, name)


def sample_n(df: DataFrame, id_col: str, n: int = 500, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), the same ones in any layout of the table."""
    return df.orderBy(hash_key(id_col, seed), id_col).limit(n)


def ranked(df: DataFrame, order, by=(), name: str = "rank") -> DataFrame:
    """Number the rows of each group. Without groups it is for model- or class-level tables."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys(by)).orderBy(*order)))


def top_n(df: DataFrame, order, n: int, by=(), name: str = "rank") -> DataFrame:
    """First ``n`` rows per group. Every partition is pruned to ``n`` before the shuffle."""
    if not keys(by):
        df = df.orderBy(*order).limit(n)
    return ranked(df, order, by, name).filter(F.col(name) <= n)


def running_sum(
    df: DataFrame, column: str, by, order: str, width: int = 4096, name: str = "running"
) -> DataFrame:
    """Running total of ``column`` by a numeric ``order``, also for groups of any size.

    A group is cut into stretches of ``width`` order values, summed on their own; a stretch
    starts from the total of those before it. No task holds a whole group.
    """
    by = keys(by)
    cut = df.withColumn("_stretch", F.floor(F.col(order) / width))
    sums = cut.groupBy(*by, "_stretch").agg(F.sum(column).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "_stretch", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = (
        Window.partitionBy(*by, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = join_on(cut, starts, [*by, "_stretch"])
    return joined.withColumn(name, F.sum(column).over(inside) + F.col("_start")).select(*df.columns, name)


def exact_median(df: DataFrame, column: str, by=(), accuracy: int = 100_000) -> DataFrame:
    """Exact median of a numeric column per group without gathering the group's values.

    An approximate percentile with a guaranteed rank error brackets the median; only the
    distinct values inside the bracket, about ``8 / accuracy`` of the rows, are ranked.
    """
    by = keys(by)
    values = df.select(*by, F.col(column).alias("v")).filter(F.col("v").isNotNull())
    slack = 4.0 / accuracy
    bracket = F.percentile_approx("v", F.array(F.lit(0.5 - slack), F.lit(0.5 + slack)), accuracy)
    found = values.groupBy(*by).agg(
        bracket.alias("_b"), F.count(F.lit(1)).alias("_n"), F.min("v").alias("_lo"), F.max("v").alias("_hi")
    )
    # The bracket of a small group may miss the median's neighbour, so it is all of the group.
    tiny = F.col("_n") <= accuracy
    found = found.select(
        *by,
        "_n",
        F.when(tiny, F.col("_lo")).otherwise(F.col("_b")[0]).alias("_lo"),
        F.when(tiny, F.col("_hi")).otherwise(F.col("_b")[1]).alias("_hi"),
    )
    if by:
        marked = lookup_join(values, found, by)
    else:
        marked = values.withColumn("_f", found.select(F.struct("_n", "_lo", "_hi")).scalar())
        marked = marked.select("v", "_f.*")
    counts = marked.groupBy(
        *by, F.when(F.col("v").between(F.col("_lo"), F.col("_hi")), F.col("v")).alias("v"), "_n",
        (F.col("v") > F.col("_hi")).alias("_above"),
    ).agg(F.count(F.lit(1)).alias("c"))
    below = counts.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("v").isNull() & ~F.col("_above"), F.col("c"))), F.lit(0)).alias("_below")
    )
    inner = counts.filter("v is not null")
    inner = join_on(inner, below, by) if by else inner.withColumn("_below", below.scalar())
    upto = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inner.withColumn("_upto", F.sum("c").over(upto) + F.col("_below"))
    first, second = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    start = F.col("_upto") - F.col("c")
    return ranked.groupBy(*by).agg(
        (
            (
                F.max(F.when((start < first) & (first <= F.col("_upto")), F.col("v")))
                + F.max(F.when((start < second) & (second <= F.col("_upto")), F.col("v")))
            )
            / 2
        ).alias("median")
    )
