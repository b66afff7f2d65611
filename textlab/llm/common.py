"""Column expressions and small DataFrame helpers that several operators of this folder share."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlab.session import work_path

# The characters that separate words, as a set and as a pattern for split.
SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"


def string_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, null and empty texts having none."""
    clean = F.btrim(string_or_empty(text), F.lit(SPACES))
    none = F.array().cast("array<string>")
    return F.when(clean == "", none).otherwise(F.split(clean, GAP))


def word_count(text: Column) -> Column:
    """Number of words, without making an array of them."""
    return F.regexp_count(string_or_empty(text), F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def crc(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes."""
    return F.crc32(F.encode(string_or_empty(text), "UTF-8"))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"{stem}_{uuid.uuid4().hex[:6]}"
    return stem


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that later jobs survive lost executors."""
    path = work_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rank_in_bounds(bounds: Column, value: Column, size: int) -> Column:
    """How many of the sorted ``bounds`` (at most ``size``) are below ``value``, by bisection."""
    steps = [1 << b for b in range(max(1, size).bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= F.size(bounds)) & (F.get(bounds, at + step - 1) < value), at + step
        ).otherwise(at),
    )


def quantile_bounds(df: DataFrame, key: Column, count: int) -> Column:
    """About ``count`` distinct, sorted values of ``key`` that cut ``df`` in even parts.

    All are values that occur, the largest one among them. They come as a scalar subquery of
    ``count`` numbers, so nothing passes through the driver program.
    """
    shares = [(i + 1) / count for i in range(count)]
    found = F.percentile_approx(key, shares, max(10_000, 20 * count))
    top = F.array(F.max(key))
    one = df.agg(F.sort_array(F.array_distinct(F.concat(F.coalesce(found, F.array()), top))).alias("bounds"))
    return one.scalar()


def running_starts(sizes: DataFrame, part: str, rows: str) -> DataFrame:
    """``part``, ``__start`` (rows of the parts before it) and ``__all`` (rows of all parts).

    ``sizes`` has one row per part of a table, a small multiple of the shuffle partitions, and
    nothing else of the table passes through the one task that sums them up.
    """
    every = W.partitionBy()
    until = every.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    return sizes.select(
        part,
        F.coalesce(F.sum(rows).over(until), F.lit(0)).alias("__start"),
        F.sum(rows).over(every).alias("__all"),
    )


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the number of each row in the given order, from 0.

    A range sort deals out the rows, each part is numbered on its own, and the parts' sizes (one
    row per part) shift the numbers; no task sees all rows. The sorted rows are stored first, as
    a range sort that runs twice may cut elsewhere.
    """
    spark = df.sparkSession
    at = fresh(df, "__at")
    # Stored, as a range sort reads its input twice, once to find the cuts.
    read = stored(df, "unranked")
    dealt = read.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    kept = stored(dealt.withColumn(at, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(F.col(at), 33)
    sizes = kept.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    start = F.broadcast(running_starts(sizes, "__part", "__rows"))
    low = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return (
        kept.join(start, part == F.col("__part"))
        .withColumn(name, F.col("__start") + low)
        .drop("__part", "__start", "__all", at)
    )


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
