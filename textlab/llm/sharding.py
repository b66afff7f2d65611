"""Sharding along a Hilbert curve, so that every shard is narrow in several dimensions at once.

Each dimension is quantised at quantiles of the table, the cells are put on a Hilbert curve, and
the rows, in the order of the curve, are cut into runs of equal counts. Everything is built from
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.common import crc, fresh, partitions, quantile_bounds, rank_in_bounds, running_starts, stored, string_or_empty, total

#: Bits per dimension, so there are 2 ** (BITS * dimensions) cells.
BITS = 5
#: Parts of the curve for each shuffle partition.
PARTS_PER_PARTITION = 8
#: Bits of the hash that orders the rows of a cell.
TIE_BITS = 44


def as_string(column: Column) -> Column:
    """A string in the order of the values, with a null before all of them."""
    return F.when(column.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), column))


def string_bounds(df: DataFrame, value: Column, count: int) -> Column:
    """At most ``count`` sorted values that cut ``df`` in even parts, the largest one among them.

    The rows are counted by value, with the sums starting in each task, so a value that fills a
    third of the table is one row; the distinct values are put in order by a range sort, and their
    counts are summed up part by part. Values are compared whole, byte by byte.
    """
    counts = df.groupBy(value.alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    dealt = stored(counts, "values").repartitionByRange(partitions(df.sparkSession), "__value")
    dealt = stored(dealt.withColumn("__part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("__part").agg(F.sum("__n").alias("__rows"))
    starts = F.broadcast(running_starts(sizes, "__part", "__rows"))
    before = F.sum("__n").over(W.partitionBy("__part").orderBy("__value"))
    placed = dealt.withColumn("__own", before).join(starts, "__part")
    until = F.col("__start") + F.col("__own")
    # A value is a bound where a cut falls on its rows, so there are at most as many as cuts.
    cut = F.floor(until * count / F.col("__all")) > F.floor((until - F.col("__n")) * count / F.col("__all"))
    return placed.filter(cut).agg(F.sort_array(F.collect_list("__value")).alias("bounds")).scalar()


def hilbert_index(df: DataFrame, cells: list[str], name: str, bits: int = BITS) -> DataFrame:
    """``df`` with the place on the Hilbert curve of a cell of ``bits`` bits in each dimension.

    Each step is a projection of plain columns (Skilling's form), so nothing is evaluated twice.
    """
    n, columns = len(cells), df.columns
    x = [f"__x{i}" for i in range(n)]
    out = df.withColumns({x[i]: F.col(c).cast("long") for i, c in enumerate(cells)})
    for b in range(bits - 1, 0, -1):
        low = F.lit((1 << b) - 1)
        for i in range(n):
            own, first = F.col(x[i]), F.col(x[0])
            hit = own.bitwiseAND(F.lit(1 << b)) != 0
            swap = first.bitwiseXOR(own).bitwiseAND(low)
            step = {x[0]: F.when(hit, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))}
            if i:
                step[x[i]] = F.when(hit, own).otherwise(own.bitwiseXOR(swap))
            out = out.withColumns(step)
    for i in range(1, n):
        out = out.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    flips = F.lit(0).cast("long")
    for b in range(bits - 1, 0, -1):
        bit = F.shiftright(F.col(x[-1]), b).bitwiseAND(F.lit(1))
        flips = flips.bitwiseXOR(bit * ((1 << b) - 1))
    out = out.withColumn("__flips", flips)
    out = out.withColumns({c: F.col(c).bitwiseXOR(F.col("__flips")) for c in x})
    terms = [F.shiftright(F.col(c), b).bitwiseAND(F.lit(1)) * (1 << (b * n + n - 1 - i)) for i, c in enumerate(x) for b in range(bits)]
    return out.withColumn(name, total(terms)).select(*[c for c in columns if c != name], name)


def with_curve(df: DataFrame, dimensions: list[str], name: str, bits: int = BITS) -> DataFrame:
    """``df`` with the place of each row on the curve; a null counts as the lowest value.

    Numbers are cut at quantiles of the rows, strings at quantiles of the rows in the order of
    their whole values, so up to ``2**bits`` values of equal frequency have cells of their own.
    """
    cells, out, count = [], df, 2**bits - 1
    for i, dimension in enumerate(dimensions):
        bounds, cell = f"__bounds{i}", f"__cell{i}"
        if isinstance(df.schema[dimension].dataType, T.StringType):
            value = as_string(F.col(dimension))
            found = string_bounds(df, value, count + 1)
        else:
            value = F.coalesce(F.col(dimension).cast("double"), F.lit(float("-inf")))
            found = quantile_bounds(df, value, count)
        out = out.withColumn(bounds, found).withColumn(cell, rank_in_bounds(F.col(bounds), value, count + 1))
        out = out.withColumn(cell, F.least(F.col(cell), F.lit(count)))
        cells.append(cell)
    return hilbert_index(out, cells, name, bits).select(*df.columns, name)


def hilbert_shards(df: DataFrame, dimensions: list[str], id_col: str, shards: int = 16, bits: int = BITS) -> DataFrame:
    """``df`` with ``curve``, ``shard`` and ``slot``; the rows of two shards differ by one at most.

    Shards are runs of the curve, and ``slot`` counts the rows of a shard from 0 in the order of
    the curve. The rows of one cell, however many, are in the order of a hash of their id. Nulls
    in a dimension are its lowest value, null ids are hashed alike, and repeated rows stand side
    by side. Columns named like the results are replaced; an empty table gives no rows.

    The order is cut, at values that occur, into parts much smaller than a shard, which are
    numbered on their own; only the sizes of the parts are summed up in one place.
    """
    df = df.drop("curve", "shard", "slot")
    placed = with_curve(df, dimensions, "curve", bits)
    key, part, bound = (fresh(placed, x) for x in ("__key", "__part", "__bound"))
    tie = F.pmod(F.xxhash64(id_col), F.lit(1 << TIE_BITS))
    placed = stored(placed.withColumn(key, F.col("curve") * F.lit(1 << TIE_BITS) + tie), "curve")
    count = PARTS_PER_PARTITION * partitions(df.sparkSession)
    parts = placed.withColumn(bound, quantile_bounds(placed, F.col(key), count))
    parts = parts.withColumn(part, rank_in_bounds(F.col(bound), F.col(key), count + 1)).drop(bound)
    sizes = parts.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    starts = running_starts(sizes, part, "__n").withColumnRenamed("__all", "__rows")
    number = F.row_number().over(W.partitionBy(part).orderBy(key, id_col))
    rank = F.col("__start") + F.col("__at") - 1
    shard = F.floor(((rank + 1) * shards - 1) / F.col("__rows")).cast("int")
    return (
        parts.withColumn("__at", number)
        .join(F.broadcast(starts), part)
        .withColumn("shard", shard)
        .withColumn("slot", rank - F.floor(F.col("shard") * F.col("__rows") / shards))
        .select(*df.columns, "curve", "shard", "slot")
    )


def document_shards(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text: str = "text", dimensions=("source", "lang")) -> DataFrame:
    """Sizes and checksums of documents with their shards along source, language and size."""
    rows = df.select(
        F.col(id_col).alias(id_col),
        *[F.col(d).alias(d) for d in dimensions],
        (F.octet_length(string_or_empty(F.col(text))) + 1).cast("long").alias("size"),
        crc(F.col(text)).alias("text_crc32"),
    )
    return hilbert_shards(rows, [*dimensions, "size"], id_col, shards)


def write_shards(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write rows that have a shard as ``shard=<n>`` folders of files that are runs of the curve.

    Each file then covers a small range of every dimension, which readers use to skip it. The
    range partitioning keeps files as even as the shuffle partitions.
    """
    dealt = df.repartitionByRange(partitions(df.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)
