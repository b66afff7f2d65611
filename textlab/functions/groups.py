"""Helpers for the ``by`` argument (one result per group) and for small lookup tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A lookup table up to this many rows and bytes may be broadcast.
BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 8 << 20
# Join keys that the rows of one value are dealt out over.
SALTS = 16


def keys(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or ())


def join_on(left: DataFrame, right: DataFrame, names, how: str = "inner") -> DataFrame:
    """Equi-join on equally named keys that also pairs null with null."""
    names = keys(names)
    other = right.select(
        *[F.col(n).alias("_r_" + n) for n in names], *[c for c in right.columns if c not in names]
    )
    matched = reduce(
        lambda a, b: a & b, [left[n].eqNullSafe(other["_r_" + n]) for n in names]
    )
    return left.join(other, matched, how).drop(*["_r_" + n for n in names])


def with_totals(detail: DataFrame, by, **totals: Column) -> DataFrame:
    """Add per-group aggregates of ``detail`` to each of its rows.

    ``detail`` is an aggregate itself, so its exchange is reused and the source is read once:
    through a scalar subquery without groups, through a join with them. Neither is a window
    over one partition.
    """
    by = keys(by)
    summary = detail.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()])
    if by:
        return join_on(detail, summary, by)
    one = summary.select(F.struct(*totals)).scalar()
    added = detail.withColumn("_totals", one)
    return added.select(*detail.columns, *[F.col("_totals")[n].alias(n) for n in totals])


def salted_join(rows: DataFrame, table: DataFrame, names, how: str = "inner") -> DataFrame:
    """Equi-join, null with null, that deals the rows of one key out over SALTS partitions.

    ``table`` has a row per key and is repeated for every salt, so its size counts SALTS times
    and a key with a third of all ``rows`` is SALTS tasks' work. Adaptive execution doesn't split
    such a key by itself where the table is an aggregate. The salt of a row is a hash of its
    columns, which is the same when a task is repeated; columns that hold maps have no hash.
    """
    names = keys(names)
    hashed = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    salt = F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int") if hashed else F.lit(0)
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return join_on(rows.withColumn("_salt", salt), copies, [*names, "_salt"], how).drop("_salt")


def lookup_join(rows: DataFrame, table: DataFrame, names, how: str = "inner", limit: int | None = None) -> DataFrame:
    """``salted_join``, or a broadcast join where the table is known to be small.

    At most ``limit + 1`` rows of it are read to find out.
    """
    small = _local(table, BROADCAST_ROWS if limit is None else limit)
    if small is None:
        return salted_join(rows, table, names, how)
    return join_on(rows, F.broadcast(small), names, how)


def collected(df: DataFrame, limit: int = BROADCAST_ROWS):
    """``df`` as an Arrow table if it has at most ``limit`` rows and BROADCAST_BYTES bytes, else None.

    At most ``limit + 1`` rows are read to find out.
    """
    table = df.limit(limit + 1).toArrow()
    return None if table.num_rows > limit or table.nbytes > BROADCAST_BYTES else table


def _local(df: DataFrame, limit: int) -> DataFrame | None:
    """``df`` as a table of the plan if it is small."""
    table = collected(df, limit)
    return None if table is None else df.sparkSession.createDataFrame(table, df.schema)


def small_table(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` as a broadcast table if it has at most ``limit`` rows and BROADCAST_BYTES bytes.

    The check reads at most ``limit + 1`` rows. A larger table stays a distributed one; where the
    other side may have a hot key, ``lookup_join`` is the join to use.
    """
    found = _local(df, limit)
    return df if found is None else F.broadcast(found)
