"""The class dictionary: class names and their numbers in order, whatever the number of classes.

The dictionary is built in two phases. The distinct names are dealt out by ranges and numbered
inside each range; the sizes of the ranges, one row each, shift these numbers. Sets of labels are
kept sparse, as the sorted numbers of the labels that a row has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.functions.groups import collected, lookup_join
from textlab.functions.labels import label_rows, parse_labels
from textlab.session import written

#: Up to this many names are a constant of the plan; more are joined.
FEW_CLASSES = 256


def numbered_in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the number of each row in the given order, from 0, as a written table.

    Rows that tie are numbered in any order. No task sees more than a range of the rows; the one
    window without groups is over the ranges.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df, "unordered").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    sizes = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    placed = kept.join(F.broadcast(starts), part == F.col("_part"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.select(*df.columns, (F.col("_start") + inside).alias(name))


def class_dictionary(names: DataFrame, label: str = "label") -> DataFrame:
    """``(label, class_id)`` by sorted label, from a column that may repeat and lack them."""
    distinct = names.select(F.col(label).cast("string").alias("label")).dropna().distinct()
    found = numbered_in_order(distinct, [F.col("label")], "class_id")
    return found.select("label", F.col("class_id").cast("int").alias("class_id"))


def few_names(classes: DataFrame, limit: int = FEW_CLASSES) -> list[str] | None:
    """The names in order of their numbers if there are at most ``limit``, else None."""
    table = collected(classes.select("class_id", "label"), limit)
    return None if table is None else table.sort_by("class_id")["label"].to_pylist()


def looked_up(df: DataFrame, items: Column, table: DataFrame, key: str, value: str, name: str, how: str) -> DataFrame:
    """``df`` with the list of ``value`` of each item of a list, joined with ``table`` on ``key``.

    Items keep their order; with ``how`` "left" those that the table lacks are null, with "inner"
    they are left out. A null list stays null. The rows are written once, so that the number that
    brings the items of a row together again is the same in every read.
    """
    kind = df.select(items.alias("i")).schema["i"].dataType.elementType
    rows = written(df.withColumn("_items", items).withColumn("_row", F.monotonically_increasing_id()), "rows")
    long = rows.select("_row", F.posexplode("_items").alias("_pos", "_key"))
    pairs = table.select(F.col(key).cast(kind).alias("_key"), F.col(value).alias("_value"))
    found = lookup_join(long.filter("_key is not null"), pairs, "_key", how)
    if how == "left":
        found = found.unionByName(long.filter("_key is null").withColumn("_value", F.lit(None).cast(pairs.schema["_value"].dataType)))
    lists = found.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_pos", "_value"))).alias("_list"))
    none = F.when(F.col("_items").isNotNull(), F.array().cast(f"array<{pairs.schema['_value'].dataType.simpleString()}>"))
    told = F.coalesce(F.transform("_list", lambda x: x["_value"]), none)
    return rows.join(lists, "_row", "left").select(*df.columns, told.alias(name))


def decode_id_lists(df: DataFrame, classes: DataFrame, ids: str = "class_ids", name: str = "decoded") -> DataFrame:
    """Class names of a list of class ids, null for an id that no class has."""
    names = few_names(classes)
    if names is None:
        return looked_up(df, F.col(ids), classes, "class_id", "label", name, "left")
    known = F.lit(names) if names else F.array().cast("array<string>")
    return df.withColumn(name, F.transform(F.col(ids), lambda i: F.when(i >= 0, F.get(known, i.cast("int")))))


def label_sets(df: DataFrame, label: str, classes: DataFrame, name: str = "label_ids") -> DataFrame:
    """``df`` with the sorted class ids of the labels of each row; labels without a class are left
    out, a row without labels has none."""
    mine = F.coalesce(F.array_distinct(parse_labels(df, label)), F.array().cast("array<string>"))
    names = few_names(classes)
    if names is None:
        found = looked_up(df, mine, classes, "label", "class_id", name, "inner")
        return found.withColumn(name, F.array_sort(name))
    known = F.lit(names) if names else F.array().cast("array<string>")
    at = F.transform(mine, lambda x: F.array_position(known, x).cast("int") - 1)
    return df.withColumn(name, F.array_sort(F.filter(at, lambda i: i >= 0)))


def atomic_classes(df: DataFrame, label: str) -> DataFrame:
    """``(label, class_id)`` of the single labels of a multi-label column."""
    return class_dictionary(label_rows(df, label, multi_label=True))


def hot_vector(ids: Column, size: int) -> Column:
    """The 0/1 vector of a set of class ids among ``size`` classes."""
    if not size:
        return F.array().cast("array<float>")
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains(ids, i).cast("float"))
