"""Document fingerprints: bottom-k sketches of the hashes of word shingles.

A sketch is the sorted list of the ``k`` smallest distinct hashes. It is a function of the set of
shingles alone, so sketches of parts merge to the sketch of the whole, and two sketches estimate
resemblance, containment and the number of distinct shingles. Everything is built from DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textlab.llm.common import fresh, partitions, quantile_bounds, rank_in_bounds, string_or_empty, words

SHINGLE = 5
#: Hashes per sketch; the standard error of a resemblance J is sqrt(J (1 - J) / K).
K = 256
#: Parts of the order by id for each shuffle partition, so that the partitions come out even.
PARTS_PER_PARTITION = 8


def sketch(hashes: Column, k: int = K) -> Column:
    """The ``k`` smallest distinct values."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, width: int = SHINGLE) -> DataFrame:
    """``df`` with the sketch of a text column. The steps are columns, so each runs once."""
    w, h, s = (fresh(df, f"__{x}_{name}") for x in "whs")
    none = F.array().cast("array<bigint>")
    runs = F.transform(
        F.sequence(F.lit(0), F.size(h) - width),
        lambda i: F.xxhash64(*[F.get(F.col(h), i + j) for j in range(width)]),
    )
    short = F.array(F.xxhash64(F.array_join(w, " ")))
    return (
        df.withColumn(w, words(F.col(text)))
        .withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
        .withColumn(s, F.when(F.size(h) >= width, runs).when(F.size(h) > 0, short).otherwise(none))
        .withColumn(name, sketch(F.col(s), k))
        .drop(w, h, s)
    )


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_by(df: DataFrame, by: list[str], name: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each group of parts.

    Equal hashes of a group are counted once before any shuffle, then each task keeps its ``k``
    smallest ones of a group, so a group of any size meets as ``k`` numbers per task. Groups of
    empty sketches only are given an empty one; a null key is a group too.
    """
    each = df.select(*by, F.explode_outer(name).alias("__h")).distinct()
    order = W.partitionBy(*by).orderBy(F.col("__h").asc_nulls_last())
    least = each.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= k)
    return least.groupBy(*by).agg(F.sort_array(F.collect_list("__h")).alias(name))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sets, exact below ``k`` hashes; 1 for two empty ones."""
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles, exact below ``k``."""
    spread = (F.get(a, F.lit(k - 1)).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / spread)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set that is in the second; 1 if the first is empty."""
    inside = resemblance(a, b, k) * distinct_count(merged(a, b, k), k) / distinct_count(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(inside, F.lit(1.0)))


def as_string(a: Column) -> Column:
    return F.concat_ws(",", a.cast("array<string>"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, width: int = SHINGLE) -> DataFrame:
    """``df`` with ``sketch``, ``fingerprint`` (the sketch as a string) and ``n_shingles``.

    Null and empty texts have an empty sketch. Equal texts have equal fingerprints; repeated rows
    stay. All columns stay, but those named like the three results are replaced.
    """
    return with_sketch(df, text, "sketch", k, width).withColumns(
        {"fingerprint": as_string(F.col("sketch")), "n_shingles": distinct_count(F.col("sketch"), k)}
    )


def with_next(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``df`` with ``next_<column>``: the value in the row with the next smaller id.

    After the smallest id comes the largest; null ids count as smaller than all others, equal ids
    are in the order of their columns. The ids are cut at values that occur into even parts. The
    row at each cut goes to both parts, so every row meets its next one inside one part, and the
    table is shuffled once. With a single row, it is its own next.
    """
    count = PARTS_PER_PARTITION * partitions(df.sparkSession)
    key, part, guest, bound = (fresh(df, x) for x in ("__key", "__part", "__guest", "__bound"))
    keyed = df.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))))
    bounds = quantile_bounds(keyed, F.col(key), count)
    # Each part holds the ids above the bound before it, up to its own.
    ranked = keyed.withColumn(bound, bounds).withColumn(part, rank_in_bounds(F.col(bound), F.col(key), count + 1))
    at_top = F.get(F.col(bound), F.col(part)) == F.col(key)
    other = F.pmod(F.col(part) + 1, F.size(bound))
    places = F.when(
        at_top, F.array(F.struct(F.col(part).alias("p"), F.lit(False).alias("g")), F.struct(other.alias("p"), F.lit(True).alias("g")))
    ).otherwise(F.array(F.struct(F.col(part).alias("p"), F.lit(False).alias("g"))))
    dealt = ranked.select(*df.columns, key, F.explode(places).alias(guest))
    dealt = dealt.select(*df.columns, key, F.col(guest)["p"].alias(part), F.col(guest)["g"].alias(guest))
    order = W.partitionBy(part).orderBy(guest, F.col(key).desc(), *[F.col(c) for c in columns])
    return (
        dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns} | {key: F.lead(key).over(order)})
        .filter(~F.col(guest))
        .drop(key, part, guest)
    )


def edited_next(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, width: int = SHINGLE) -> DataFrame:
    """Likeness of each text to an edited form of it and to the next document's text.

    The edited text has its last third replaced by the first as many code points of the next
    document. Null texts count as empty.
    """
    rows = df.select(F.col(id_col).alias(id_col), string_or_empty(F.col(text)).alias("text"))
    met = with_next(rows, id_col, ["text"]).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    met = met.withColumn(
        "edited",
        F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("next_text"), F.lit(1), cut)),
    )
    made = with_sketch(met, "text", "a", k, width)
    made = with_sketch(made, "edited", "b", k, width)
    made = with_sketch(made, "next_text", "c", k, width)
    return made.select(
        id_col,
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_string(F.col("a")).alias("fingerprint"),
        as_string(F.col("b")).alias("edited_fingerprint"),
        resemblance(F.col("a"), F.col("b"), k).alias("near_edited"),
        resemblance(F.col("a"), F.col("c"), k).alias("near_next"),
    )
