"""Quality rules by distribution divergence.

Histograms of character classes and of common words are compared, by the Jensen-Shannon
distance, with references of each language that are summed over all documents. Everything is
built from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import SPACES, stored, string_or_empty, words

# Fixed values of the base rules: symbols, window length, least words, most repeated words in %.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30

#: Patterns of runs of the character classes; what none of them takes is the class ``other``.
CLASSES = {
    "lower": r"\p{Ll}++",
    "upper": r"\p{Lu}++",
    "space": r"[\x20\x09-\x0D]++",
    "digit": r"\p{Nd}++",
    "stop": r"[.,;:!?'\"()-]++",
}
#: A common word has at least so large a share of all words of its language, so there are 500 at
#: most. It is found by its hash in a table of SLOTS entries, behind which follow those whose slot
#: is taken by a more frequent word. The words that are not common are one more class.
COMMON_SHARE, SLOTS = 0.002, 1024
MOST_LANGUAGES = 512
#: A document is judged on characters or words only if it has as many of them at least.
LEAST_CHARACTERS, LEAST_FOR_WORDS = 200, 100
#: Largest distances (0 to 1) from the nearest language that a kept document may have.
MOST_CHARACTER_DISTANCE, MOST_WORD_DISTANCE = 0.25, 0.40


def base_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the counts of the base rules and their verdict, and the character classes."""
    df = with_classes(df, text).withColumn("__words", words(F.col(text)))
    value = string_or_empty(F.col(text))
    hashed = F.transform("__words", lambda w: F.xxhash64(w))
    df = df.withColumn("__hashed", hashed)
    windows = F.transform(
        F.sequence(F.lit(0), F.size("__hashed") - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("__hashed"), i + j) for j in range(WINDOW)]),
    )
    none = F.array().cast("array<bigint>")
    df = df.withColumn("__windows", F.when(F.size("__words") >= WINDOW, windows).otherwise(none))
    # Only texts in which a window recurs are looked at closer.
    df = df.withColumn(
        "__placed",
        F.when(
            F.size(F.array_distinct("__windows")) < F.size("__windows"),
            F.sort_array(F.arrays_zip(F.col("__windows").alias("h"), F.sequence(F.lit(0), F.size("__windows") - 1).alias("i"))),
        ),
    )
    placed = F.col("__placed")
    recurring = F.transform(
        F.filter(
            placed, lambda x, i: (F.get(placed, i - 1)["h"] == x["h"]) | (F.get(placed, i + 1)["h"] == x["h"])
        ),
        lambda x: x["i"],
    )
    covered = F.aggregate(
        F.sort_array(recurring),
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, s: F.struct((a["n"] + F.least(F.lit(WINDOW), s - a["last"])).alias("n"), s.alias("last")),
    )["n"]
    lines = F.filter(F.split(value, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    df = df.withColumn("__lines", lines)
    # No class has a symbol, and one class is white space.
    symbols = F.regexp_count("__others", F.lit("[" + SYMBOLS + "]"))
    spaces = F.get("__chars", F.lit(list(CLASSES).index("space")))
    df = df.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.char_length(value) - spaces.cast("long"),
            "n_symbols": symbols.cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.when(placed.isNull(), F.lit(0)).otherwise(covered).cast("long"),
        }
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def with_classes(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``__chars``, the counts of the character classes of a text in the order of CLASSES,
    then of the others, and ``__others``, the others themselves.

    Each class is taken out of what the one before it has left, one column after the other, so
    that the whole text is gone through once.
    """
    left = [f"__left{i}" for i in range(len(CLASSES))] + ["__others"]
    df = df.withColumn(left[0], string_or_empty(F.col(text)))
    for before, after, pattern in zip(left, left[1:], CLASSES.values()):
        df = df.withColumn(after, F.regexp_replace(before, pattern, ""))
    lengths = [F.char_length(c) for c in left]
    taken = [a - b for a, b in zip(lengths, lengths[1:])]
    return df.withColumn("__chars", F.array(*taken, lengths[-1]).cast("array<double>")).drop(*left[:-1])


def plain_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def divergence(p: Column, q: Column) -> Column:
    """What one class with shares ``p`` and ``q`` adds to twice the Jensen-Shannon divergence."""
    middle = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / middle)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / middle)).otherwise(0.0)


def as_distance(twice: Column) -> Column:
    return F.sqrt(F.least(F.greatest(twice / 2, F.lit(0.0)), F.lit(1.0)))


def language_references(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per language, and one with a null language that sums over all documents.

    ``ref_chars`` has the shares of the character classes. ``ref_words`` has the hashes and shares
    of the common words: one in each of SLOTS entries, found by the hash, or null, then those whose
    slot is taken, the hashes of which ``ref_extra`` lists. ``ref_common`` is the share of all of
    them. A word is common if it makes up COMMON_SHARE of the words of the language. The counts
    cover all documents.
    """
    rows = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    places = range(len(CLASSES) + 1)
    sums = (
        with_classes(rows)
        .select("lang", *[F.get("__chars", F.lit(i)).alias(f"c{i}") for i in places])
        .groupBy("lang")
        .agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in places])
    )
    found = rows.select("lang", F.explode(words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    sums, found = stored(sums, "sums"), stored(found, "words")

    def both(table: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
        kept = [F.sum(c).alias(c) for c in columns]
        own = table.filter(F.col("lang").isNotNull()).groupBy("lang", *keys).agg(*kept)
        pooled = table.groupBy(*keys).agg(*kept).select(F.lit(None).cast("string").alias("lang"), *keys, *columns)
        return own.unionByName(pooled)

    sums = both(sums, [], [f"c{i}" for i in places])
    many = both(found, [], ["n"]).select(F.col("lang").alias("_lang"), F.col("n").alias("_all"))
    hashed = F.xxhash64("word")
    common = (
        both(found, ["word"], ["n"])
        .join(F.broadcast(bounded(many)), F.col("lang").eqNullSafe(F.col("_lang")))
        .filter(F.col("n") >= COMMON_SHARE * F.col("_all"))
        .select("lang", F.struct(F.pmod(hashed, F.lit(SLOTS)).cast("int").alias("slot"), (-F.col("n")).alias("n"), hashed.alias("hash"), (F.col("n") / F.col("_all")).alias("share")).alias("entry"))
    )
    # At most 500 for each language, the most frequent one of a slot first.
    tables = common.groupBy(F.col("lang").alias("_lang")).agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    listed = F.col("entries")
    behind = lambda i: F.coalesce(F.get(listed, i - 1)["slot"] == F.get(listed, i)["slot"], F.lit(False))
    tables = tables.select(
        "_lang",
        F.map_from_entries(F.transform(F.filter(listed, lambda e, i: ~behind(i)), lambda e: F.struct(e["slot"], e))).alias("slots"),
        F.transform(F.filter(listed, lambda e, i: behind(i)), lambda e: F.struct(e["hash"].alias("hash"), e["share"].alias("share"))).alias("extra"),
    )
    slots = F.transform(
        F.sequence(F.lit(0), F.lit(SLOTS - 1)),
        lambda i: F.struct(F.try_element_at("slots", i)["hash"].alias("hash"), F.try_element_at("slots", i)["share"].alias("share")),
    )
    none = F.array().cast("array<struct<hash:bigint,share:double>>")
    characters = F.array(*[F.col(f"c{i}") for i in places])
    entries = F.concat(slots, F.coalesce("extra", none))
    return sums.join(tables, F.col("lang").eqNullSafe(F.col("_lang")), "left").select(
        "lang",
        F.transform(characters, lambda c: c / F.nullif(plain_sum(characters), F.lit(0.0))).alias("ref_chars"),
        entries.alias("ref_words"),
        F.transform(F.coalesce("extra", none), lambda e: e["hash"]).alias("ref_extra"),
        F.aggregate(entries, F.lit(0.0), lambda a, e: a + F.coalesce(e["share"], F.lit(0.0))).alias("ref_common"),
    )


def bounded(references: DataFrame) -> DataFrame:
    """The table itself, once it is known to have at most MOST_LANGUAGES rows."""
    if references.limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: a column of languages is asked for")
    return references


def divergence_columns(df: DataFrame, references: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``df`` with ``char_distance`` and ``word_distance`` from the reference of its language.

    Documents without a language, or with one that has no reference, are held against all
    documents. A distance is null where a text is too short to be judged.
    """
    references = references.select(*[F.col(c).alias("__" + c) for c in references.columns])
    known = references.filter(F.col("__lang").isNotNull())
    parts = F.struct(*[c for c in references.columns if c != "__lang"])
    pooled = references.filter(F.col("__lang").isNull()).select(parts).scalar()
    df = df.join(F.broadcast(known), F.col(lang).cast("string") == F.col("__lang"), "left")
    df = df.withColumn("__ref", F.coalesce(F.when(F.col("__lang").isNotNull(), parts), pooled))
    table, shares, extra = F.col("__ref.__ref_words"), F.col("__ref.__ref_chars"), F.col("__ref.__ref_extra")
    n_chars, n_words = plain_sum(F.col("__chars")), F.size("__hashed")
    by_class = F.zip_with(F.col("__chars"), shares, lambda c, q: divergence(c / n_chars, q))
    # The places of the common words of the document in the table, equal ones side by side.
    def place(h: Column) -> Column:
        slot = F.pmod(h, F.lit(SLOTS)).cast("int")
        taken = F.get(table, slot)["hash"]
        behind = F.nullif(F.array_position(extra, h).cast("int"), F.lit(0)) + (SLOTS - 1)
        return F.when(taken == h, slot).when(taken.isNotNull() & (F.size(extra) > 0), behind)

    slots = F.filter(F.transform("__hashed", place), lambda s: s.isNotNull())
    df = df.withColumn("__slots", F.when(n_words >= LEAST_FOR_WORDS, F.sort_array(slots)))
    listed = F.col("__slots")
    ends = F.filter(
        F.sequence(F.lit(1), F.size(listed)),
        lambda i: (i == F.size(listed)) | (F.get(listed, i - 1) != F.get(listed, i)),
    )
    df = df.withColumn("__ends", F.when(F.size(listed) > 0, ends).otherwise(F.array().cast("array<int>")))
    # Words outside the document add their whole share, so only its own words are gone through.
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("share"), F.lit(0).alias("last"))

    def step(a, end):
        q = F.get(table, F.get(listed, end - 1))["share"]
        return F.struct(
            (a["sum"] + divergence((end - a["last"]) / n_words, q) - q).alias("sum"),
            (a["share"] + q).alias("share"),
            end.alias("last"),
        )

    own = F.aggregate("__ends", start, step)
    every = F.col("__ref.__ref_common")
    rest = divergence(F.greatest(1 - F.size(listed) / n_words, F.lit(0.0)), F.greatest(1 - every, F.lit(0.0)))
    return df.withColumns(
        {
            "char_distance": F.when(n_chars >= LEAST_CHARACTERS, as_distance(plain_sum(by_class))),
            "word_distance": F.when(listed.isNotNull(), as_distance(own["sum"] + every + rest)),
        }
    )


def quality_rules(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", references: DataFrame | None = None) -> DataFrame:
    """One row per row of ``df`` with the base counts, both distances and ``kept``.

    ``kept`` is false where the base rules fail or a distance is above its threshold; a distance
    that is null (short text) never rejects. Null and empty texts have no words and fail the base
    rules. Repeated rows are judged alike, each by itself. Of the other columns none is read, so
    their names don't matter. Without rows there is no result. Without ``references`` they are
    made from ``df`` itself.
    """
    rows = df.select(F.col(id_col).alias(id_col), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    if references is None:
        references = bounded(stored(language_references(rows), "references"))
    judged = divergence_columns(base_columns(rows), references)
    far = (F.coalesce("char_distance", F.lit(0.0)) > MOST_CHARACTER_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MOST_WORD_DISTANCE)
    return judged.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"), "char_distance", "word_distance",
    )
