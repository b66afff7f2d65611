"""Tables with the cases that every operator has to stand."""

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField(*f) for f in (
        ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()),
        ("n_chars", T.LongType()), ("sketch", T.StringType()), ("shard", T.StringType()), ("size", T.StringType()),
        ("id", T.StringType()), ("token", T.StringType()), ("rest", T.StringType()), ("score", T.StringType()),
        ("n", T.StringType()), ("row", T.StringType()), ("key", T.StringType()), ("host", T.StringType()),
    )]
)
LONG = " ".join(f"word{i % 977} and" for i in range(60_000))


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), *["x"] * (len(SCHEMA) - 5))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in all columns, empty, blank and very long texts, ties, repeated rows, clashing names."""
    rows = [
        row(1, None), row(2, ""), row(3, " \n\t "), row(4, LONG), row(5, "short text"), row(6, "short text", None, None),
        row(7, "one two three four five six seven eight nine ten " * 20, "fr", None), row(7, "one two three four five six seven eight nine ten " * 20, "fr", None),
        row(8, "ünï çödé \U0001f642 123 ### $$$", None, "b"), row(9, "!!! 123", "de", "b"),
        tuple([None] * len(SCHEMA)), tuple([None] * len(SCHEMA)),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
