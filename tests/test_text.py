import sys

import pytest
from pyspark.sql import functions as F

from textlab.functions import text as t
from textlab.operators import merge


def values(spark, rows, *columns):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_whitespace_is_what_python_strips():
    assert sorted(t.WHITESPACE) == [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()]


def test_words_split_at_every_white_space_character(spark):
    rows = [f"a{c}b" for c in map(chr, range(1, 0x3100)) if not 0xD800 <= ord(c) < 0xE000]
    found = [r[0] for r in values(spark, rows, t.word_count(F.col("s")))]
    assert found == [len(r.split()) for r in rows]


@pytest.mark.parametrize("text", [" a b ", " x", "\x1fhi\x85", "", "   ", "\t\n"])
def test_strip_and_blank(spark, text):
    row = values(spark, [text], t.strip(F.col("s")), t.is_blank(F.col("s")))[0]
    assert row == (text.strip(), text.strip() == "")


def test_normalise_counts_and_fill(spark):
    rows = ["  Héllo, WORLD 42! ", "C'est l'été", "😀 a", None, " "]
    got = values(spark, rows, t.normalise(F.col("s")), t.token_count(F.col("s")), t.fill_empty(F.col("s")))
    assert [g[0] for g in got] == ["hllo world 42", "cest lt", " a", None, ""]
    assert [g[1] for g in got] == [3, 4, 1, None, 0]
    assert [g[2] for g in got[2:]] == ["😀 a", "[EMPTY]", "[EMPTY]"]
    assert values(spark, ["A b-C d"], t.tokens(F.col("s"), 3)) == [(["a", "b", "c"],)]


def test_merge_skips_blank_and_nan(spark):
    df = spark.createDataFrame([("x", " NaN ", None), (" ", "b", "c ")], "a string, b string, combined_text string")
    out = merge.merge_text(df, ["a", "b", "combined_text"])
    assert out.columns[-1] == "combined_text_merged"
    assert [r[-1] for r in out.collect()] == ["a: x", "b: b [SEP] combined_text: c"]


def test_truncation_at_the_limits(spark):
    sizes = [1638, 1639, 2048, 2049]
    df = spark.createDataFrame([("x" * n,) for n in sizes], "s string")
    own = [len(r[0]) for r in merge.truncate_text(df, "s").collect()]
    everywhere = [len(r[0]) for r in merge.truncate_text(df, "s", mode="reference").collect()]
    untouched = merge.truncate_text(df.filter(F.length("s") <= 2048), "s", mode="reference").collect()
    assert own == [1638, 1639, 2048, 1638]
    assert everywhere == [1638] * 4
    assert [len(r[0]) for r in untouched] == [1638, 1639, 2048]
