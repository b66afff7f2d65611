"""String expressions on text columns. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters counted as white space when a text is stripped or split.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0 "
    "           "
    "    　"
)
# Regular expressions for a word, a token and what near-duplicate keys keep.
# Possessive, since a run of them never has to be given back; that halves the matching time.
WORD = r"(?U)[^\s\x1c-\x1f]++"
TOKEN = r"[\p{L}\p{N}]++"
NORMAL = "[a-z0-9 ]++"
EMPTY_TEXT = "[EMPTY]"
SEPARATOR = " [SEP] "
CHARS_PER_TOKEN = 4


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` alone removes spaces only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def normalise(text: Column) -> Column:
    """Key for near-duplicates: lower case, stripped, ASCII letters, digits and blanks only."""
    kept = F.regexp_extract_all(strip(F.lower(text)), F.lit(NORMAL), F.lit(0))
    return F.array_join(kept, "")


def text_key(text: Column) -> Column:
    """32-byte stand-in for a text, so that shuffles by text do not carry the text."""
    return F.unhex(F.sha2(text, 256))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def tokens(text: Column, max_length: int | None = None) -> Column:
    """Lower-cased runs of letters and digits, the first ``max_length`` of them."""
    found = F.regexp_extract_all(F.lower(text), F.lit("(" + TOKEN + ")"), 1)
    return found if max_length is None else F.slice(found, 1, max_length)


def fill_empty(text: Column) -> Column:
    return F.when(is_blank(text), F.lit(EMPTY_TEXT)).otherwise(text)


def merged_text(columns: list[str]) -> Column:
    """``name: value`` of every column that holds something, joined by the separator."""
    parts = []
    for name in columns:
        value = strip(F.col(name).cast("string"))
        filled = (value != "") & (F.lower(value) != "nan")
        parts.append(F.when(filled, F.concat(F.lit(name + ": "), value)))
    return F.concat_ws(SEPARATOR, *parts)


def bar(share: Column, width: int) -> Column:
    """Text bar of ``share`` of ``width`` blocks, rounded down."""
    return F.repeat(F.lit("█"), F.floor(share * width).cast("int"))
