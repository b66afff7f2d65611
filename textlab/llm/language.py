"""Language identification: multinomial naive Bayes over hashed n-grams of characters.

Counting goes over all labelled rows and is summed by Spark. The model is a matrix with one row
per language and 2 ** HASH_BITS columns, whatever the size of the corpus, and is broadcast.
Batches of texts are scored as sparse counts in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that are worked on at a time.
CHUNK = 500_000

HASH_BITS = 16
SIZES = (1, 2, 3)
SMOOTHING = 0.5
#: Languages of a model; more distinct labels than that are an error, as the matrix is broadcast.
MOST_LANGUAGES = 512
UNKNOWN = "und"
#: Fixed multipliers of the n-gram hash.
MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or a blank for what isn't a letter."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of texts: columns, the text of each, and which texts have letters.

    Runs of other characters count as one blank, and each text begins and ends with one. An
    n-gram lies inside one text.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    joined = "".join(f" {t} " for t in texts)
    letters = letter_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    row = np.repeat(np.arange(len(texts)), lengths)
    has = np.bincount(row[letters != 32], minlength=len(texts)) > 0
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != 32) | (letters[:-1] != 32) | (row[1:] != row[:-1])
    letters, row = letters[keep], row[keep]
    columns, rows = [], []
    for size in SIZES:
        n = len(letters) - size + 1
        if n <= 0:
            continue
        hashed = np.full(n, size * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for j in range(size):
            hashed = (hashed ^ letters[j : n + j]) * MULTIPLIERS[j]
            hashed ^= hashed >> np.uint32(15)
        inside = row[:n] == row[size - 1 :]
        if size == 1:
            inside &= letters != 32
        columns.append((hashed & np.uint32((1 << HASH_BITS) - 1))[inside])
        rows.append(row[:n][inside])
    return np.concatenate(columns), np.concatenate(rows), has


def pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about CHUNK characters in all."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def counts(rows: DataFrame) -> DataFrame:
    """``lang``, ``column`` and ``n`` over all rows of ``lang`` and ``text``."""

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            names = sorted(set(langs))
            sums = np.zeros((len(names), 1 << HASH_BITS), np.int64)
            code = np.array([names.index(x) for x in langs])
            for a, b in pieces(texts):
                columns, row, _ = features(texts[a:b])
                for k in range(len(names)):
                    sums[k] += np.bincount(columns[code[a:b][row] == k], minlength=1 << HASH_BITS)
            at, column = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(names, object)[at], pa.string()), pa.array(column.astype(np.int32)), pa.array(sums[at, column])],
                ["lang", "column", "n"],
            )

    return rows.mapInArrow(count, "lang string, column int, n bigint").groupBy("lang", "column").agg(F.sum("n").alias("n"))


class Model:
    """Languages and the log-probability of each column and language."""

    def __init__(self, languages: list[str], priors: np.ndarray, logs: np.ndarray):
        self.languages, self.priors, self.logs = languages, priors, logs

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Predicted languages with their posterior probabilities; UNKNOWN and 0 without letters."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        names, scores = [], []
        for a, b in pieces(texts):
            columns, row, has = features(texts[a:b])
            sums = np.stack([np.bincount(row, self.logs[k][columns], b - a) for k in range(len(self.languages))], 1)
            sums += self.priors
            best = sums.argmax(1)
            share = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
            names += [self.languages[k] if h else UNKNOWN for k, h in zip(best, has)]
            scores.append(np.where(has, share, 0.0))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fit on all rows that have a language; null texts count as empty.

    What reaches the driver is the matrix, of a size fixed by HASH_BITS and MOST_LANGUAGES.
    """
    rows = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter(F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: a column of languages is asked for")
    sizes = dict(sorted((r["lang"], r["n"]) for r in sizes))
    languages = list(sizes)
    table = np.zeros((len(languages), 1 << HASH_BITS))
    if languages:
        found = counts(rows).toArrow()
        code = {name: k for k, name in enumerate(languages)}
        at = np.array([code[x] for x in found["lang"].to_pylist()], int)
        table[at, found["column"].to_numpy()] = found["n"].to_numpy()
    logs = np.log(table + SMOOTHING) - np.log(table.sum(1, keepdims=True) + SMOOTHING * table.shape[1])
    weights = np.array(list(sizes.values()), float)
    priors = np.log(weights / weights.sum()) if languages else np.zeros(0)
    return Model(languages, priors, logs.astype(np.float32))


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score``; columns of these names are replaced.

    Null texts and texts without letters are UNKNOWN with score 0. Repeated rows are judged
    alike; an empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def judge(texts):
        import pandas as pd

        names, scores = shared.value.score([t if isinstance(t, str) else "" for t in texts])
        return pd.DataFrame({"lang_pred": names, "score": scores})

    df = df.drop("lang_pred", "score")
    found = df.withColumn("__found", judge(F.col(text).cast("string")))
    return found.select(*df.columns, "__found.lang_pred", "__found.score")


def held_out(id_column: Column) -> Column:
    """One of three parts of the ids, by their CRC-32."""
    return F.coalesce(F.crc32(F.encode(id_column.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def cross_predicted(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Predictions for all rows by a model that has seen only rows that are not held out."""
    rows = df.select(F.col(id_col).alias(id_col), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.withColumn("held_out", held_out(F.col(id_col)))
    model = fit(rows.filter(~F.col("held_out")))
    return predict(rows.select(id_col, "held_out", "text"), model).select(id_col, "held_out", "lang_pred", "score")
