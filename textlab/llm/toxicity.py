"""Toxicity: embeddings of character n-grams, averaged over a text, into a linear softmax.

A text is the bag of the distinct n-grams of 3 to 6 characters of its words, word edges included,
each hashed to one of 2 ** HASH_BITS rows of an embedding matrix. The mean of the rows, with BLANKS
zero rows among them so that short texts need as clear a sign as others, is the input of a linear
layer with two outputs. Both are trained together in numpy, on a bounded sample of labelled texts
that tasks have turned into bags. A misspelling that no text of the sample has still shares most of
its n-grams with the word it comes from.

As all but the softmax is linear, a row of the matrix adds one number to the score of a text;
these numbers are what the tasks that score texts get.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import partitions, stored

HASH_BITS = 18
SIZES = (3, 4, 5, 6)
#: Numbers in an embedding.
WIDTH = 4
#: Zero rows that are averaged with those of a text.
BLANKS = 100
#: Labelled texts that are fitted on at most, clean and toxic, the first by a hash of their id, and
#: n-grams that the bags of each class may have together: what reaches the driver.
SAMPLE_ROWS, SAMPLE_GRAMS = (3_000, 1_000), 6_000_000
#: Training goes on for STEPS batches, or as many as EPOCHS allows.
BATCH, STEPS, EPOCHS, RATE, START, SEED = 32, 750, (2, 40), 0.5, 0.01, 7
#: What missing a toxic text costs, where taking a clean one for toxic costs 1.
TOXIC_WEIGHT = 3
#: Characters and texts that are worked on at a time.
CHUNK, CHUNK_ROWS = 500_000, 8_192
#: Fixed multipliers of the n-gram hash.
MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263))


@lru_cache(maxsize=1)
def character_table() -> np.ndarray:
    """For each code point the lower-case letter or the digit, or a blank for anything else."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalnum():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of at most CHUNK_ROWS texts with about CHUNK characters in all."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or i + 1 - start == CHUNK_ROWS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of the words of texts, by text: columns, and the text of each.

    Words are runs of letters and digits, each with a blank on both sides, which an n-gram may
    begin or end with but not have inside. At most CHUNK_ROWS texts.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    joined = "".join(f" {t} " for t in texts)
    chars = character_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    row = np.repeat(np.arange(len(texts), dtype=np.uint32), lengths)
    blank = chars == 32
    keep = np.ones(len(chars), bool)
    keep[1:] = ~(blank[1:] & blank[:-1]) | (row[1:] != row[:-1])
    chars, row, blank = chars[keep], row[keep], blank[keep]
    # Blanks so far, so that a range without blanks is found by a difference.
    seen = np.r_[0, np.cumsum(blank, dtype=np.int32)]
    keys = [np.empty(0, np.uint32)]
    hashed = np.full(len(chars), 0x9E3779B1, np.uint32)
    for size in range(1, min(SIZES[-1], len(chars)) + 1):
        n = len(chars) - size + 1
        hashed = (hashed[:n] ^ chars[size - 1 :]) * MULTIPLIERS[size % 4]
        hashed ^= hashed >> np.uint32(15)
        if size in SIZES:
            inside = seen[size - 1 : size - 1 + n] == seen[1 : 1 + n]
            column = hashed & np.uint32((1 << HASH_BITS) - 1)
            keys.append((row[:n] << np.uint32(HASH_BITS) | column)[inside])
    key = np.sort(np.concatenate(keys))
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return (key & np.uint32((1 << HASH_BITS) - 1)).astype(np.int32), (key >> np.uint32(HASH_BITS)).astype(np.int32)


def bags(rows: DataFrame) -> DataFrame:
    """Per row of ``order``, ``label`` and ``text``: the first two, the distinct hashed n-grams as
    bytes of int32, and their number."""

    def count(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in pieces(texts):
                column, row = grams(texts[a:b])
                cuts = np.searchsorted(row, np.arange(b - a + 1))
                lists = pa.array([column[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("order").slice(a, b - a), batch.column("label").slice(a, b - a), lists, pa.array(np.diff(cuts))],
                    ["order", "label", "columns", "n"],
                )

    return rows.select("order", "label", "text").mapInArrow(count, "order bigint, label int, columns binary, n bigint")


class Model:
    """The embeddings, the linear layer and its bias."""

    def __init__(self, embeddings: np.ndarray, layer: np.ndarray, bias: np.ndarray):
        self.embeddings, self.layer, self.bias = embeddings, layer, bias

    def slopes(self) -> np.ndarray:
        """What each row of the embeddings adds to the log-odds of a text that is made of it alone."""
        return self.embeddings @ (self.layer[:, 1] - self.layer[:, 0])


def trained(bag_columns: list[np.ndarray], labels: np.ndarray) -> Model:
    """Embeddings and layer fitted together by seeded mini-batches, with a step size per row.

    Toxic texts weigh TOXIC_WEIGHT times as much as clean ones, whatever their numbers. Where there
    are texts of one class only the layer stays zero and the bias says which class that is; without
    any text nothing is held to be toxic.
    """
    draw = np.random.default_rng(SEED)
    rows = 1 << HASH_BITS
    embeddings = draw.uniform(-START, START, (rows, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    sizes = np.bincount(labels, minlength=2)
    if sizes.min() == 0:
        bias[1] = 4.0 if sizes[1] else -4.0
        return Model(embeddings, layer, bias)
    layer[:, 1] = draw.uniform(-1, 1, WIDTH)
    layer[:, 0] = -layer[:, 1]
    weight = (sizes.sum() / (2 * sizes) * np.array([1, TOXIC_WEIGHT])).astype(np.float32)
    squares = np.full(rows, 1e-8, np.float32)
    layer_squares, bias_squares = np.full((WIDTH, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    epochs = min(max(round(STEPS * BATCH / len(labels)), EPOCHS[0]), EPOCHS[1])
    for epoch in range(epochs):
        rate = np.float32(RATE * (1 - epoch / epochs))
        order = draw.permutation(len(labels))
        for start in range(0, len(order), BATCH):
            chosen = order[start : start + BATCH]
            column = np.concatenate([bag_columns[i] for i in chosen])
            counts = np.array([len(bag_columns[i]) for i in chosen])
            owner = np.repeat(np.arange(len(chosen)), counts)
            share = np.float32(1) / (counts + BLANKS).astype(np.float32)
            # The distinct n-grams of the batch, and where each entry is among them.
            mark = np.zeros(rows, bool)
            mark[column] = True
            used = np.flatnonzero(mark)
            place = np.cumsum(mark, dtype=np.int32)[column] - 1
            matrix = embeddings[used]
            sums = [np.bincount(owner, matrix[:, k][place], len(chosen)) for k in range(WIDTH)]
            mean = (np.stack(sums, 1) * share[:, None]).astype(np.float32)
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = labels[chosen]
            p[np.arange(len(chosen)), y] -= 1
            slope = p * weight[y][:, None] / len(chosen)
            back = slope @ layer.T * share[:, None]
            step = np.stack([np.bincount(place, back[:, k][owner], len(used)) for k in range(WIDTH)], 1).astype(np.float32)
            squares[used] += (step * step).mean(1)
            embeddings[used] -= rate * step / np.sqrt(squares[used])[:, None]
            on_layer, on_bias = mean.T @ slope, slope.sum(0)
            layer_squares += on_layer * on_layer
            bias_squares += on_bias * on_bias
            layer -= rate * on_layer / np.sqrt(layer_squares)
            bias -= rate * on_bias / np.sqrt(bias_squares)
    return Model(embeddings, layer, bias)


def sample(rows: DataFrame) -> DataFrame:
    """The bags of the labelled texts that are fitted on: per class the first by ``order``, and of
    these as many as SAMPLE_GRAMS allows. ``rows`` has ``order``, ``label`` (0 or 1) and ``text``.

    The sizes of the bags, one number for each row of the sample, pass through the driver."""
    first = [
        rows.filter(F.col("label") == label).orderBy("order", F.xxhash64("text")).limit(n)
        for label, n in enumerate(SAMPLE_ROWS)
    ]
    # The limits leave one partition; turning texts into bags is work for all tasks.
    found = stored(bags(first[0].union(first[1]).repartition(partitions(rows.sparkSession), "order")), "bags")
    sizes = sorted((r["label"], r["order"], r["n"]) for r in found.select("label", "order", "n").collect())
    taken = F.lit(False)
    for label in (0, 1):
        total, last = 0, None
        for _, order, n in (x for x in sizes if x[0] == label):
            total += n
            if total > SAMPLE_GRAMS:
                break
            last = order
        if last is not None:
            taken |= (F.col("label") == label) & (F.col("order") <= last)
    return found.filter(taken)


def fit(rows: DataFrame) -> Model:
    """Fit on the sample of ``rows`` (see ``sample``), which is all that reaches the driver."""
    found = sample(rows).orderBy("order", "label", "columns").select("label", "columns").toArrow()
    lists = [np.frombuffer(x, np.int32) for x in found["columns"].to_pylist()]
    return trained(lists, found["label"].to_numpy().astype(np.int64))


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``score`` and ``predicted``; columns of these names are replaced.

    Null and empty texts have the score of the bias. Texts are read whole and repeated rows are
    scored alike; an empty table gives no rows.
    """
    slopes = model.slopes().astype(np.float32)
    shared = df.sparkSession.sparkContext.broadcast((slopes, float(model.bias[1] - model.bias[0])))

    @F.pandas_udf("double")
    def judge(values: pd.Series) -> pd.Series:
        slopes, bias = shared.value
        texts = [t if isinstance(t, str) else "" for t in values]
        odds = [np.empty(0)]
        for a, b in pieces(texts):
            column, row = grams(texts[a:b])
            size = np.bincount(row, minlength=b - a) + BLANKS
            odds.append(np.bincount(row, slopes[column], b - a) / size + bias)
        return pd.Series(1 / (1 + np.exp(-np.concatenate(odds))))

    df = df.drop("score", "predicted")
    scored = df.withColumn("score", judge(F.col(text).cast("string")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(id_column: Column) -> Column:
    """One of five parts of the ids, by their CRC-32; null ids are not held out."""
    return F.coalesce(F.crc32(F.encode(id_column.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``order``, ``label`` and ``text`` of the documents that ``sample`` can choose.

    A document with several labels has the highest; labels other than 0 and 1 and ids without a
    document count as no label. The labels are cut to twice the sample before they meet the
    documents, so a table of bounded size is broadcast and no text is shuffled.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
    known = known.filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    known = known.withColumn("order", F.xxhash64("id"))
    first = [known.filter(F.col("label") == k).orderBy("order").limit(2 * n) for k, n in enumerate(SAMPLE_ROWS)]
    chosen = F.broadcast(first[0].union(first[1]))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    return texts.join(chosen, "id").select("order", "label", "text")


def cross_scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``id``, ``held_out``, ``score`` and ``predicted`` of all documents, by a model that has seen
    labels of rows only that are not held out.

    Each document row gives one row, repeated and null ids too.
    """
    model = fit(labelled_texts(docs, labels.filter(~held_out(F.col(id_col))), id_col, text, label))
    rows = docs.select(F.col(id_col).alias(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text).alias("text"))
    return predict(rows, model).select(id_col, "held_out", "score", "predicted")
