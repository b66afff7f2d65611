"""Compression of vectors to codes: one codebook per part of the vectors, equal-average search.

Vectors are cut into equal parts, and each part is replaced by the number of the entry of its
codebook that is nearest. Entries are kept in the order of their component sums. As the squared
gap of two sums over the dimension is never above the squared distance, a part begins at the entry
whose sum is nearest to its own and goes outward from there until that bound strictly exceeds the
best distance so far; entries that tie are all looked at, so the lowest number wins.

Codebooks are learned over all rows. A round is one pass in which each task adds up the parts of
each entry; what reaches the driver is the sums and counts of the entries, whatever the rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions.groups import lookup_join
from textlab.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers beyond this could overflow a sum of squares.
MOST = 1 << 26
#: Vectors that are worked on at a time.
SLICE = 20_000


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component as an array; null for a null or empty vector and for
    one with null, non-finite or too large components."""
    numbers = F.transform(vector.cast("array<double>"), lambda x: F.floor(x * scale))
    fine = F.forall(vector.cast("array<double>"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < MOST / scale), F.lit(False)))
    return F.when(fine & (F.size(vector) > 0), numbers)


def numbered(df: DataFrame, vector: str, id_col: str, label: str | None, parts: int) -> tuple[DataFrame, int]:
    """The rows whose vectors can be coded, as a table in the shared folder, and their dimension.

    The dimension is that of the usable vector with the smallest id among those whose length the
    parts divide; 0 if there is none. Vectors of any other length can't be coded.
    """
    known = F.lit(None).cast("string") if label is None else F.col(label)
    rows = df.select(F.col(id_col).alias("id"), known.alias("label"), whole_numbers(F.col(vector)).alias("x"))
    rows = rows.filter(F.col("x").isNotNull() & (F.size("x") % parts == 0))
    table = stored(rows, "vectors")
    first = table.filter("id is not null").orderBy("id", "x").select(F.size("x")).first()
    size = first[0] if first else 0
    return table.filter(F.size("x") == size), size


def matrix(column: pa.Array, size: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.int64).reshape(len(column), size)


class Codebook:
    """The entries of one part, with their order by component sum."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        sums = entries.sum(1)
        self.order = np.argsort(sums, kind="stable")
        self.sums = sums[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest entry of each row; the lowest of ties."""
        rows, size = x.shape
        count = len(self.sums)
        best = np.full(rows, count, np.int64)
        least = np.full(rows, np.iinfo(np.int64).max, np.int64)
        sums = x.sum(1)
        high = np.searchsorted(self.sums, sums)
        low = high - 1
        live = np.arange(rows)
        far = np.iinfo(np.int64).max
        while len(live):
            own = sums[live]
            below = np.where(low[live] >= 0, own - self.sums[np.maximum(low[live], 0)], far)
            above = np.where(high[live] < count, self.sums[np.minimum(high[live], count - 1)] - own, far)
            gap = np.minimum(below, above)
            # gap ** 2 / size > least, without a division; gaps of far have no entry.
            known = gap < far
            square = np.where(known, gap, 0) ** 2
            go = known & (square <= np.where(least[live] == far, far, least[live] * size))
            live, down = live[go], (below <= above)[go]
            if not len(live):
                break
            at = np.where(down, low[live], high[live])
            entry = self.order[at]
            difference = x[live] - self.entries[entry]
            distance = np.einsum("ij,ij->i", difference, difference)
            better = (distance < least[live]) | ((distance == least[live]) & (entry < best[live]))
            best[live[better]], least[live[better]] = entry[better], distance[better]
            low[live] -= down
            high[live] += ~down
        return best, least


def first_entries(vectors: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids, one codebook per part."""
    chosen = vectors.filter("id is not null").orderBy("id", "x").limit(entries).select("x").collect()
    whole = np.array([r["x"] for r in chosen], np.int64)
    return np.split(whole, parts, 1)


def learned(vectors: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks after ``rounds`` of assigning all parts and taking the floor of the means.

    Entries that no part is nearest to stay as they are.
    """
    books = first_entries(vectors, parts, entries)
    width = size // parts
    for _ in range(rounds):

        def add(batches, books=books):
            found = [Codebook(b) for b in books]
            sums = np.zeros((parts, len(books[0]), width + 1), np.int64)
            for batch in batches:
                for start in range(0, batch.num_rows, SLICE):
                    x = matrix(batch.column("x").slice(start, SLICE), size)
                    for p, own in enumerate(np.split(x, parts, 1)):
                        code, _ = found[p].nearest(own)
                        sums[p, :, 0] += np.bincount(code, minlength=len(books[p]))
                        by = np.argsort(code, kind="stable")
                        used, cut = np.unique(code[by], return_index=True)
                        sums[p, used, 1:] += np.add.reduceat(own[by], cut)
            part, entry = np.nonzero(sums[:, :, 0])
            yield pa.RecordBatch.from_pydict({"part": part, "entry": entry, "sums": list(sums[part, entry])})

        totals = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width + 1)]
        tasks = vectors.select("x").mapInArrow(add, "part bigint, entry bigint, sums array<bigint>")
        books = [b.copy() for b in books]
        for r in tasks.groupBy("part", "entry").agg(*totals).collect():
            books[r["part"]][r["entry"]] = [r[f"s{i}"] // r["s0"] for i in range(1, width + 1)]
    return books


def coded(vectors: DataFrame, books: list[np.ndarray], size: int) -> DataFrame:
    """``id``, ``label``, ``code`` and ``error`` of all vectors; a code has two hex digits a part."""

    def code_of(batches):
        found = [Codebook(b) for b in books]
        for batch in batches:
            x = matrix(batch.column("x"), size)
            nearest = [book.nearest(own) for book, own in zip(found, np.split(x, len(found), 1))]
            codes = np.stack([c for c, _ in nearest], 1).astype(np.uint8)
            text = [row.tobytes().hex() for row in codes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(text, pa.string()), pa.array(sum(d for _, d in nearest))],
                ["id", "label", "code", "error"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.mapInArrow(code_of, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def books_sha256(books: list[np.ndarray]) -> str:
    """SHA-256 of the components of all entries by part, entry and place, joined by commas."""
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    return hashlib.sha256(text.encode()).hexdigest()


def vector_codes(
    df: DataFrame, vector: str = "embedding", id_col: str = "vec_id", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """Per usable vector its code, its squared error, the error summed over its label, and a hash of
    the codebooks.

    Left out are vectors that are null or empty, or have null, non-finite or too large components
    (``MOST / SCALE`` = 16 384 and more), or a length that the parts do not divide or that is not
    that of the vector with the smallest id. Null labels are one label. Repeated rows each count and
    get the same code; rows with a null id are coded but never begin a codebook. With fewer than
    ``entries`` vectors the codebooks are as short; without any, there are no rows. At most 256
    entries, as a code has a byte per part.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    vectors, size = numbered(df, vector, id_col, label, parts)
    books = learned(vectors, size, parts, entries, rounds) if size else []
    found = stored(coded(vectors, books, size), "codes") if size else coded(vectors, books, 1)
    totals = found.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = lookup_join(found, totals, "label")
    return joined.select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256")
    )


def decoded(df: DataFrame, books: list[np.ndarray], code: str = "code", name: str = "decoded", scale: int = SCALE) -> DataFrame:
    """``df`` with the vector that a code stands for, in the scale of the original components; a null
    code gives null."""
    tables = F.array(*[F.array(*[F.array(*[F.lit(float(v)) for v in entry]) for entry in book]) for book in books])
    numbers = F.transform(
        F.sequence(F.lit(0), F.lit(len(books) - 1)),
        lambda p: F.get(F.get(tables, p), F.conv(F.substring(F.col(code), p * 2 + 1, F.lit(2)), 16, 10).cast("int")),
    )
    return df.withColumn(name, F.when(F.col(code).isNotNull(), F.transform(F.flatten(numbers), lambda v: v / scale)))
