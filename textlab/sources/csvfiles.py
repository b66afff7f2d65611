"""CSV files with a header, read by many tasks though fields may hold line ends.

A line end belongs to a field if the quotes before it in the file are odd in number. Spark deals out
the lines of a file in stretches; the quotes of each stretch are counted, the parities of the
stretches before it say whether a stretch begins inside a field, and each task then joins the lines
of its records by itself. Only a record that goes over the end of a stretch is put together by a
shuffle. The encoding is decided per file: Latin-1 where its bytes are not valid UTF-8.
"""

from __future__ import annotations

import csv
import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.functions.groups import collected, join_on
from textlab.session import written

LATIN = "ISO-8859-1"
OPTIONS = {"escape": '"', "mode": "PERMISSIVE"}
WHOLE, HEAD, MIDDLE, TAIL = range(4)
CUT = "file string, block bigint, charset string, pos bigint, kind int, bytes binary"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """The lines of files as bytes, with their file and where the stretch they are read in begins."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )


def stretches(lines: DataFrame, encoding: str | None) -> DataFrame:
    """Per stretch of a file whether it begins inside a field, and the encoding of the file."""
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "block").agg(
        F.sum(quotes).alias("quotes"), F.bool_and(F.is_valid_utf8("value")).alias("valid")
    )
    file = Window.partitionBy("file")
    before = file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    latin = F.when(F.bool_and("valid").over(file), "UTF-8").otherwise(LATIN)
    return counted.select(
        "file",
        "block",
        (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"),
        (latin if encoding is None else F.lit(encoding)).alias("charset"),
    )


class _Stretch:
    """The records of one stretch, of which lines come in slices."""

    def __init__(self, file: str, block: int, charset: str, inside: bool):
        self.named, self.open, self.begun_before = (file, block, charset), inside, inside
        self.lines, self.waiting, self.waiting_from = 0, [], 0

    def _rows(self, pos, kinds, values) -> pa.RecordBatch:
        n = len(pos)
        file, block, charset = self.named
        return pa.RecordBatch.from_arrays(
            [
                pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array([charset] * n, pa.string()),
                pa.array(pos, pa.int64()), pa.array(kinds, pa.int32()), values,
            ],
            ["file", "block", "charset", "pos", "kind", "bytes"],
        )

    def add(self, values: pa.Array):
        """Records that end in the next lines of the stretch."""
        quotes = pc.count_substring(values, pattern='"').to_numpy(zero_copy_only=False)
        ends = np.flatnonzero((int(self.open) + np.cumsum(quotes)) % 2 == 0)
        first = np.r_[0, ends[:-1] + 1] if len(ends) else ends
        alone = first == ends
        if len(ends) and self.waiting:
            alone[0] = False
        pos = list(self.lines + ends[alone])
        kinds = [WHOLE] * len(pos)
        if self.begun_before and len(ends) and alone[0]:
            kinds[0] = TAIL
        made = []
        for a, b in zip(first[~alone], ends[~alone]):
            parts = values.slice(a, b - a + 1).to_pylist()
            start = self.lines + a
            if a == 0 and self.waiting:
                parts, start = self.waiting + parts, self.waiting_from
            pos.append(start)
            kinds.append(TAIL if a == 0 and self.begun_before else WHOLE)
            made.append(b"\n".join(parts))
        rest = int(ends[-1]) + 1 if len(ends) else 0
        if len(ends):
            self.waiting, self.begun_before = [], False
        if rest < len(values):
            if not self.waiting:
                self.waiting_from = self.lines + rest
            self.waiting += values.slice(rest).to_pylist()
        self.open = (int(self.open) + int(quotes.sum())) % 2 == 1
        self.lines += len(values)
        yield self._rows(pos, kinds, pa.concat_arrays([values.take(pa.array(ends[alone])).cast(pa.binary()), pa.array(made, pa.binary())]))

    def close(self):
        """The part of a record that goes on in the next stretch."""
        if self.waiting:
            kind = MIDDLE if self.begun_before else HEAD
            yield self._rows([self.waiting_from], [kind], pa.array([b"\n".join(self.waiting)], pa.binary()))


def cut_records(lines: DataFrame) -> DataFrame:
    """Records, and parts of those that go over the end of a stretch.

    ``lines`` has ``file``, ``block``, ``inside``, ``charset`` and ``value``, stretch by stretch in
    the order of the file.
    """

    def cut(batches):
        now = None
        for batch in batches:
            block = batch.column("block").to_numpy(zero_copy_only=False)
            file = batch.column("file").dictionary_encode()
            code = file.indices.to_numpy(zero_copy_only=False)
            new = np.flatnonzero((block[1:] != block[:-1]) | (code[1:] != code[:-1])) + 1
            for a, b in zip([0, *new], [*new, batch.num_rows]):
                if a == b:
                    continue
                name = (batch.column("file")[a].as_py(), int(block[a]), batch.column("charset")[a].as_py())
                if now is None or now.named != name:
                    if now is not None:
                        yield from now.close()
                    now = _Stretch(*name, batch.column("inside")[a].as_py())
                yield from now.add(batch.column("value").slice(a, b - a).cast(pa.large_binary()))
        if now is not None:
            yield from now.close()

    ready = lines.select("file", "block", "inside", "charset", F.col("value").cast("binary").alias("value"))
    return ready.mapInArrow(cut, CUT)


def whole_records(cut: DataFrame) -> DataFrame:
    """``file``, ``block``, ``pos`` and ``text`` of all records, parts put together."""
    mine = Window.partitionBy("file").orderBy("block", "pos", F.desc("kind"))
    begun = F.sum((F.col("kind") == HEAD).cast("int")).over(mine.rowsBetween(Window.unboundedPreceding, 0))
    parts = cut.filter(F.col("kind") != WHOLE).withColumn("record", begun)
    own = F.struct("block", "pos", "bytes")
    joined = parts.groupBy("file", "charset", "record").agg(F.array_sort(F.collect_list(own)).alias("parts")).select(
        "file",
        F.get("parts", F.lit(0))["block"].alias("block"),
        F.get("parts", F.lit(0))["pos"].alias("pos"),
        "charset",
        F.aggregate(
            F.slice("parts", 2, F.size("parts")),
            F.get("parts", F.lit(0))["bytes"],
            lambda a, x: F.concat(a, F.lit("\n").cast("binary"), x["bytes"]),
        ).alias("bytes"),
    )
    every = cut.filter(F.col("kind") == WHOLE).select("file", "block", "pos", "charset", "bytes").unionByName(joined)
    text = F.when(F.col("charset") == "UTF-8", F.col("bytes").cast("string")).when(
        F.col("charset") == LATIN, F.decode("bytes", LATIN)
    )
    return every.withColumn("text", F.regexp_replace(text, "\r$", "")).select("file", "block", "pos", "text")


def header_names(header: str) -> list[str]:
    """Column names of a header; empty ones are numbered, repeated ones get their place behind them."""
    fields = next(csv.reader(io.StringIO(header.removeprefix("﻿"), newline="")), [])
    lower = [f.lower() for f in fields]
    return [f"_c{i}" if not f else f"{f}{i}" if lower.count(f.lower()) > 1 else f for i, f in enumerate(fields)]


def _ddl(fields) -> str:
    return ", ".join(f"`{name.replace('`', '``')}` {kind}" for name, kind in fields)


def _fits(value: Column, kind: str, pattern: str) -> Column:
    return F.bool_and(value.isNull() | (value.rlike(pattern) & value.try_cast(kind).isNotNull()))


#: Column types in the order in which they are tried, each with the look of its values.
KINDS = [
    ("int", r"^[+-]?[0-9]+$"),
    ("bigint", r"^[+-]?[0-9]+$"),
    ("double", r"^\S+$"),
    ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("timestamp", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]"),
    ("boolean", r"(?i)^(?:true|false)$"),
]


def inferred(rows: DataFrame) -> list[tuple[str, str]]:
    """The first type of each column that all its values have, from one pass; else string."""
    checks = []
    for i, name in enumerate(rows.columns):
        value = F.col(f"`{name.replace('`', '``')}`")
        checks.append(F.count(value).alias(f"n{i}"))
        checks += [_fits(value, kind, pattern).alias(f"{kind}{i}") for kind, pattern in KINDS]
    found = rows.agg(*checks).first()
    return [
        (name, next((kind for kind, _ in KINDS if found[f"n{i}"] and found[f"{kind}{i}"]), "string"))
        for i, name in enumerate(rows.columns)
    ]


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """CSV files with one header, each as UTF-8 or, where its bytes are not valid UTF-8, as Latin-1;
    ``encoding`` says it for all of them.

    Quotes are doubled inside quoted fields and appear in no others. Blank lines are no records.
    Without ``schema`` the types are inferred from all values. Files whose headers differ are an
    error, and so is what Spark cannot read. The records are cut once, into a table in the shared
    folder.
    """
    try:
        charset = None if encoding is None else {"utf-8": "UTF-8", "utf8": "UTF-8"}.get(encoding.lower(), LATIN)
        if encoding is not None and encoding.upper() not in ("UTF-8", "UTF8", LATIN, "LATIN1", "LATIN-1"):
            reader = spark.read.options(header=True, multiLine=True, encoding=encoding, **OPTIONS)
            return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
        records = _records(spark, path, charset)
        first = (F.col("block") == 0) & (F.col("pos") == 0)
        headers = [r["text"] for r in records.filter(first).select("text").distinct().limit(2).collect()]
        if len(headers) > 1:
            raise ValueError("the files have different headers")
        names = header_names(headers[0]) if headers else []
        texts = records.filter(~first & (F.trim("text") != "")).select("text")
        plain = texts.select(F.from_csv("text", _ddl((n, "string") for n in names), OPTIONS).alias("r")).select("r.*") if names else texts.drop("text")
        if schema is not None:
            fields = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        else:
            fields = inferred(plain) if names else []
        if not fields:
            return plain
        return texts.select(F.from_csv("text", _ddl(fields), OPTIONS).alias("r")).select("r.*")
    except Exception as error:
        raise ValueError(f"cannot load {path}: {error}") from error


def _records(spark: SparkSession, path: str, charset: str | None) -> DataFrame:
    # Held while it is read twice, so that both reads see the same stretches.
    lines = lines_of(spark, path).persist(StorageLevel.DISK_ONLY)
    try:
        found = stretches(lines, charset)
        small = collected(found)
        if small is not None:
            table = spark.createDataFrame(small, found.schema)
            marked = join_on(lines, F.broadcast(table), ["file", "block"])
        else:
            marked = join_on(lines, found, ["file", "block"])
            marked = marked.repartition("file", "block").sortWithinPartitions("file", "block", "at")
        cut = written(cut_records(marked), "records")
    finally:
        lines.unpersist()
    return whole_records(cut)
