"""CSV files cut into records by quote parity, against Spark's reader of whole files."""

import csv
import random

import pytest

from textlab.sources.csvfiles import header_names, inferred, lines_of, read_csv

VALUES = ["plain", "", None, "two\nlines", 'say "so"', "a,b", "\n", '"', "x\r\ny", "é ü", " padded ", "three\n\n\nlines", '\n"\n"']


@pytest.fixture(scope="module")
def table():
    rng = random.Random(8)
    return [[str(i), rng.choice(VALUES), rng.choice(VALUES), f"{rng.random():.3f}", rng.choice(["true", "False"]), f"2024-01-{1 + i % 28:02d}"] for i in range(160)]


def write(path, rows, encoding, header=("id", "t", "u", "x", "ok", "day"), end="\n"):
    with open(path, "w", newline="", encoding=encoding) as f:
        f.write(",".join(header) + end)
        for row in rows:
            f.write(",".join("" if v is None else '"' + v.replace('"', '""') + '"' if not v or set(v) & set('",\r\n ') else v for v in row) + end)


@pytest.fixture
def small_stretches(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_same_as_the_reader_of_whole_files(spark, tmp_path, table, small_stretches):
    write(tmp_path / "a.csv", table, "utf-8")
    assert lines_of(spark, str(tmp_path)).select("block").distinct().count() > 10
    got = read_csv(spark, str(tmp_path))
    whole = spark.read.options(header=True, multiLine=True, escape='"', inferSchema=True).csv(str(tmp_path))
    assert got.dtypes == whole.dtypes == [("id", "int"), ("t", "string"), ("u", "string"), ("x", "double"), ("ok", "boolean"), ("day", "date")]
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect())) and got.count() == 160


def test_mixed_encodings_and_line_ends(spark, tmp_path, table, small_stretches):
    write(tmp_path / "a.csv", table[:80], "utf-8", end="\r\n")
    write(tmp_path / "b.csv", table[80:], "latin-1")
    (tmp_path / "c.csv").write_text("id,t,u,x,ok,day\n")
    rows = sorted(read_csv(spark, str(tmp_path)).collect(), key=lambda r: r["id"])
    # As in Spark's own reader, an empty field is null, quoted or not.
    assert [(r["t"], r["u"]) for r in rows] == [(r[1] or None, r[2] or None) for r in table]


def test_a_record_over_many_stretches(spark, tmp_path, small_stretches):
    long = "\n".join(f'line {i} "q"' for i in range(500))
    write(tmp_path / "a.csv", [["1", "x"], ["2", long], ["3", "y\nz"]], "utf-8", ("id", "t"))
    assert [r["t"] for r in read_csv(spark, str(tmp_path)).orderBy("id").collect()] == ["x", long, "y\nz"]


def test_headers(spark, tmp_path):
    assert header_names('a,"b\nc",,A') == ["a0", "b\nc", "_c2", "A3"]
    (tmp_path / "one.csv").write_text("﻿p,q\n")
    (tmp_path / "two.csv").write_text("p,r\n1,2\n")
    assert read_csv(spark, str(tmp_path / "one.csv")).columns == ["p", "q"]
    with pytest.raises(ValueError, match="headers"):
        read_csv(spark, str(tmp_path))
    with pytest.raises(ValueError, match="cannot load"):
        read_csv(spark, str(tmp_path / "none.csv"))


def test_types(spark):
    df = spark.createDataFrame([("1", "99999999999", "1e3", None, "x", " 1"), ("-2", "3", "NaN", None, "1", "2")], "a string, b string, c string, d string, e string, f string")
    assert [k for _, k in inferred(df)] == ["int", "bigint", "double", "string", "string", "string"]


def test_given_schema_and_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("k,v\n1,\xe9\n2,\n".encode("latin-1"))
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv"), "latin-1", schema).orderBy("k").collect()] == [("1", "é"), ("2", None)]
