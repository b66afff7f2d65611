"""Plan shape: what must hold whatever the data size."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from textlab.catalog import entries
from textlab.functions import groups
from textlab.functions.groups import small_table
from textlab.operators import labels, quality, validate
from textlab.operators import split as sp
from textlab.sources.tables import load

RELATIONAL = sorted(n for n, (_, sql) in entries().items() if sql is not None and not n.startswith(("g2", "r8")))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_python_rows_and_no_products(spark, small, name):
    text = plan(queries()[name](spark, small))
    assert "EvalPython" not in text and "ArrowEval" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_what_they_need(spark, small):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(labels.class_distribution(load(spark, small, "documents"), "lang")))
    assert set(read) == {"lang:string"}


def test_split_neither_sorts_nor_moves_the_rows(spark, small):
    """The text column passes through joins with broadcast class tables only."""
    parts = sp.stratified_split(load(spark, small, "documents"), "lang", "doc_id", 0.2)
    text = plan(parts)
    assert "Exchange hashpartitioning" not in text and "Sort " not in text and "Window" not in text


def test_shuffles_by_text_carry_keys(spark, small):
    df = load(spark, small, "documents")
    for frame in (quality.text_checks(df, "text", "lang"), validate.dedup_report(df, "text")):
        for line in plan(frame).splitlines():
            if "Exchange hashpartitioning" in line:
                keyed = re.sub(r"sha2\([^)]*\btext#\d+", "", line)
                assert not re.search(r"\btext#", keyed)


def test_lookup_tables_are_broadcast_only_within_the_limit(spark):
    rows = spark.range(30)
    big = spark.range(1000)
    assert "Broadcast" in plan(big.join(small_table(rows, 30), "id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = big.join(small_table(rows, 29), "id")
        assert "Broadcast" not in plan(joined) and joined.count() == 30
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_weights_join_beyond_the_limit(spark, monkeypatch):
    """More classes than may be broadcast: the same weights through a shuffle join."""
    df = spark.range(900).withColumn("y", (F.col("id") % 300).cast("string"))
    weights = labels.class_weights(df, "y")
    expected = sorted(labels.attach_weights(df, weights, "y").collect())
    monkeypatch.setattr(groups, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(small_table, "__defaults__", (10,))
    assert sorted(labels.attach_weights(df, weights, "y").collect()) == expected
    parts = sp.stratified_split(df, "y", "id", 0.4)
    assert parts.filter("split = 'val'").count() == 360


def test_a_hot_key_is_dealt_out(spark, monkeypatch):
    """Two thirds of the rows on one key: no partition of the join has more than its share."""
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = groups.salted_join(rows, table, ["k"])
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == 3000 and max(sizes) < 1200
        assert joined.filter("k = 'hot'").select("n").distinct().collect()[0]["n"] == 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_cluster_session_needs_a_shared_folder():
    from types import SimpleNamespace

    from textlab.session import shared_dir

    conf = SimpleNamespace(get=lambda name, default=None: {"spark.master": "spark://host:7077"}.get(name, default))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(SimpleNamespace(conf=conf))
