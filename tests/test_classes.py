"""The class dictionary and sparse label sets, with few classes and with many."""

import pytest
from pyspark.sql import functions as F

from textlab.operators import classes as c
from textlab.operators import labels


def test_dictionary_is_sorted_and_gapless(spark):
    names = ["b", "a", None, "B", "é", "", "a", "b"] * 3 + [f"n{i}" for i in range(300)]
    found = c.class_dictionary(spark.createDataFrame([(n,) for n in names], "y string").repartition(5), "y")
    assert [tuple(r) for r in found.orderBy("class_id").collect()] == list(
        zip(sorted({n for n in names if n is not None}, key=lambda n: n.encode()), range(1000))
    )
    assert c.class_dictionary(spark.createDataFrame([], "y string"), "y").collect() == []


def test_a_million_classes(spark):
    df = spark.range(1_000_000).select(F.format_string("%07d", (F.col("id") * 7919) % 1_000_000).alias("y"))
    found = labels.index_labels(df, "y")
    wrong = found.filter(F.col("label").cast("int") != F.col("class_id"))
    assert found.count() == 1_000_000 and wrong.isEmpty()
    coded = labels.encode_labels(df.limit(1000), "y", found)
    assert coded.filter(F.col("y").cast("int") != F.col("class_id")).isEmpty() and coded.count() == 1000
    plan = found._jdf.queryExecution().toString().lower()
    assert "collect_list" not in plan and "collect_set" not in plan


@pytest.mark.parametrize("few", [0, c.FEW_CLASSES])
def test_lists_of_ids_and_sets_of_labels(spark, monkeypatch, few):
    monkeypatch.setattr(c.few_names, "__defaults__", (few,))
    table = spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], "label string, class_id int")
    df = spark.createDataFrame([(1, [2, 0, 2]), (2, []), (3, None), (4, [7, 1, None, -1]), (5, [2, 0, 2])], "k int, class_ids array<int>")
    got = {r["k"]: r["decoded"] for r in c.decode_id_lists(df, table).collect()}
    assert got == {1: ["z", "x", "z"], 2: [], 3: None, 4: [None, "y", None, None], 5: ["z", "x", "z"]}
    tags = spark.createDataFrame([(1, "z, x,z"), (2, None), (3, "no"), (4, "y|x"), (4, "y|x")], "k int, tags string")
    sets = sorted((r["k"], r["label_ids"]) for r in c.label_sets(tags, "tags", table).collect())
    assert sets == [(1, [0, 2]), (2, []), (3, []), (4, [0, 1]), (4, [0, 1])]


def test_many_labels_per_row_stay_sparse(spark):
    df = spark.range(3000).select("id", F.concat_ws(",", F.format_string("l%06d", F.col("id") * 2), F.format_string("l%06d", F.col("id") + 1)).alias("tags"))
    table = c.atomic_classes(df, "tags")
    names = {r["class_id"]: r["label"] for r in table.collect()}
    assert len(names) > c.FEW_CLASSES
    for r in c.label_sets(df, "tags", table).collect():
        assert [names[i] for i in r["label_ids"]] == sorted(set(r["tags"].split(",")))


def test_salted_join_with_maps(spark):
    from textlab.functions.groups import salted_join

    rows = spark.createDataFrame([(i % 2, {"a": i}) for i in range(50)], "k int, m map<string,int>")
    table = spark.createDataFrame([(0, "p"), (1, "q")], "k int, v string")
    assert salted_join(rows, table, "k").count() == 50
