import math
import random

import pytest
from pyspark.sql import functions as F

from textlab.operators import ranks
from textlab.operators import split as sp


def table(spark, n=997):
    label = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, "rare").otherwise((F.col("id") % 7).cast("string"))
    return spark.range(n).withColumn("y", label)


@pytest.mark.parametrize("ratio", [None, 0.1, 0.33])
def test_stratified_sizes(spark, ratio):
    df = table(spark)
    parts = sp.stratified_split(df, "y", "id", ratio)
    rows = parts.collect()
    assert len(rows) == 997
    wanted = math.ceil((ratio or 0.2) * 997)
    assert sum(r["split"] == "val" for r in rows) == wanted
    for y in {r["y"] for r in rows}:
        mine = [r for r in rows if r["y"] == y]
        assert abs(sum(r["split"] == "val" for r in mine) - wanted * len(mine) / 997) < 1


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_results_do_not_depend_on_layout(spark, parts):
    df = table(spark, 500)
    for function in (
        lambda x: sp.stratified_split(x, "y", "id").select("id", "split"),
        lambda x: sp.stratified_folds(x, "y", "id").select("id", "fold"),
        lambda x: ranks.sample_n(x, "id", 50).select("id"),
    ):
        assert sorted(function(df).collect()) == sorted(function(df.repartition(parts)).collect())


def test_random_split_and_folds(spark):
    df = table(spark, 1001)
    assert sp.random_split(df, "id", 0.2).filter("split = 'train'").count() == int(1001 * 0.8)
    sizes = [r["count"] for r in sp.random_folds(df, "id", 4).groupBy("fold").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    one = sp.random_split(spark.range(1), "id", 0.5).first()
    assert one["split"] == "val"


def test_folds_shrink_to_the_smallest_class(spark):
    df = spark.range(30).withColumn("y", F.when(F.col("id") < 3, "rare").otherwise("common"))
    folded = sp.stratified_folds(df, "y", "id", 5)
    assert {r["fold"] for r in folded.collect()} == {0, 1, 2}
    for y in ("rare", "common"):
        sizes = [r["count"] for r in folded.filter(F.col("y") == y).groupBy("fold").count().collect()]
        assert max(sizes) - min(sizes) <= 1


def test_repair_moves_one_row_per_class(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "val" if i % 2 else "train") for i in range(20)], "id long, y string, split string")
    fixed = sp.repair_split(df, "y", "id")
    moved = fixed.join(df.withColumnRenamed("split", "before"), ["id", "y"]).filter("split <> before")
    assert fixed.count() == 20 and [r["y"] for r in moved.collect()] == ["b"]


def test_empty_validation_is_refused(spark):
    df = spark.range(5).withColumn("split", F.lit("train"))
    with pytest.raises(ValueError, match="empty"):
        sp.require_validation(df)
    few = spark.range(5).withColumn("split", F.when(F.col("id") < 4, "val").otherwise("train"))
    assert sp.split_report(few).first()["verdict"] == "unreliable"


@pytest.mark.parametrize("n,val,fit", [(1000, 100, 300), (100, 20, 40), (50, 0, 0)])
def test_proxy_sizes(spark, n, val, fit):
    roles = {r["role"]: r["count"] for r in sp.proxy_sample(table(spark, n), "y", "id").groupBy("role").count().collect()}
    if n == 50:
        assert roles == {"both": 50}
    else:
        assert (roles["proxy_val"], roles["proxy_train"]) == (val, fit)


def test_rank_and_running_sum_with_a_hot_group(spark):
    df = table(spark, 3000)
    ranked = ranks.hash_rank(df, "id", "y").collect()
    for y in ("hot", "rare"):
        mine = sorted(r["rank"] for r in ranked if r["y"] == y)
        assert mine == list(range(1, len(mine) + 1))
    summed = ranks.running_sum(df.withColumn("v", F.col("id") % 5), "v", "y", "id", width=64)
    total = {}
    for r in sorted(summed.collect(), key=lambda r: r["id"]):
        total[r["y"]] = total.get(r["y"], 0) + r["v"]
        assert r["running"] == total[r["y"]]


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 5001])
def test_exact_median(spark, n):
    draw = random.Random(n)
    # A third of the values are equal, the rest crowd near 1.
    data = [(0.99 if i % 3 == 0 else 1 - draw.random() ** 4, i % 2) for i in range(n)]
    df = spark.createDataFrame(data, "v double, g int")

    def median(values):
        s, m = sorted(values), len(values)
        return (s[(m - 1) // 2] + s[m // 2]) / 2

    for accuracy in (50, 100_000):
        assert ranks.exact_median(df, "v", accuracy=accuracy).first()["median"] == median([v for v, _ in data])
        for r in ranks.exact_median(df, "v", "g", accuracy).collect():
            assert r["median"] == median([v for v, g in data if g == r["g"]])


def test_sample_is_exact_and_top_n_orders(spark):
    assert ranks.sample_n(spark.range(1000), "id", 37).count() == 37
    assert ranks.sample_n(spark.range(5), "id", 37).count() == 5
    top = ranks.top_n(spark.range(100), [F.desc("id")], 3).collect()
    assert [(r["id"], r["rank"]) for r in top] == [(99, 1), (98, 2), (97, 3)]
