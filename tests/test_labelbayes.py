"""The closed form of all labels against Spark's naive Bayes label by label."""

import random

import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from textlab.operators.labelbayes import LabelBayes, fit_label_bayes
from textlab.operators.labels import pos_weights

SCHEMA = "id long, text string, tags string"


def table(spark, n=120, labels=6):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        tags = [f"t{k}" for k in range(labels) if rng.random() < 0.1 + 0.1 * k / labels]
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 12))] + [f"x{t}" for t in tags if rng.random() < 0.6]
        rows.append((i, " ".join(words), ",".join(tags)))
    return spark.createDataFrame(rows, SCHEMA)


def predicted(model, df):
    return {r["id"]: r["predicted"] for r in model.score(df, "text", "id").collect()}


def test_labels_as_one_by_one(spark):
    df = table(spark)
    told = predicted(fit_label_bayes(df, "text", "tags"), df)
    weights = {r["label"]: r["pos_weight"] for r in pos_weights(df, "tags").collect()}
    split = df.withColumn("terms", F.split("text", " "))
    ready = CountVectorizer(inputCol="terms", outputCol="features").fit(split).transform(split).cache()
    wanted = {i: [] for i in told}
    for label, weight in sorted(weights.items()):
        y = F.array_contains(F.split("tags", ","), label).cast("double")
        rows = ready.withColumn("y", y).withColumn("w", F.when(F.col("y") == 1, weight).otherwise(1.0))
        one = NaiveBayes(labelCol="y", weightCol="w").fit(rows).transform(ready)
        for r in one.filter(vector_to_array("probability")[1] >= 0.5).collect():
            wanted[r["id"]].append(label)
    ready.unpersist()
    assert told == wanted and sum(map(len, told.values())) > 50


def test_a_saved_model_and_unknown_terms(spark, tmp_path):
    df = table(spark)
    model = fit_label_bayes(df, "text", "tags")
    model.save(str(tmp_path / "model"))
    odd = spark.createDataFrame([(1, None, ""), (2, "", ""), (3, "never seen", ""), (4, "xt1 xt1 xt1 W3", "")], SCHEMA)
    told = predicted(LabelBayes.load(spark, str(tmp_path / "model")), odd)
    assert told[1] == told[2] == told[3] and "t1" in told[4]
    assert told == predicted(model, odd)


def test_the_plan_does_not_grow_with_the_labels(spark):
    """A thousand labels add the salts of one join, which few labels do without."""
    lengths = []
    for labels in (6, 1000):
        model = fit_label_bayes(table(spark, 60, labels), "text", "tags")
        assert model.labels.count() <= labels
        lengths.append(model.score(table(spark, 60, 6), "text", "id")._jdf.queryExecution().analyzed().toString().count("\n"))
    assert lengths[1] <= lengths[0] + 4


@pytest.mark.parametrize("rows", [[], [(1, None, None), (2, "some words", "")]])
def test_without_labels(spark, rows):
    model = fit_label_bayes(spark.createDataFrame(rows, SCHEMA), "text", "tags")
    assert all(not x for x in predicted(model, table(spark, 5)).values())


def test_a_term_is_one_row_of_the_model(spark):
    """Terms are not repeated by label, and those of a large model are not copied for a join."""
    df = table(spark)
    model = fit_label_bayes(df, "text", "tags")
    assert model.terms.count() == model.terms.select("term").distinct().count()
    many = spark.range(10_001).select(
        F.concat(F.lit("w"), F.col("id")).alias("term"), F.lit(-1.0).alias("lift"),
        F.expr("array(struct('t1' as label, 2.0D as lift))").alias("own"),
    )
    large = LabelBayes(many, model.labels)
    assert "_salt" not in large.margins(df, "text", "id")._jdf.queryExecution().analyzed().toString()
    got = {(r["id"], r["label"]): (r["lift"], r["n_terms"]) for r in large.margins(df.filter("id = 0"), "text", "id").collect()}
    n = sum(w.startswith("w") for w in df.filter("id = 0").first()["text"].split())
    assert got == {(0, None): (-n, n), (0, "t1"): (2.0 * n, n)}
