import pytest
from pyspark.sql import functions as F

from textlab.operators import labels, profile, quality, validate
from textlab.sources.csvfiles import read_csv
from textlab.sources.tables import write_decisions, write_predictions
from textlab.plans import analysis


def test_guards_raise(spark):
    df = spark.range(99).withColumn("y", F.lit("a"))
    with pytest.raises(ValueError, match="99 rows"):
        validate.require_min_rows(df)
    assert validate.require_min_rows(spark.range(100)).count() == 100
    with pytest.raises(ValueError, match="not found"):
        validate.require_columns(df, ["nope"])
    with pytest.raises(ValueError, match="header"):
        validate.require_columns(spark.createDataFrame([(1, 2)], "`1` int, `2.5` int"), ["label"])
    with pytest.raises(ValueError, match="1 class"):
        validate.require_classes(df, "y")
    lonely = spark.createDataFrame([("a",), ("a",), ("b",)], "y string")
    with pytest.raises(ValueError, match="'b' has 1 row"):
        validate.require_classes(lonely, "y")
    with pytest.raises(ValueError, match="continuous"):
        validate.require_classification(spark.range(21).withColumn("y", F.col("id") / 2), "y")
    assert validate.require_classification(spark.range(20).withColumn("y", F.col("id") / 2), "y")
    empty = spark.createDataFrame([(None,)] * 96 + [("x",)] * 4, "c string")
    with pytest.raises(ValueError, match="null"):
        validate.require_filled(empty, ["c"])


def test_labels_become_strings(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (float("nan"),)], "y double")
    assert [r[0] for r in validate.normalise_label(df, "y").collect()] == ["1", "2", None, None]
    broken = spark.createDataFrame([(1.0,), (2.5,)], "y double")
    assert [r[0] for r in validate.normalise_label(broken, "y").collect()] == ["1.0", "2.5"]


def test_missing_blank_and_duplicates(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, None, "y"), (4, "b", None), (5, "b", "  \n"), (6, "c", "z")]
    df = spark.createDataFrame(rows, "id long, y string, t string")
    kept = validate.clean(df, "y", "t", "id")
    assert sorted(r["id"] for r in kept.collect()) == [1, 6]
    again = validate.dedup_text(kept, "t", "id")
    assert sorted(r["id"] for r in again.collect()) == [1, 6]
    funnel = {r["stage"]: (r["rows_in"], r["rows_out"]) for r in validate.cleaning_funnel(df, "y", "t").collect()}
    assert list(funnel.values()) == [(6, 5), (5, 4), (4, 3), (3, 2)]


def test_dedup_with_a_text_that_fills_a_third(spark):
    df = spark.range(3000).withColumn("t", F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")))
    kept = validate.dedup_text(df.repartition(7), "t", "id")
    assert kept.count() == 2001 and kept.filter("t = 'same'").first()["id"] == 0


def test_multi_label_needs_more_than_a_tenth(spark):
    def told(n):
        df = spark.range(100).withColumn("y", F.when(F.col("id") < n, "a,b").otherwise("c"))
        return validate.is_multi_label(df, "y")

    assert (told(10), told(11)) == (False, True)
    lists = spark.createDataFrame([(1, ["a", " b "])], "id int, y array<string>")
    assert validate.is_multi_label(lists, "y")
    assert labels.multi_hot(lists, "y").first()["multi_hot"] == [1.0, 1.0]


def test_column_roles(spark):
    df = spark.range(200).select(
        F.concat(F.lit("u"), F.col("id")).alias("user"),
        F.concat(F.lit("a longer sentence number "), F.col("id")).alias("body"),
        F.when(F.col("id") % 2 == 0, "gold").otherwise("tin").alias("tier"),
        F.lit("same").alias("fixed"),
        F.lit(None).cast("string").alias("nothing"),
    )
    kinds = {r["column"]: r["kind"] for r in profile.classify_columns(profile.profile_columns(df)).collect()}
    assert kinds == {"user": "id", "body": "text", "tier": "categorical", "fixed": "ignored", "nothing": "ignored"}
    assert profile.text_column_of(df, "tier") == "body"
    assert profile.text_column_of(df.select("tier", "user"), "user") == "tier"
    with pytest.raises(ValueError, match="too short"):
        profile.text_column_of(spark.range(50).select(F.lit("abc").alias("c"), F.lit("y").alias("y")), "y")
    rough = profile.profile_columns(df.select("tier"), approximate=True).first()
    assert rough["num_unique"] == 2 and rough["non_null"] == 200


def test_quality_findings(spark):
    rows = [("Hello!", "a"), ("hello", "b"), ("ok", "a"), ("long enough", "a")] * 1
    df = spark.createDataFrame(rows, "t string, y string")
    found = {(r["check"], r["subject"]): r["n"] for r in quality.quality_report(df, "t", "y").collect()}
    assert found == {("short texts", ""): 1, ("near duplicates", ""): 2, ("label conflicts", ""): 1,
                     ("tiny class", "a"): 3, ("tiny class", "b"): 1}
    verdict = quality.quality_verdict(df, quality.quality_report(df, "t", "y")).first()
    assert (verdict["total_warnings"], verdict["passed"]) == (5, False)
    fine = spark.range(40).select(F.concat(F.lit("text "), F.col("id")).alias("t"), (F.col("id") % 2).cast("string").alias("y"))
    assert quality.quality_verdict(fine, quality.quality_report(fine, "t", "y")).first()["passed"]


def test_csv_in_both_encodings(spark, tmp_path):
    for name, encoding in (("u.csv", "utf-8"), ("l.csv", "latin-1")):
        (tmp_path / name).write_bytes('text,label\n"été, ""oui""\nencore",x\n'.encode(encoding))
        row = read_csv(spark, str(tmp_path / name)).first()
        assert (row["text"], row["label"]) == ('été, "oui"\nencore', "x")
    with pytest.raises(ValueError, match="cannot load"):
        read_csv(spark, str(tmp_path / "missing.csv"))


def test_files_for_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c')], "id int, predicted_label string")
    write_predictions(df, str(tmp_path / "p"))
    assert read_csv(spark, str(tmp_path / "p")).first()["predicted_label"] == 'a "b", c'
    docs = spark.range(300).select("id", F.concat(F.lit("text "), "id").alias("t"), (F.col("id") % 2).cast("string").alias("y"))
    log = analysis.decision_log(analysis.analyze(docs, "y", "t"))
    write_decisions(log, str(tmp_path / "d"))
    told = spark.read.json(str(tmp_path / "d")).first()
    assert told["total_decisions"] == 5 and [e["decision_no"] for e in told["decisions"]] == [1, 2, 4, 5, 6]
