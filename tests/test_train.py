from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from textlab.catalog.inputs import documents, multi_docs
from textlab.functions.labels import parse_labels
from textlab.operators import compare, explain, labels, train
from textlab.operators import split as sp
from textlab.operators.metrics import metrics, metrics_multilabel
from textlab.plans.run import run
from textlab.sources.runs import SavedRun, load_run, save_run, saved_runs
from textlab.sources.tables import load
from textlab.streaming.scoring import file_stream, predict_stream, table_stream, write_stream

CFG = train.Config(epochs=(1, 2), weight_decay=0.01)


@pytest.fixture(scope="module")
def parts(spark, small):
    df = sp.stratified_split(documents(spark, small).withColumn("label", F.col("lang")), "lang", "doc_id", 0.25)
    kept = df.persist()
    yield [kept.filter(F.col("split") == p) for p in ("train", "val")]
    kept.unpersist()


@pytest.fixture(scope="module")
def bayes(parts):
    return train.fit_model("nb_multinomial", parts[0], "text", "label", CFG)


@pytest.fixture(scope="module")
def logistic(parts):
    return train.fit_model("lr_bigram", parts[0], "text", "label", CFG)


def test_candidates_beat_the_majority(parts, bayes, logistic):
    for one in (bayes, logistic):
        assert one.classes == ["de", "en", "es", "fr"]
        assert metrics(one.score(parts[1])).first()["f1"] > 0.8


def test_a_failing_candidate_is_kept_with_its_error(parts):
    done = train.fit_models(["nb_multinomial", "no such model"], parts[0], "text", "label", CFG)
    assert done[0].error is None and "no such model" in done[1].error


def test_candidates_share_the_hashing_of_their_texts(parts, monkeypatch):
    """One pass for the candidates on tokens and one for those on pairs, with the models of fits one by one."""
    passes, plain = [], train.shared_stages

    def noted(names, text):
        passes.append(list(names))
        return plain(names, text)

    monkeypatch.setattr(train, "shared_stages", noted)
    names = ["lr_bigram", "nb_complement", "lr_unigram", "nb_multinomial"]
    done = train.fit_models(names, parts[0], "text", "label", CFG)
    assert passes == [["nb_complement", "lr_unigram", "nb_multinomial"], ["lr_bigram"]]
    assert [one.name for one in done] == names and all(one.error is None for one in done)
    alone = train.fit_model("lr_unigram", parts[0], "text", "label", CFG)
    a, b = (m.model.stages[-1].coefficientMatrix.toArray() for m in (done[2], alone))
    assert a.shape == b.shape and abs(a - b).max() < 1e-6
    told = train.predictions(done, parts[1], "text")
    for one in done:
        wanted = sorted(one.score(parts[1]).select("doc_id", "prediction").collect())
        assert sorted(told.filter(F.col("model") == one.name).select("doc_id", "prediction").collect()) == wanted
    with pytest.raises(ValueError, match="no such model"):
        train.predictions([train.Trained("no such model", error="unknown")], parts[1], "text")


def test_shared_candidates_keep_their_own_weights(parts):
    cfgs = {"lr_unigram": CFG, "nb_complement": replace(CFG, use_class_weights=True)}
    done = train.fit_models(list(cfgs), parts[0], "text", "label", cfgs)
    for one in done:
        alone = train.fit_model(one.name, parts[0], "text", "label", cfgs[one.name]).model.stages[-1]
        a, b = (m.coefficientMatrix if one.name == "lr_unigram" else m.theta for m in (one.model.stages[-1], alone))
        assert abs(a.toArray() - b.toArray()).max() < 1e-6


def test_weights_come_from_the_training_part(parts):
    weighted = train.train_weights(parts[0], "label", replace(CFG, use_class_weights=True))
    got = {r["label"]: r["weight"] for r in weighted.select("label", "weight").distinct().collect()}
    counts = {r["label"]: r["count"] for r in parts[0].groupBy("label").count().collect()}
    assert got == pytest.approx({c: min(counts.values()) / n for c, n in counts.items()})


def test_focal_refit_changes_the_model(parts, logistic):
    focal = train.fit_focal(parts[0], "text", "label", 2.0, "lr_bigram", CFG)
    a, b = (m.model.stages[-1].coefficientMatrix.toArray() for m in (logistic, focal))
    assert abs(a - b).max() > 1e-6


def test_search_is_seeded_and_skips_the_smallest_tier(parts):
    assert train.trial_settings(CFG, 4) == train.trial_settings(CFG, 4)
    for one in train.trial_settings(replace(CFG, decay_bounds=(0.0, 0.02)), 20):
        assert 0 <= one.weight_decay <= 0.02 and 5 <= one.max_iter <= 10
    kept, record = train.search(parts[0], "text", "label", replace(CFG, strategy="CRITICAL"))
    assert kept.strategy == "CRITICAL" and record == []
    proxy = sp.proxy_sample(parts[0].drop("split"), "label", "doc_id")
    best, record = train.search(proxy, "text", "label", CFG, trials=1)
    assert len(record) == 1
    assert max(record, key=lambda r: r["f1"])["weight_decay"] == best.weight_decay


def test_failed_trials_are_recorded_and_left_out(parts, monkeypatch):
    def fail(*_):
        raise RuntimeError("no fit")

    monkeypatch.setattr(train, "fit_estimator", fail)
    proxy = sp.proxy_sample(parts[0].drop("split"), "label", "doc_id")
    best, record = train.search(proxy, "text", "label", CFG, trials=3)
    assert best == CFG and [r["error"] for r in record] == ["no fit"] * 3


def test_cross_validation(parts):
    folded = sp.stratified_folds(parts[0], "label", "doc_id", 3)
    folds = train.cross_validate(folded, "text", "label", "nb_multinomial", CFG)
    rows = folds.collect()
    assert [r["fold"] for r in rows] == [0, 1, 2] and all(r["error"] is None for r in rows)
    assert sum(r["n_val"] for r in rows) == parts[0].count()
    broken = train.cross_validate(folded, "text", "label", "no such model", CFG)
    assert all(r["f1"] is None and r["error"] for r in broken.collect())
    assert compare.cv_summary(broken).count() == 0


def test_training_curve_falls(spark, logistic):
    curve = train.training_curve(spark, logistic).orderBy("step").collect()
    assert curve[0]["objective"] > curve[-1]["objective"] and sum(r["best"] for r in curve) == 1


def test_word_importance(parts, logistic):
    words = explain.word_importance(logistic.model, parts[1], "doc_id", "text", n=3, k=5)
    rows = words.collect()
    ids = {r["doc_id"] for r in rows}
    assert len(ids) == 3
    for i in ids:
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["rank"])
        assert sum(r["score"] for r in mine) == pytest.approx(1)
        assert [r["score"] for r in mine] == sorted((r["score"] for r in mine), reverse=True)
        assert sum(r["in_top"] for r in mine) == min(5, len(mine))
    told = explain.explanations(logistic.model, parts[1], "doc_id", "text", logistic.classes, n=3).collect()
    assert len(told) == 3 and all(len(r["top_words"]) <= 5 for r in told)
    short = explain.explanations(logistic.model, parts[1], "doc_id", "text", logistic.classes, n=3, excerpt=9).collect()
    assert all(t["excerpt"].startswith(r["excerpt"]) and len(r["excerpt"]) <= 9 for t, r in zip(sorted(told), sorted(short)))


@pytest.fixture(scope="module")
def last_words(spark):
    """Long texts that differ in their last word only."""
    same = " ".join(f"w{i % 50}" for i in range(3000))
    return spark.createDataFrame([(i, f"{same} {'yes' if i % 2 else 'no'}", "ab"[i % 2]) for i in range(40)], "doc_id long, text string, label string")


def test_the_last_word_of_a_long_text_counts(spark, last_words, tmp_path):
    fitted = train.fit_model("lr_unigram", last_words, "text", "label", CFG)
    told = fitted.score(last_words)
    assert told.filter("prediction != label").count() == 0
    last_words.write.parquet(str(tmp_path / "in"))
    stream = file_stream(spark, str(tmp_path / "in"), last_words.schema)
    write_stream(predict_stream(fitted.model, stream, fitted.classes), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("prediction = label").count() == 40
    words = explain.word_importance(fitted.model, last_words, "doc_id", "text", k=1)
    assert {r["word"] for r in words.filter("in_top").collect()} <= {"yes", "no"}


def test_a_table_streams_as_a_file_and_as_a_folder_of_files(spark, small, tmp_path):
    whole = load(spark, small, "documents")
    whole.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    wanted = sorted(r["doc_id"] for r in whole.select("doc_id").collect())
    for i, folder in enumerate((small, str(tmp_path))):
        stream = table_stream(spark, folder, "documents", whole.schema, files_per_batch=2).select("doc_id")
        write_stream(stream, str(tmp_path / f"o{i}"), str(tmp_path / f"c{i}")).awaitTermination()
        assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / f"o{i}")).collect()) == wanted
    told = queries()["r7_predict_stream"](spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in told.collect()) == wanted


def test_stream_counts_every_row_in_any_batching(spark, small, tmp_path):
    from textlab.streaming.scoring import distribution, distribution_stream, label_windows

    events = load(spark, small, "events")
    for i, part in enumerate(("event_id % 3 = 2", "event_id % 3 = 0", "event_id % 3 = 1")):
        events.filter(part).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    wanted = sorted(label_windows(events, "event_type", "ts").collect())
    for files in (1, 10):
        out = str(tmp_path / f"out{files}")
        for _ in range(2):
            stream = file_stream(spark, str(tmp_path / "in" / "*"), events.schema, files_per_batch=files)
            distribution_stream(stream, "event_type", "ts", out, out + "-c").awaitTermination()
        assert sorted(distribution(spark, out).collect()) == wanted


def test_saved_run_gives_the_recorded_best(spark, parts, bayes, logistic, tmp_path):
    path = str(tmp_path / "run")
    save_run(spark, SavedRun("r", "lr_bigram", "text", False, {"nb_multinomial": bayes, "lr_bigram": logistic}), path)
    best = load_run(spark, path)
    assert list(best.models) == ["lr_bigram"]
    mine = logistic.score(parts[1]).select("doc_id", "prediction")
    theirs = best.models["lr_bigram"].score(parts[1]).select("doc_id", "prediction")
    assert sorted(mine.collect()) == sorted(theirs.collect())
    assert list(load_run(spark, path, "nb_multinomial").models) == ["nb_multinomial"]
    with pytest.raises(ValueError, match="no model"):
        load_run(spark, path, "other")


def test_a_run_that_ends_half_way_is_not_there(spark, bayes, tmp_path):
    """Its files are, but no manifest; the runs saved before stay."""

    class Broken:
        classes, config, seconds = [], None, 0.0

        @property
        def model(self):
            raise RuntimeError("killed")

    path = str(tmp_path / "run")
    with pytest.raises(ValueError, match="no saved run"):
        load_run(spark, path)
    two = {"nb_multinomial": bayes, "broken": Broken()}
    with pytest.raises(RuntimeError, match="killed"):
        save_run(spark, SavedRun("half", "nb_multinomial", "text", False, two), path)
    assert saved_runs(spark, path).count() == 0
    first = SavedRun("first", "nb_multinomial", "text", False, {"nb_multinomial": bayes}, spark.range(3), 7, metrics={"nb_multinomial": {"f1": 0.5}})
    version = save_run(spark, first, path)
    with pytest.raises(RuntimeError, match="killed"):
        save_run(spark, SavedRun("half", "nb_multinomial", "text", False, two), path)
    again = load_run(spark, path)
    assert (again.name, again.seed, again.analysis.count(), again.metrics) == ("first", 7, 3, first.metrics)
    assert again.models["nb_multinomial"].config == bayes.config and again.started_at <= again.finished_at
    save_run(spark, SavedRun("second", "nb_multinomial", "text", False, {"nb_multinomial": bayes}), path)
    assert load_run(spark, path).name == "second" and load_run(spark, path, version=version).name == "first"
    assert saved_runs(spark, path).count() == 2


def test_multilabel(spark, small):
    df = multi_docs(spark, small)
    fitted = train.fit_multilabel(df, "text", "tags", CFG)
    assert fitted.classes == [r["label"] for r in labels.atomic_labels(df, "tags").orderBy("class_id").collect()]
    told = fitted.score(df.withColumn("labels", parse_labels(df, "tags")))
    assert metrics_multilabel(told).first()["f1"] > 0.8


def test_stream_equals_batch_and_restart_adds_nothing(spark, small, bayes, tmp_path):
    docs = load(spark, small, "documents")
    for name, part in (("a", "doc_id % 2 = 0"), ("b", "doc_id % 2 = 1")):
        docs.filter(part).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for _ in range(2):
        stream = file_stream(spark, str(tmp_path / "in" / "*"), docs.schema, files_per_batch=1)
        told = predict_stream(bayes.model, stream, bayes.classes).select("doc_id", "prediction")
        write_stream(told, out, checkpoint).awaitTermination()
    batch = bayes.score(docs).select("doc_id", "prediction")
    assert sorted(spark.read.parquet(out).collect()) == sorted(batch.collect())


def test_whole_run(spark, small, tmp_path):
    path = str(tmp_path / "run")
    done = run(documents(spark, small), "lang", "text", id_col="doc_id", models=["nb_multinomial", "lr_unigram"],
               use_cv=True, cv_folds=2, use_search=False, path=path)
    assert done["status"] == "success", done
    assert done["best_model_name"] in ("nb_multinomial", "lr_unigram")
    assert {r["status"] for r in done["state"].collect()} == {"completed"}
    assert done["comparison"].count() == 2 and done["cv"]["folds"].count() == 2
    assert set(done["reports"]) == {"quality", "baseline", "model", "explanation", "cross_validation"}
    saved = load_run(spark, path)
    assert saved.best == done["best_model_name"] and saved.seed == 42 and saved.analysis.count() > 0
    assert saved.metrics[saved.best]["f1"] == done["best_model_metrics"]["f1"]
    assert spark.read.json(path + "/reports/model/rows").filter("section = 'diagnosis'").count() == 1
    shown = [r[0] for r in spark.read.text(path + "/reports/model/text").collect()]
    assert shown[0] == "model of run" and shown.index("VALIDATION") < shown.index("DIAGNOSIS")


def test_run_finds_its_columns_and_merges(spark, small):
    df = documents(spark, small).select("text", "lang", (F.col("doc_id") % 3).cast("string").alias("tier_name"))
    done = run(df, "lang", auto_merge=True, models=["nb_multinomial"], use_cv=False, use_search=False)
    assert done["status"] == "success", done


def test_multilabel_run(spark, small):
    done = run(multi_docs(spark, small), "tags", "text", id_col="doc_id", min_rows=50, use_cv=False, use_search=False)
    assert done["status"] == "success", done
    assert done["best_model_metrics"]["f1"] > 0.5


def test_multilabel_run_takes_models_folds_and_path(spark, small, tmp_path):
    df, path = multi_docs(spark, small), str(tmp_path / "run")
    done = run(df, "tags", "text", id_col="doc_id", min_rows=50, use_cv=True, cv_folds=2, models=["nb_multinomial"], path=path)
    assert done["status"] == "success", done
    folds = done["cv"]["folds"].collect()
    assert [r["fold"] for r in folds] == [0, 1] and all(r["error"] is None and r["f1"] > 0 for r in folds)
    again = load_run(spark, path).models["nb_multinomial"]
    told = [sorted(m.score(df).select("doc_id", "predicted").collect()) for m in (done["best_model"], again)]
    assert again.classes == done["best_model"].classes and told[0] == told[1]


def test_failed_run_is_a_record(spark):
    done = run(spark.range(10).withColumn("y", F.lit("a")).withColumn("t", F.lit("text")), "y", "t", id_col="id")
    assert done["status"] == "failed" and "10 rows" in done["error"]
    state = {r["step"]: r["status"] for r in done["state"].collect()}
    assert state["data_validation"] == "failed" and state["model_training"] == "pending"
