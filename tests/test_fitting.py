"""Repeated fits: focal rounds, early stopping, races of settings, and contributions of words."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from textlab.operators import explain, fitting, train

CFG = train.Config(epochs=(1, 3), weight_decay=0.01, patience=2)


@pytest.fixture(scope="module")
def order_table(spark):
    """Texts whose class is told by the order of two words alone."""
    rows = [(i, f"w{i % 7} up down w{i % 5}" if i % 2 else f"w{i % 7} down up w{i % 5}", "ab"[i % 2], "val" if i % 5 == 0 else "train") for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, split string").persist()


def test_focal_rounds_reach_the_least_focal_loss(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = (x @ [1.0, -0.7] + 0.4 + rng.normal(size=300) > 0).astype(int)
    rows = [(Vectors.dense(a.tolist()), float(b), 1.0) for a, b in zip(x, y)]
    data = spark.createDataFrame(rows, ["features", "class_id", "weight"])
    cfg = replace(CFG, weight_decay=0.0, max_iter=100, use_focal_loss=True, exact_iterations=True)
    rounds = []
    train.fit_estimator("lr_unigram", data, cfg, rounds)

    def loss(b):
        p = 1 / (1 + np.exp(-(2 * y - 1) * (x @ b[:2] + b[2])))
        return np.mean((1 - p) ** 2 * -np.log(p))

    best = np.zeros(3)
    for step in (0.5, 0.1, 0.02, 0.004, 0.0008):
        moved = True
        while moved:
            near = [best + step * d for d in np.vstack([np.eye(3), -np.eye(3)])]
            least = min(near, key=loss)
            moved = loss(least) < loss(best)
            best = least if moved else best
    assert all(b < a for a, b in zip(rounds, rounds[1:])) and len(rounds) > 2
    assert rounds[-1] == pytest.approx(loss(best), rel=0.01)


def test_early_stopping_returns_the_best_step(spark, order_table):
    done = fitting.fit_early_stopped("lr_bigram", order_table, "text", "label", CFG)
    curve = done.curve(spark).orderBy("step").collect()
    assert [r["iterations"] for r in curve] == [5 * (i + 1) for i in range(len(curve))] and sum(r["best"] for r in curve) == 1
    assert all(r["train_loss"] > 0 and r["val_loss"] > 0 for r in curve)
    val = order_table.filter("split = 'val'").drop("split")
    from textlab.operators.losses import cross_entropy

    got = cross_entropy(done.trained.score(val), done.trained.classes).first()["cross_entropy"]
    assert got == pytest.approx(min(r["val_loss"] for r in curve), rel=1e-9)


def test_early_stopping_waits_for_patience(order_table, monkeypatch):
    losses = iter([1, 0.9, 1, 0.8, 1, 0.85, 1, 0.9] * 3)
    monkeypatch.setattr(fitting, "_loss", lambda *_: next(losses))
    done = fitting.fit_early_stopped("lr_unigram", order_table, "text", "label", replace(CFG, max_iter=100), step=5)
    assert len(done.steps) == 4 and done.best_step == 1


def test_rungs():
    assert fitting.rungs(8, 0.125) == [(8, 0.125), (4, 0.25), (2, 0.5), (1, 1.0)]
    assert fitting.rungs(3, 0.25) == [(3, 0.5), (2, 1.0)]
    assert fitting.rungs(1, 0.1) == [(1, 1.0)]


def test_a_race_ends_on_all_rows_and_costs_less(order_table):
    best, record = fitting.race(order_table, "text", "label", "doc_id", CFG, trials=4, least=0.25)
    assert [r["rung"] for r in record] == [0] * 4 + [1] * 2 + [2]
    assert record[-1]["share"] == 1.0 and record[-1]["weight_decay"] == best.weight_decay
    assert sum(r["share"] for r in record) < 4
    again, other = fitting.race(order_table.repartition(7), "text", "label", "doc_id", CFG, trials=4, least=0.25)
    assert again == best and [r["trial"] for r in other] == [r["trial"] for r in record]
    assert fitting.race(order_table, "text", "label", "doc_id", replace(CFG, strategy="CRITICAL"))[1] == []


@pytest.mark.parametrize("name", ["lr_unigram", "lr_bigram", "nb_multinomial"])
def test_contributions_add_up_to_the_score(order_table, name):
    rows = order_table.filter("split = 'train'")
    one = train.fit_model(name, rows, "text", "label", CFG)
    words = explain.word_scores(one.model, rows, "doc_id", "text")
    sums = {r["doc_id"]: r["s"] for r in words.groupBy("doc_id").agg(F.sum("contribution").alias("s")).collect()}
    last = one.model.stages[-1]
    # With two classes there is one margin, and one intercept, for both.
    offset = list(last.pi) if name.startswith("nb") else [-last.intercept, last.intercept]
    for r in one.model.transform(rows).select("doc_id", "prediction", "rawPrediction").collect():
        at = int(r["prediction"])
        assert sums[r["doc_id"]] == pytest.approx(r["rawPrediction"][at] - offset[at], abs=1e-6)


def test_word_order_counts_where_the_model_has_pairs(order_table):
    one = train.fit_model("lr_bigram", order_table.filter("split = 'train'"), "text", "label", CFG)
    best = explain.word_importance(one.model, order_table, "doc_id", "text", k=2).filter("in_top").collect()
    top = {}
    for r in best:
        top.setdefault(r["doc_id"], set()).add(r["word"])
    assert all(words == {"up", "down"} for words in top.values())
    plain = train.fit_model("lr_unigram", order_table.filter("split = 'train'"), "text", "label", CFG)
    shares = explain.word_scores(plain.model, order_table, "doc_id", "text").filter("word in ('up', 'down')").agg(F.max("score")).first()[0]
    assert shares < 1e-3


def test_no_term_of_a_text_is_shuffled(spark, small):
    """Texts are dealt out once; what is exchanged has as many rows as there are texts."""
    rows = spark.read.parquet(f"{small}/documents.parquet").withColumn("label", F.col("lang"))
    one = train.fit_model("lr_bigram", rows, "text", "label", CFG)
    words = explain.word_scores(one.model, rows, "doc_id", "text")
    text = words._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_a_model_beyond_the_limit_is_joined(order_table, monkeypatch):
    from textlab.operators import contributions

    one = train.fit_model("lr_bigram", order_table, "text", "label", CFG)
    sent = {(r["doc_id"], r["word"]): r["contribution"] for r in explain.word_scores(one.model, order_table, "doc_id", "text").collect()}
    monkeypatch.setattr(contributions, "SENT_WEIGHTS", 0)
    for r in explain.word_scores(one.model, order_table, "doc_id", "text").collect():
        assert r["contribution"] == pytest.approx(sent.pop((r["doc_id"], r["word"])), abs=1e-9)
    assert not sent


def test_focal_rounds_go_on_from_the_last_coefficients(order_table, monkeypatch):
    """Only the first fit takes all iterations; the loss that the rounds reach is no worse for it."""
    asked, plain = [], train.estimator

    def noted(name, cfg):
        asked.append(cfg.iterations)
        return plain(name, cfg)

    monkeypatch.setattr(train, "estimator", noted)
    cfg = replace(CFG, max_iter=20)
    one = train.fit_focal(order_table, "text", "label", 2.0, "lr_bigram", cfg)
    assert asked[0] == 20 and len(asked) > 1 and set(asked[1:]) == {train.ITERATIONS_PER_EPOCH}
    assert all(b < a for a, b in zip(one.rounds, one.rounds[1:])) and len(one.rounds) > 1


def test_a_fit_has_a_task_for_each_core(spark):
    many = spark.range(1000, numPartitions=100).repartition(64)
    few = train.by_cores(many)
    assert few.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and few.count() == 1000


def test_a_focal_round_begins_near_the_step_of_the_last(spark, order_table, monkeypatch):
    """Steps are tried two at a time, and a round does not begin again at steps that failed before."""
    assert train.step_order(0) == list(train.FOCAL_STEPS)
    assert train.step_order(3) == [0.25, 0.125, 0.5, 1.0]
    asked, plain = [], train.together

    def noted(work, items):
        asked.append(list(items))
        return plain(work, items)

    monkeypatch.setattr(train, "together", noted)
    one = train.fit_focal(order_table, "text", "label", 2.0, "lr_bigram", replace(CFG, max_iter=20))
    assert asked and all(len(a) == 2 for a in asked)
    assert all(b < a for a, b in zip(one.rounds, one.rounds[1:])) and len(one.rounds) > 1


def test_counts_lie_evenly_whatever_the_layout(spark):
    """A table of a long and a short file, with the validation rows in a third, has equal tasks and no idle one."""
    def some(start, end, split):
        text = F.concat_ws(" ", F.lit("up"), F.col("id").cast("string"))
        return spark.range(start, end, 1, 1).select(text.alias("text"), F.lit("a").alias("label"), F.lit(split).alias("split"))

    uneven = some(0, 3900, "train").union(some(3900, 4000, "train")).union(some(4000, 5000, "val"))
    with train.Features("lr_unigram", uneven, "text", ["label", "split"]) as features:
        for rows in ("true", "split = 'train'"):
            sizes = [r["count"] for r in features.held.filter(rows).groupBy(F.spark_partition_id()).count().collect()]
            assert len(sizes) == 20 and max(sizes) < 2 * min(sizes)
    assert train.dealt_out(some(0, 200, "train")).rdd.getNumPartitions() == 1


def test_a_held_table_has_small_batches(spark):
    """The serializer keeps 100 batches a task, so a batch must not be as large as Spark makes it."""
    from textlab import session

    before = spark.conf.get(session.BATCH_KEY)
    kept = session.hold(spark.range(0, 320, 1, 1).withColumn("text", F.repeat(F.lit("word "), 1000)))
    try:
        cached = spark._jsparkSession.sharedState().cacheManager().lookupCachedData(kept._jdf).get()
        assert cached.cachedRepresentation().cacheBuilder().cachedColumnBuffers().count() == 320 / session.BATCH_ROWS
        assert spark.conf.get(session.BATCH_KEY) == before and kept.count() == 320
    finally:
        kept.unpersist()


def test_a_large_table_is_fitted_one_fit_at_a_time(order_table, monkeypatch):
    """Every fit holds a copy of the counts; the models are those of fits at a time."""
    def asked_of():
        asked, plain = [], train.together

        def noted(work, items, at_a_time=train.PARALLEL_FITS):
            asked.append((at_a_time, len(items)))
            return plain(work, items, at_a_time)

        with monkeypatch.context() as m:
            m.setattr(train, "together", noted)
            done = train.fit_models(["lr_unigram", "nb_multinomial"], order_table, "text", "label", replace(CFG, use_focal_loss=True))
        assert all(one.error is None for one in done)
        return asked, done[0]

    asked, small = asked_of()
    assert asked[0] == (train.PARALLEL_FITS, 2) and all(n == 2 for _, n in asked)
    monkeypatch.setattr(train, "COPIED_A_CORE", 0)
    asked, large = asked_of()
    assert asked[0] == (1, 2) and all(n == 1 for _, n in asked[1:])
    a, b = (one.model.stages[-1].coefficientMatrix.toArray() for one in (small, large))
    assert abs(a - b).max() < 1e-6 and small.rounds == pytest.approx(large.rounds)


def _focal_rounds(spark, monkeypatch):
    """The losses of the rounds, the model, and the number of tables held, on rows that take part of a step."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 2))
    y = (x @ [1.5, -1.0] + rng.normal(size=300) > 0).astype(int)
    data = spark.createDataFrame([(Vectors.dense(a.tolist()), float(b), 1.0) for a, b in zip(x, y)], ["features", "class_id", "weight"])
    asked, kept, rounds, plain = [], [], [], train.hold
    with monkeypatch.context() as m:
        m.setattr(train, "hold", lambda df: kept.append(plain(df)) or kept[-1])
        m.setattr(train, "FOCAL_STEPS", (0.5, 0.25))
        cfg = replace(CFG, weight_decay=0.0, max_iter=50, use_focal_loss=True, exact_iterations=True, focal_rounds=4)
        last = train.fit_estimator("lr_unigram", data, cfg, rounds)
    return rounds, last.coefficientMatrix.toArray(), len(kept)


def test_focal_rounds_hold_no_copies_of_the_features(spark, monkeypatch):
    persisted = spark.sparkContext._jsc.getPersistentRDDs().size()
    rounds, sent, n = _focal_rounds(spark, monkeypatch)
    assert len(rounds) > 2 and n == 0
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= persisted
    monkeypatch.setattr(train, "SENT_NUMBERS", 0)
    again, held, n = _focal_rounds(spark, monkeypatch)
    assert n > 0 and again == pytest.approx(rounds) and abs(sent - held).max() < 1e-6
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= persisted


def test_partitions_of_many_rows_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(train, "MOST_ROWS_A_PART", 100)
    monkeypatch.setattr(train, "ROWS_A_PART", 10)
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(cores * 1000)
    assert train.dealt_out(rows).rdd.getNumPartitions() == cores * 10


def test_a_word_and_its_pair_are_hashed_in_one_call(spark, order_table):
    """A call of the hashing for each place; the weights are those of each term hashed alone, also where buckets clash."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import HashingTF, NGram
    from textlab.operators import contributions

    one = train.fit_model("lr_bigram", order_table, "text", "label", CFG).model
    places = contributions.places(one, order_table.filter("doc_id < 3"), "doc_id")
    assert places.count() == 12 and places.filter("next is null").count() == 3
    few = HashingTF(inputCol="terms", outputCol="counts", numFeatures=3)
    model = PipelineModel(stages=[NGram(n=2, inputCol="tokens", outputCol="pairs"), few])
    weights = np.array([[1.0, 10.0, 100.0], [2.0, 20.0, 200.0]])
    words = ["up", "down", "été", "ß", "東京", "x", "abcd", "abcde"]
    rows = [(i, i % 2, a, b) for i, (a, b) in enumerate((a, b) for a in words for b in [*words, None])]
    found = spark.createDataFrame(rows, "doc_id long, class_id int, word string, next string")
    got, clashes = {r["doc_id"]: r for r in contributions.place_shares(model, found, "doc_id", weights).collect()}, 0
    assert len(got) == len(rows)
    for i, at, a, b in rows:
        own, pair = few.indexOf(a), None if b is None else few.indexOf(f"{a} {b}")
        clashes += own == pair
        assert got[i]["own"] == weights[at][own] and got[i]["pair"] == (0.0 if b is None else weights[at][pair])
    assert clashes
