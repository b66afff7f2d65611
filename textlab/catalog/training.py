"""Queries that fit models. Their results are checked by row counts and by tests."""

from collections import Counter

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from textlab.catalog.inputs import MULTI_SQL, documents, labeled, multi_docs
from textlab.operators import explain, fitting, train
from textlab.operators import split as sp
from textlab.operators.labelbayes import fit_label_bayes
from textlab.operators.losses import cross_entropy, focal_loss
from textlab.operators.metrics import metrics, metrics_multilabel
from textlab.functions.labels import parse_labels
from textlab.operators.validate import clean
from textlab.plans.run import run
from textlab.session import work_path, written
from textlab.sources.runs import SavedRun, load_run, save_run
from textlab.sources.tables import load
from textlab.streaming.scoring import predict_stream, table_stream, write_stream

FAST = train.Config(epochs=(2, 4), weight_decay=0.01, decay_bounds=(0.0, 0.02))


def _cleaned(df, label):
    """The cleaned table, written once: every fit reads it several times."""
    return written(clean(df, label, "text", "doc_id"), "cleaned")


def _split(s, d, label="lang"):
    """The cleaned documents with their ``split`` and ``label``."""
    df = _cleaned(documents(s, d), label)
    return sp.stratified_split(df, label, "doc_id", ratio=0.2).withColumn("label", F.col(label))


def _parts(s, d, label="lang"):
    """Training and validation part of the cleaned documents."""
    parts = _split(s, d, label)
    return [parts.filter(F.col("split") == p) for p in ("train", "val")]


def _fitted(s, d, name="lr_unigram", cfg=FAST):
    fit, val = _parts(s, d)
    return train.fit_model(name, fit, "text", "label", cfg), val


def t1(s, d):
    """All candidates on the cleaned documents, with their validation metrics."""
    fit, val = _parts(s, d)
    fitted = train.fit_models(list(train.CANDIDATES), fit, "text", "label", FAST)
    told = metrics(train.predictions(fitted, val.select("text", "label"), "text"), "model")
    names = s.createDataFrame([(one.name,) for one in fitted], "model string")
    return names.join(told, "model", "left").select(*[c for c in told.columns if c != "model"], "model")


def t2(s, d):
    """Weighted training on the unbalanced quality label."""
    df = _cleaned(labeled(s, d), "quality").withColumn("label", F.col("quality").cast("string"))
    parts = sp.stratified_split(df, "label", "doc_id", ratio=0.2)
    weighted = train.Config(epochs=(2, 4), weight_decay=0.01, use_class_weights=True)
    one = train.fit_model("lr_unigram", parts.filter("split = 'train'"), "text", "label", weighted)
    return metrics(one.score(parts.filter("split = 'val'")))


def t5(s, d):
    fit, val = _parts(s, d)
    return metrics(train.fit_focal(fit, "text", "label", 2.0, cfg=FAST).score(val))


def t6(s, d):
    df = _cleaned(multi_docs(s, d), "tags")
    parts = sp.random_split(df, "doc_id", ratio=0.2)
    fitted = train.fit_multilabel(parts.filter("split = 'train'"), "text", "tags", FAST)
    val = parts.filter("split = 'val'")
    return metrics_multilabel(fitted.score(val.withColumn("labels", parse_labels(val, "tags"))))


def t6_bayes(s, d):
    """All labels of all documents from one count of labels and terms."""
    df = multi_docs(s, d)
    model = fit_label_bayes(df, "text", "tags")
    return model.score(df, "text", "doc_id").select("doc_id", F.array_join("predicted", ",").alias("predicted"))


#: The same for every document and label, densely.
T6_BAYES_SQL = rf"""with {MULTI_SQL},
r as materialized (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') as ts,
  list_distinct(list_filter(list_transform(regexp_split_to_array(tags, '[,|]'), lambda x: trim(x)), lambda x: x <> '')) as ls from multi),
t as materialized (select doc_id, unnest(ts) as term from r),
l as materialized (select doc_id, unnest(ls) as label from r),
f as (select term, count(*) as f from t group by term),
c as (select label, term, count(*) as c from t join l using (doc_id) group by all),
g as (select (select count(*) from multi) as n, (select count(*) from t) as n_terms, (select count(*) from f) as v),
k as (select label, count(*) as n1, sum(len(ts)) as t1 from l join r using (doc_id) group by label),
w as (select *, least(greatest(n - n1, 1) / greatest(n1, 1), 50) as w from k, g),
m as (select label, w, ln(w * n1 + 1) - ln(n - n1 + 1) as prior, ln(n_terms - t1 + v) - ln(w * t1 + v) as shift from w),
lifts as (select label, term, ln(w * c + 1) - ln(f - c + 1) + ln(f + 1) as lift from c join f using (term) join m using (label)),
met as (select doc_id, label, sum(lift) as lift from t join lifts using (term) group by all),
shared as (select doc_id, count(*) as n_terms, sum(-ln(f + 1)) as lift from t join f using (term) group by doc_id),
told as (select r.doc_id, m.label from r cross join m left join met on met.doc_id = r.doc_id and met.label = m.label
  left join shared on shared.doc_id = r.doc_id
  where prior + coalesce(shared.n_terms, 0) * shift + coalesce(shared.lift, 0) + coalesce(met.lift, 0) >= 0)
select r.doc_id, coalesce(string_agg(label, ',' order by label), '') as predicted from r left join told on told.doc_id = r.doc_id
group by r.doc_id"""


def t9(s, d):
    """Trials of the search on the proxy sample of the training part."""
    fit, _ = _parts(s, d)
    proxy = sp.proxy_sample(fit.drop("split"), "label", "doc_id")
    _, record = train.search(proxy, "text", "label", FAST, trials=3)
    rows = [(r["trial"], r["weight_decay"], r["elastic_net"], r["max_iter"], r["f1"], r["error"]) for r in record]
    return s.createDataFrame(rows, "trial int, weight_decay double, elastic_net double, max_iter int, f1 double, error string")


def t10(s, d):
    one, _ = _fitted(s, d)
    return train.training_curve(s, one)


def e14(s, d):
    df = _cleaned(documents(s, d), "lang")
    return train.cross_validate(sp.stratified_folds(df, "lang", "doc_id", 3), "text", "lang", "nb_multinomial", FAST)


def e14_multi(s, d):
    df = _cleaned(multi_docs(s, d), "tags")
    return train.cross_validate_multilabel(sp.random_folds(df, "doc_id", 3), "text", "tags", "nb_multinomial", FAST)


RACE_TRIALS = 4


def t9_race(s, d):
    """The rungs of a race of settings on all documents: its fits and the rows they see."""
    val = F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train")
    parts = written(documents(s, d).select("doc_id", "text", "lang", val.alias("split")), "parts")
    best, record = fitting.race(parts, "text", "lang", "doc_id", FAST, trials=RACE_TRIALS, least=0.25)
    last = max(r["rung"] for r in record)
    won = next(r for r in record if r["rung"] == last and r["weight_decay"] == best.weight_decay)
    fits = Counter(r["share"] for r in record if r["error"] is None)
    rungs = F.array(*[F.struct(F.lit(share).alias("share"), F.lit(n).cast("long").alias("n_fits")) for share, n in fits.items()])
    seen = parts.select("split", fitting.hash_share("doc_id", FAST.seed).alias("h"))
    counts = [F.count_if((F.col("split") == p) & (F.col("h") < F.col("share"))).alias(f"n_{p}") for p in ("train", "val")]
    every = seen.select("split", "h", F.inline(rungs)).filter(F.col("h") < F.col("share"))
    return every.groupBy("share", "n_fits").agg(*counts).withColumn("best_is_last", F.lit(won["f1"] is not None and last == 2))


RACE_SQL = """with p as (select doc_id, cast(cast('0x' || substr(md5('42:' || doc_id), 1, 8) as bigint) as double) / 4294967296 as h from documents),
  r as (select cast(unnest([0.25, 0.5, 1.0]) as double) as share, cast(unnest([4, 2, 1]) as bigint) as n_fits)
select share, n_fits, count(case when doc_id % 5 <> 0 then 1 end) as n_train, count(case when doc_id % 5 = 0 then 1 end) as n_val, true as best_is_last
from r join p on p.h < r.share group by all"""


def t5_rounds(s, d):
    """Focal training by rounds: no round raises the loss, and the first is that of the plain fit."""
    fit, val = _parts(s, d)
    one = train.fit_focal(fit, "text", "label", 2.0, cfg=FAST)
    falls = all(b < a for a, b in zip(one.rounds, one.rounds[1:]))
    told = focal_loss(one.score(fit), one.classes, 2.0).select("n_rows", F.col("focal_loss").alias("_l"))
    near = F.abs(F.col("_l") - F.lit(one.rounds[-1])) <= 1e-6 * F.lit(one.rounds[-1])
    return told.select(F.lit(falls and len(one.rounds) > 1).alias("falls"), near.alias("last_is_the_model"))


def t10_early(s, d):
    """The validation curve of early stopping: its steps, and whether the best has the least loss."""
    parts = _split(s, d).select("text", "label", "split")
    val = parts.filter("split = 'val'")
    done = fitting.fit_early_stopped("lr_unigram", parts, "text", "label", FAST)
    curve = done.curve(s)
    facts = curve.agg(
        F.min("val_loss").alias("least"), F.min(F.when(F.col("best"), F.col("val_loss"))).alias("best"), F.count_if("best").alias("n_best")
    ).withColumn("_model", cross_entropy(done.trained.score(val), done.trained.classes).select("cross_entropy").scalar())
    same = F.abs(F.col("_model") - F.col("best")) <= 1e-9
    return facts.select((F.col("least") == F.col("best")).alias("best_is_least"), same.alias("best_is_returned"), "n_best")


def x1_facts(s, d):
    """What the words of all documents add: shares that sum to 1, and the score without intercept."""
    fit, _ = _parts(s, d)
    one = train.fit_model("lr_bigram", fit, "text", "label", FAST)
    docs = documents(s, d).select("doc_id", "text")
    words = explain.word_scores(one.model, docs, "doc_id", "text")
    sums = words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), F.sum("contribution").alias("sum"))
    scored = one.model.transform(docs).select("doc_id", "prediction", vector_to_array("rawPrediction").alias("raw"))
    offsets = F.array(*[F.lit(float(v)) for v in one.model.stages[-1].interceptVector])
    at = F.col("prediction").cast("int")
    both = scored.join(sums, "doc_id")
    return both.select("doc_id", "n_words", (F.abs(F.get("raw", at) - F.get(offsets, at) - F.col("sum")) < 1e-6).alias("adds_up"))


X1_SQL = r"""select doc_id, count(distinct t) as n_words, true as adds_up
from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as t from documents) group by doc_id"""


def x1(s, d):
    one, val = _fitted(s, d)
    return explain.word_importance(one.model, val, "doc_id", "text").select("doc_id", "rank", "word", "score", "in_top")


def x1_rows(s, d):
    one, val = _fitted(s, d)
    told = explain.explanations(one.model, val, "doc_id", "text", one.classes)
    return told.select("doc_id", "predicted", "actual", "correct", F.to_json("top_words").alias("top_words"))


def r1(s, d):
    one, _ = _fitted(s, d)
    told = one.score(documents(s, d).select("doc_id", "text"))
    return told.select("doc_id", "prediction", F.array_max("p").alias("confidence"))


def k3(s, d):
    """A model saved with its run, loaded again and applied."""
    one, val = _fitted(s, d, "nb_multinomial")
    path = work_path(s, "run")
    save_run(s, SavedRun("documents", one.name, "text", False, {one.name: one}), path)
    again = load_run(s, path).models[one.name]
    return metrics(again.score(val))


def k3_multi(s, d):
    """Multi-label models saved with their run, loaded again and applied."""
    df = _cleaned(multi_docs(s, d), "tags")
    parts = sp.random_split(df, "doc_id", ratio=0.2)
    one = train.fit_multilabel(parts.filter("split = 'train'"), "text", "tags", FAST, "nb_multinomial")
    path = work_path(s, "run")
    save_run(s, SavedRun("documents", one.name, "text", True, {one.name: one}), path)
    val = parts.filter("split = 'val'")
    again = load_run(s, path).models[one.name]
    return metrics_multilabel(again.score(val.withColumn("labels", parse_labels(val, "tags"))))


def r7(s, d):
    """Documents scored as they arrive; the rows are those of the batch scoring."""
    one, _ = _fitted(s, d, "nb_multinomial")
    schema = load(s, d, "documents").schema
    stream = table_stream(s, d, "documents", schema).select("doc_id", "text")
    told = predict_stream(one.model, stream, one.classes).select("doc_id", "prediction")
    path = work_path(s, "scored")
    write_stream(told, path, path + "-checkpoint").awaitTermination()
    return s.read.schema(told.schema).parquet(path)


def g2(s, d):
    """A whole run on the documents, its steps as rows."""
    done = run(documents(s, d), "lang", "text", id_col="doc_id", name="documents", use_cv=False, use_search=False,
               models=["nb_multinomial"])
    if done["status"] != "success":
        raise RuntimeError(done["error"])
    return done["state"].select("run", "step_no", "step", "status")


def g2_result(s, d):
    done = run(documents(s, d), "lang", "text", id_col="doc_id", name="documents", use_cv=False, use_search=False,
               models=["nb_multinomial", "lr_unigram"])
    if done["status"] != "success":
        raise RuntimeError(done["error"])
    return done["comparison_table"]


G2_SQL = """select 'documents' as run, cast(i as integer) as step_no, ['data_validation', 'data_intelligence', 'data_preparation',
  'model_training', 'model_evaluation', 'best_model_selection', 'report_generation'][i] as step, 'completed' as status
from (select unnest(range(1, 8)) as i where (select count(*) from documents) >= 100)"""

QUERIES = {
    "t1_t8_fit_models": (t1, None),
    "t2_class_weighted_fit": (t2, None),
    "t5_focal_fit": (t5, None),
    "t6_multilabel_fit": (t6, None),
    "t6_multilabel_bayes": (t6_bayes, T6_BAYES_SQL),
    "t9_search": (t9, None),
    "t9_race": (t9_race, RACE_SQL),
    "t5_focal_rounds": (t5_rounds, "select count(*) > 0 as falls, true as last_is_the_model from documents"),
    "t10_training_curve": (t10, None),
    "t10_early_stopping": (
        t10_early,
        "select count(*) > 0 as best_is_least, true as best_is_returned, cast(1 as bigint) as n_best from documents",
    ),
    "x1_contributions": (x1_facts, X1_SQL),
    "e14_cross_validate": (e14, None),
    "e14_cross_validate_multilabel": (e14_multi, None),
    "x1_word_importance": (x1, None),
    "x1_explanations": (x1_rows, None),
    "r1_predict": (r1, None),
    "k3_saved_run": (k3, None),
    "k3_saved_multilabel_run": (k3_multi, None),
    "r7_predict_stream": (r7, None),
    "g2_run_steps": (g2, G2_SQL),
    "g2_run_comparison": (g2_result, None),
}
