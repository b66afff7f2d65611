"""Model comparison, cross-validation summaries, histories and set operations.

The sources play the models: each has the metrics of its rows of the scored table, and a
latency from its text lengths.
"""

from pyspark.sql import functions as F

from textlab.catalog.inputs import SCORED_SQL, documents, hash_rank_sql, metrics_sql, per_class_sql, rounded, scored
from textlab.operators import compare as c
from textlab.operators import metrics as m
from textlab.operators import split as sp
from textlab.plans import reports
from textlab.sources.tables import load
from textlab.streaming.scoring import distribution, distribution_stream, file_stream
from textlab.session import work_path


def model_results(s, d, single=True):
    df = scored(s, d)
    speed = documents(s, d).groupBy("source").agg((F.avg("n_chars") / 100).alias("batch_ms"), (F.avg("n_chars") / 40).alias("one_ms"))
    shown = F.col("one_ms") if single else F.when(F.col("model") != "src3", F.col("one_ms"))
    joined = m.metrics(df, by="source").join(speed, "source").withColumnRenamed("source", "model")
    return joined.withColumn("single_ms", shown).drop("one_ms", "n_rows")


def results_sql(single: str) -> str:
    return f"""{SCORED_SQL}, {per_class_sql('scored', 'source')}, q as ({metrics_sql('source')}),
  sp as (select source, avg(n_chars) / 100 as batch_ms, avg(n_chars) / 40 as one_ms from documents group by 1),
  res as (select q.source as model, f1, accuracy, precision, recall, batch_ms, {single} as single_ms from q join sp using (source)),
  lat as (select *, case when (select count(*) = count(single_ms) from res) then single_ms else batch_ms end as latency_ms from res),
  comp as (select *, cast(0.7 as double) * f1 + cast(0.3 as double) * (1 / (1 + latency_ms / greatest((select median(latency_ms) from lat), 1))) as composite from lat)"""


SINGLE, MISSING = "one_ms", "case when source <> 'src3' then one_ms end"
ROUNDED = ", ".join(f"round({x}, 6) as {x}" for x in ("f1", "accuracy", "precision", "recall", "batch_ms", "single_ms", "latency_ms", "composite"))
COMPARED = f"select model, {ROUNDED}, cast(row_number() over (order by composite desc, model) as integer) as rank from comp"


def e9(s, d):
    return rounded(c.comparison_table(c.compare_models(model_results(s, d, single=False))))


def j5(s, d):
    """Evaluations of all candidates with their training records."""
    trainings = load(s, d, "documents").groupBy(F.col("source").alias("model")).agg(F.count(F.lit(1)).alias("n_train"))
    judged = c.compare_models(model_results(s, d))
    return rounded(c.attach_training(judged.select("model", "f1", "composite"), trainings))


def folds(s, d):
    """Metrics of the scored table per stratified fold."""
    told = sp.stratified_folds(scored(s, d), "label", "id", 5)
    sums = m.metrics(told, by="fold")
    others = sums.agg(F.sum("n_rows")).scalar() - F.col("n_rows")
    return sums.select("fold", *m.METRICS, others.alias("n_train"), F.col("n_rows").alias("n_val"), F.lit(None).cast("string").alias("error"))


FOLDS_SQL = f"""{SCORED_SQL}, fo as (select id, label, prediction, cast((rnk - 1) * 5 // n_c as integer) as fold from {hash_rank_sql('scored', 'id', 'label')}),
  {per_class_sql('fo', 'fold')}, q as ({metrics_sql('fold')}),
  long as (select fold, unnest(['f1', 'accuracy', 'precision', 'recall']) as metric, unnest([f1, accuracy, precision, recall]) as v from q),
  summary as (select metric, count(*) as n_folds, round_even(avg(v), 4) as mean, round_even(stddev_pop(v), 4) as std,
    round_even(min(v), 4) as min, round_even(max(v), 4) as max from long group by metric)"""


def e15(s, d):
    return c.cv_summary(folds(s, d))


def e16(s, d):
    return rounded(c.cv_verdict(c.cv_summary(folds(s, d)), m.metrics(scored(s, d)).select("f1")))


def runs(s, d):
    """One finished run per user: its last purchase."""
    bought = load(s, d, "events").filter("event_type = 'purchase'")
    last = bought.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("e"))
    return last.select(
        F.date_format("e.ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), F.col("user_id").alias("run"),
        F.concat(F.lit("m"), (F.col("e.event_id") % 5).cast("string")).alias("best_model"),
        (F.col("e.value") / 1000).alias("f1"), (F.col("e.value") / 900).alias("accuracy"),
    )


def cv_report(s, d):
    table = folds(s, d)
    return reports.cv_report(table, c.cv_summary(table))


def u2(s, d):
    """Rows that the repair moves to train, as the union of the parts."""
    df = documents(s, d).select("doc_id", "lang")
    part = F.when(F.col("lang") == "es", "val").otherwise(F.when(F.col("doc_id") % 4 == 0, "val").otherwise("train"))
    repaired = sp.repair_split(df.withColumn("split", part), "lang", "doc_id")
    train = repaired.filter("split = 'train'").select("doc_id", F.lit("train").alias("part"))
    return train.unionByName(repaired.filter("split = 'val'").select("doc_id", F.lit("val").alias("part")))


def r8(s, d):
    """Events per type and day, read as a stream."""
    schema = load(s, d, "events").schema
    epoch = "timestamp_ntz '1970-01-01 00:00:00'"
    utc = F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, {epoch}, cast(ts as timestamp_ntz)))")
    stream = file_stream(s, d, schema, "events.parquet").select("event_type", utc.alias("ts"))
    path = work_path(s, "distribution")
    distribution_stream(stream, "event_type", "ts", path, path + "-checkpoint").awaitTermination()
    local = "date_format(timestampadd(MICROSECOND, unix_micros({0}), {1}), 'yyyy-MM-dd HH:mm') as {0}"
    day = [F.expr(local.format(x, epoch)) for x in ("window_start", "window_end")]
    return distribution(s, path).select(*day, "label", "n")


QUERIES = {
    "e8_compare_models": (
        lambda s, d: rounded(c.compare_models(model_results(s, d))),
        f"with {results_sql(SINGLE)} {COMPARED}",
    ),
    "e8_compare_models_batch": (
        lambda s, d: rounded(c.compare_models(model_results(s, d, single=False))),
        f"with {results_sql(MISSING)} {COMPARED}",
    ),
    "e9_comparison_table": (
        e9,
        f"""with {results_sql(MISSING)} select model as "Model", round(f1, 6) as "F1 Score", round(accuracy, 6) as "Accuracy",
          round(precision, 6) as "Precision", round(recall, 6) as "Recall", round(batch_ms, 6) as "Batch Latency (ms)",
          round(coalesce(single_ms, batch_ms), 6) as "Single-Sample Latency (ms)", round(composite, 6) as "Composite Score" from comp""",
    ),
    "j5_attach_training": (
        j5,
        f"""with {results_sql(SINGLE)},
          tr as (select source as model, count(*) as n_train from documents group by 1)
        select model, round(f1, 6) as f1, round(composite, 6) as composite, n_train from comp left join tr using (model)""",
    ),
    "e15_cv_summary": (e15, f"with {FOLDS_SQL} select * from summary"),
    "e16_cv_verdict": (
        e16,
        f"""with {FOLDS_SQL}, o as (select class, cast(sum(tp) as bigint) as tp, cast(sum(support) as bigint) as s, cast(sum(predicted) as bigint) as p
            from per_class group by 1), z as (select sum(2 * tp / (s + p) * s) / sum(s) as f from o),
          x as (select mean, std, f from summary, z where metric = 'f1')
        select mean, std, round(f, 6) as single_f1,
          case when std <= 0.01 then 'stable' when std <= 0.03 then 'reasonably stable' else 'high variance' end as stability,
          case when abs(f - mean) <= 0.02 then 'representative' when f - mean > 0.02 then 'lucky' else 'conservative' end as single_split from x""",
    ),
    "e17_run_history": (
        lambda s, d: rounded(c.run_history(runs(s, d))),
        """select strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as timestamp, user_id as run,
          'm' || (arg_max(event_id, (ts, event_id)) % 5) as best_model, round(arg_max(value, (ts, event_id)) / 1000, 6) as f1,
          round(arg_max(value, (ts, event_id)) / 900, 6) as accuracy from events where event_type = 'purchase' group by user_id""",
    ),
    "k4_cv_report": (
        cv_report,
        f"""with {FOLDS_SQL} select 'folds' as section, 1 as ord, 'folds' as key, count(*)::varchar as value from q
        union all select 'folds', 2, 'successful', count(f1)::varchar from q
        union all select 'summary', row_number() over (order by metric), metric,
          printf('%.4f ± %.4f (%.4f to %.4f)', mean, std, min, max) from summary
        union all select 'per fold', fold + 1, fold::varchar,
          printf('%d %d %.4f %.4f', (select sum(n_rows) from q)::bigint - n_rows, n_rows, f1, accuracy) from q""",
    ),
    "u2_repaired_union": (
        u2,
        f"""with t as (select doc_id, lang, rnk, n_c, case when lang = 'es' or doc_id % 4 = 0 then 'val' else 'train' end as s0
          from {hash_rank_sql('documents', 'doc_id', 'lang')})
        select doc_id, case when lang = 'es' and rnk = n_c then 'train' else s0 end as part from t""",
    ),
    "r8_distribution_stream": (
        r8,
        """with w as (select date_trunc('day', ts) as day, event_type as label, count(*) as n from events group by 1, 2)
        select strftime(day, '%Y-%m-%d %H:%M') as window_start, strftime(day + interval 1 day, '%Y-%m-%d %H:%M') as window_end, label, n
        from w""",
    ),
}
