"""Label analytics, text lengths and the decisions drawn from them."""

from pyspark.sql import functions as F

from textlab.catalog.inputs import ATOMS_SQL, MULTI_SQL, documents, hash_rank_sql, labeled, multi_docs, rounded, tokens_sql
from textlab.operators import labels as o
from textlab.operators.classes import label_sets
from textlab.operators.ranks import sample_n
from textlab.operators.split import stratified_split
from textlab.plans import analysis as a
from textlab.plans.rules import val_split
from textlab.sources.tables import load

LANG_COUNTS = "c as (select source, lang as label, count(*) as n from documents group by 1, 2)"
ATOM_COUNTS = f"{ATOMS_SQL}, c as (select label, count(*) as n from atoms group by 1), r as (select count(*) as n_rows from multi)"

VAL_SPLIT_SQL = """case when n_rows < 200 then cast(0.15 as double)
  when n_rows > 25000 then greatest(cast(0.05 as double), cast(5000 as double) / n_rows) else cast(0.2 as double) end"""

MODELS_SQL = """case when n_rows < 2000 then ['nb_multinomial', 'nb_complement', 'lr_unigram']
  when n_rows < 10000 then ['nb_complement', 'lr_unigram', 'lr_bigram', 'lr_bigram_large']
  else ['lr_unigram', 'lr_bigram', 'lr_bigram_large'] end"""


def pick(crit, small, moderate, good) -> str:
    def lit(x):
        return f"'{x}'" if isinstance(x, str) else f"cast({x} as double)" if isinstance(x, float) else str(x).lower()

    return (
        f"case when rows_per_class < 50 then {lit(crit)} when rows_per_class < 200 then {lit(small)}"
        f" when rows_per_class < 500 then {lit(moderate)} else {lit(good)} end"
    )


CONFIG_SQL = f"""{pick('CRITICAL', 'SMALL', 'MODERATE', 'GOOD')} as strategy,
  {pick(15, 10, 8, 5)} as epochs_min, {pick(20, 15, 12, 8)} as epochs_max, {pick(4, 8, 16, 32)} as batch_size,
  {pick(5e-4, 2e-4, 1e-4, 1e-4)} as learning_rate, {pick(2e-4, 1e-4, 5e-5, 1e-5)} as lr_min, {pick(5e-4, 5e-4, 2e-4, 1e-4)} as lr_max,
  cast(case when imbalance_ratio > 20 then 0.03 when imbalance_ratio > 10 then 0.02 when imbalance_ratio > 5 then 0.01 else 0 end as double) as weight_decay,
  {pick(0.01, 0.005, 0.0, 0.0)} as decay_min, {pick(0.04, 0.03, 0.02, 0.02)} as decay_max,
  cast(0.06 as double) as warmup_ratio, {pick(0.5, 0.75, 1.0, 1.0)} as grad_clip,
  case when imbalance_ratio > 10 then greatest({pick(7, 6, 4, 3)} + 2, 5) else {pick(7, 6, 4, 3)} end as patience,
  {pick('cosine', 'cosine', 'linear', 'linear')} as schedule, {pick(0.2, 0.15, 0.1, 0.0)} as dropout,
  cast(case when imbalance_ratio > 20 then 4 when imbalance_ratio > 10 then 3 else 2 end as double) as focal_gamma,
  cast(0 as double) as label_smoothing"""


def lengths_sql(mode: str) -> str:
    """CTE ``lens`` per source."""
    size = tokens_sql("text") if mode == "token" else "length(text)"
    clamp = "greatest(least({}, 512), 16)"
    if mode == "token":
        raw, top, longest = "p95", "least(p99, 512)", clamp.format("p95")
    else:
        longest, top = clamp.format("p95 // 4"), clamp.format("p99 // 4")
        raw = longest
    return f"""sizes as (select source, {size} as size, length(text) as chars from documents),
  pct as (select source, count(*) as n_rows, avg(size) as avg_length, min(size) as min_length,
    cast(floor(round(quantile_cont(size, 0.95), 6)) as bigint) as p95, cast(floor(round(quantile_cont(size, 0.99), 6)) as bigint) as p99,
    avg(case when size > 512 then 1.0 else 0.0 end) as share_over, avg(chars) as avg_chars from sizes group by source),
  lens as (select source, n_rows, avg_length, min_length, {raw} as p95_raw, {top} as p99_length, {longest} as max_length,
    cast(share_over as double) as share_over, avg_chars from pct)"""


LENGTH_COLUMNS = """source, n_rows, round(avg_length, 6) as avg_length, min_length, p95_raw, p99_length, max_length,
  round(share_over, 6) as share_over, round(avg_chars, 6) as avg_chars"""

FACTS_SQL = f"""{LANG_COUNTS}, k as (select source, count(*) as num_classes, cast(sum(n) as bigint) as label_count,
    max(n) as max_class, min(n) as min_class, avg(n) as mean_class, stddev_pop(n) as std_class from c group by source),
  {lengths_sql('token')}, facts as (select k.*, lens.* exclude (source),
    case when num_classes = 2 then 'binary' else 'multiclass' end as task_type, 'categorical' as label_type,
    std_class / mean_class as class_variation, n_rows / num_classes as rows_per_class, label_count / num_classes as labels_per_class,
    max_class / min_class as imbalance_ratio, min_class / n_rows as minority_share,
    max_class / min_class > 2 as use_class_weights, max_class / min_class > 5 as use_focal_loss
  from k join lens using (source))"""

RECOMMEND_SQL = f"""rec as (select *, {VAL_SPLIT_SQL} as val_share, cast(floor(n_rows * {VAL_SPLIT_SQL}) as bigint) as val_rows from conf),
  told as (select *, val_rows < 120 or imbalance_ratio > 5 as use_cv, 5 as cv_folds,
    case when val_rows < 60 then printf('%d rows leave only %d to validate on', n_rows, val_rows)
      when val_rows < 120 and imbalance_ratio > 5 then printf('%d validation rows, largest class %d, smallest %d', val_rows, max_class, min_class)
      when val_rows < 120 then printf('%d validation rows are few', val_rows)
      when imbalance_ratio > 5 then printf('classes are uneven: largest class %d, smallest %d', max_class, min_class)
      when n_rows > 5000 then printf('%d validation rows are reliable', val_rows)
      else printf('%d validation rows are adequate', val_rows) end as cv_reason,
    {pick(False, False, True, True)} as use_search, {pick(3, 5, 8, 10)} as search_trials,
    printf('%d labels in %d classes, tier %s', label_count, num_classes, strategy) as search_reason from rec)"""

ANALYSIS_SQL = f"""{FACTS_SQL}, conf as (select *, {MODELS_SQL} as models, {CONFIG_SQL} from facts), {RECOMMEND_SQL}"""

FLAT = [
    "n_rows", "task_type", "label_type", "num_classes", "label_count", "max_class", "min_class", "use_class_weights",
    "use_focal_loss", "min_length", "p95_raw", "p99_length", "max_length", "strategy", "epochs_min", "epochs_max",
    "batch_size", "patience", "schedule", "val_rows", "use_cv", "cv_folds", "cv_reason", "use_search", "search_trials",
    "search_reason",
]
FLAT_DOUBLES = [
    "class_variation", "rows_per_class", "labels_per_class", "imbalance_ratio", "minority_share", "avg_length",
    "share_over", "avg_chars", "learning_rate", "lr_min", "lr_max", "weight_decay", "decay_min", "decay_max",
    "warmup_ratio", "grad_clip", "dropout", "focal_gamma", "label_smoothing", "val_share",
]


def analysis_flat(s, d):
    table = a.analyze(documents(s, d), "lang", "text", by="source")
    return rounded(table.select("source", F.array_join("models", ",").alias("models"), *FLAT, *FLAT_DOUBLES))


def a14(s, d):
    sizes = documents(s, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows"))
    table = a.select_models(sizes)
    return table.select("lang", "n_rows", F.array_join("models", ",").alias("models"),
                        F.array_join("oversized_models", ",").alias("oversized"))


def a15(s, d):
    df = load(s, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"), "l_returnflag")
    table = o.imbalance(df, "l_returnflag", by="day")
    sizes = o.samples_per_class(df, "l_returnflag", by="day")
    told = a.training_config(table.join(sizes, "day"))
    return rounded(told.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "strategy", "epochs_min", "epochs_max", "batch_size",
                               "learning_rate", "weight_decay", "patience", "schedule", "dropout", "focal_gamma"))


def a13(s, d):
    sizes = load(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n_rows"))
    return rounded(sizes.withColumn("val_share", val_split(F.col("n_rows"))))


def a6(s, d):
    parts = stratified_split(documents(s, d).select("doc_id", "lang"), "lang", "doc_id", ratio=0.2)
    return rounded(o.class_weights(parts.filter("split = 'train'"), "lang"))


def a18(s, d):
    log = a.decision_log(a.analyze(documents(s, d), "lang", "text", by="source"), by="source")
    return log.select("source", "decision_no", "category", "decision", F.array_join("alternatives", "|").alias("alternatives"))


def k2(s, d):
    log = a.decision_log(a.analyze(documents(s, d), "lang", "text"))
    return log.select("decision_no", "category", "decision", "reason")


WEIGHTS_SQL = """w as (select {g}label, n, sum(n) over ({p}) / (count(*) over ({p}) * n) as w from c)
  select {g}label, n, round(w / max(w) over ({p}), 6) as weight from w"""


def imbalance_sql(rows: str, focal: str) -> str:
    return f"""max(n) as max_class, min(n) as min_class, round(max(n) / min(n), 6) as imbalance_ratio,
      round(min(n) / {rows}, 6) as minority_share, max(n) / min(n) > 2 as use_class_weights, {focal} as use_focal_loss"""


SPLIT_RANKS = f"""q as (select lang, count(*) as n_c, ceil(cast(0.2 as double) * (select count(*) from documents)) as nv,
    (select count(*) from documents) as n from documents group by lang),
  f as (select *, nv * n_c / n as x, floor(nv * n_c / n) as fl from q),
  g as (select *, fl + case when row_number() over (order by x - fl desc, lang) <= nv - sum(fl) over () then 1 else 0 end as quota from f)"""

QUERIES = {
    "a1_class_distribution": (
        lambda s, d: rounded(o.class_distribution(documents(s, d), "lang", by="source")),
        f"with {LANG_COUNTS} select source, label, n, round(n / sum(n) over (partition by source), 6) as share from c",
    ),
    "a1_class_distribution_all": (
        lambda s, d: rounded(o.class_distribution(documents(s, d), "lang")),
        "select lang as label, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from documents group by lang",
    ),
    "a2_label_frequencies": (
        lambda s, d: rounded(o.label_frequencies(multi_docs(s, d), "tags")),
        f"with {ATOM_COUNTS} select label, n, round(n / n_rows, 6) as prevalence from c, r",
    ),
    "a3_detect_task": (
        lambda s, d: o.detect_task(documents(s, d), "lang", by="source"),
        f"""with {LANG_COUNTS} select source, case when count(*) = 2 then 'binary' else 'multiclass' end as task_type,
          'categorical' as label_type, count(*) as num_classes, cast(sum(n) as bigint) as label_count from c group by source""",
    ),
    "a3_detect_task_numeric": (
        lambda s, d: o.detect_task(labeled(s, d), "quality", by="lang"),
        """select d.lang, case when count(distinct quality) = 2 then 'binary' else 'multiclass' end as task_type,
          case when bool_and(try_cast(cast(quality as varchar) as double) is not null) then 'numeric' else 'categorical' end as label_type,
          count(distinct quality) as num_classes, count(*) as label_count from documents d join labels using (doc_id) group by d.lang""",
    ),
    "a3_detect_task_multi": (
        lambda s, d: o.detect_task(multi_docs(s, d), "tags", multi_label=True),
        f"""with {ATOM_COUNTS} select 'multi_label' as task_type, 'categorical' as label_type, count(*) as num_classes,
          cast(sum(n) as bigint) as label_count from c""",
    ),
    "a4_imbalance": (
        lambda s, d: rounded(o.imbalance(documents(s, d), "lang", by="source")),
        f"with {LANG_COUNTS} select source, {imbalance_sql('sum(n)', 'max(n) / min(n) > 5')} from c group by source",
    ),
    "a4_imbalance_multi": (
        lambda s, d: rounded(o.imbalance(multi_docs(s, d), "tags", multi_label=True)),
        f"with {ATOM_COUNTS} select {imbalance_sql('max(n_rows)', 'false')} from c, r",
    ),
    "a5_class_weights": (
        lambda s, d: rounded(o.class_weights(documents(s, d), "lang", by="source")),
        f"with {LANG_COUNTS}, {WEIGHTS_SQL.format(g='source, ', p='partition by source')}",
    ),
    "a6_train_weights": (
        a6,
        f"""with {SPLIT_RANKS}, c as (select t.lang as label, count(*) as n
            from {hash_rank_sql('documents', 'doc_id', 'lang')} t join g using (lang) where rnk <= t.n_c - quota group by 1),
          {WEIGHTS_SQL.format(g='', p='')}""",
    ),
    "a7_pos_weights": (
        lambda s, d: rounded(o.pos_weights(multi_docs(s, d), "tags", by="source")),
        f"""with {ATOMS_SQL}, c as (select source, label, count(*) as n from atoms group by 1, 2),
          r as (select source, count(*) as n_rows from multi group by 1)
        select source, label, n as n_pos, round(least(greatest(n_rows - n, 1) / greatest(n, 1), 50), 6) as pos_weight
        from c join r using (source)""",
    ),
    "a8_samples_per_class": (
        lambda s, d: rounded(o.samples_per_class(multi_docs(s, d), "tags", multi_label=True)),
        f"""with {ATOM_COUNTS} select max(n_rows) as n_rows, cast(sum(n) as bigint) as label_count, count(*) as num_classes,
          round(max(n_rows) / count(*), 6) as rows_per_class, round(sum(n) / count(*), 6) as labels_per_class from c, r""",
    ),
    "a9_class_dispersion": (
        lambda s, d: rounded(o.class_dispersion(documents(s, d), "lang", by="source")),
        f"""with {LANG_COUNTS} select source, round(avg(n), 6) as mean_size, round(stddev_pop(n), 6) as std_size,
          min(n) as min_size, max(n) as max_size, round(stddev_pop(n) / avg(n), 6) as variation from c group by source""",
    ),
    "a10_text_length": (
        lambda s, d: rounded(a.text_length(documents(s, d), "text", by="source")),
        f"with {lengths_sql('token')} select {LENGTH_COLUMNS} from lens",
    ),
    "a11_text_length_chars": (
        lambda s, d: rounded(a.text_length(documents(s, d), "text", by="source", mode="char4")),
        f"with {lengths_sql('char4')} select {LENGTH_COLUMNS} from lens",
    ),
    "a12_sample_n": (
        lambda s, d: sample_n(documents(s, d).select("doc_id", "lang"), "doc_id", 500),
        "select doc_id, lang from documents order by md5('42:' || doc_id), doc_id limit 500",
    ),
    "a13_val_split": (
        a13,
        f"""with c as (select l_returnflag, l_linestatus, count(*) as n_rows from lineitem group by 1, 2)
        select *, round({VAL_SPLIT_SQL}, 6) as val_share from c""",
    ),
    "a14_select_models": (
        a14,
        f"""with c as (select lang, count(*) as n_rows from documents group by 1), m as (select *, {MODELS_SQL} as ms from c)
        select lang, n_rows, array_to_string(ms, ',') as models, case when n_rows < 2000 then
          array_to_string(list_filter(ms, lambda x: x in ('lr_bigram', 'lr_bigram_large')), ',') else '' end as oversized from m""",
    ),
    "a15_training_config": (
        a15,
        f"""with c as (select strftime(l_shipdate, '%Y-%m-%d') as day, l_returnflag, count(*) as n from lineitem group by 1, 2),
          k as (select day, max(n) / min(n) as imbalance_ratio, sum(n) / count(*) as rows_per_class from c group by day),
          x as (select day, {CONFIG_SQL} from k)
        select day, strategy, epochs_min, epochs_max, batch_size, round(learning_rate, 6) as learning_rate,
          round(weight_decay, 6) as weight_decay, patience, schedule, dropout, focal_gamma from x""",
    ),
    "a16_a17_analysis_by_source": (
        analysis_flat,
        f"with {ANALYSIS_SQL} select source, array_to_string(models, ',') as models, {', '.join(FLAT)}, "
        + ", ".join(f"round({c}, 6) as {c}" for c in FLAT_DOUBLES)
        + " from told",
    ),
    "a18_decision_log": (
        a18,
        f"""with {ANALYSIS_SQL},
          roster as (select ['nb_multinomial', 'nb_complement', 'lr_unigram', 'lr_bigram', 'lr_bigram_large'] as r)
        select source, 1 as decision_no, 'task_detection' as category, 'task is ' || task_type as decision,
          case when task_type = 'binary' then 'binary|multiclass' else 'binary' end as alternatives from told
        union all select source, 2, 'class_imbalance', case when use_class_weights then 'class weights on' else 'class weights off' end,
          case when use_class_weights then '' else 'class weights on' end from told
        union all select source, 3, 'class_imbalance', 'focal loss on', '' from told where use_focal_loss
        union all select source, 4, 'sequence_length', 'maximum length ' || max_length, '' from told
        union all select source, 5, 'model_selection', 'candidates ' || array_to_string(models, ', '),
          array_to_string(list_filter(r, lambda x: not list_contains(models, x)), '|') from told, roster
        union all select source, 6, 'hyperparameters', 'settings of tier ' || strategy, '' from told""",
    ),
    "k2_decisions": (
        k2,
        f"""with docs as (select 'all' as source, lang, text from documents),
          {ANALYSIS_SQL.replace('from documents', 'from docs')}
        select 1 as decision_no, 'task_detection' as category, 'task is ' || task_type as decision,
          printf('%d classes; two are binary, more are multiclass', num_classes) as reason from told
        union all select 2, 'class_imbalance', case when use_class_weights then 'class weights on' else 'class weights off' end,
          printf('largest class %d, smallest %d of %d rows; on above a ratio of 2', max_class, min_class, n_rows) from told
        union all select 3, 'class_imbalance', 'focal loss on', printf('%d to %d is above a ratio of 5', max_class, min_class) from told where use_focal_loss
        union all select 4, 'sequence_length', 'maximum length ' || max_length,
          printf('p95 is %d, limits are 16 to 512', p95_raw) from told
        union all select 5, 'model_selection', 'candidates ' || array_to_string(models, ', '), printf('%d rows, tier %s', n_rows, strategy) from told
        union all select 6, 'hyperparameters', 'settings of tier ' || strategy,
          printf('%d rows in %d classes, %d in the smallest', n_rows, num_classes, min_class) from told""",
    ),
    "j1_attach_weights": (
        lambda s, d: rounded(o.attach_weights(documents(s, d).select("doc_id", "lang"), o.class_weights(documents(s, d).filter("lang <> 'es'"), "lang"), "lang")),
        """with c as (select lang, count(*) as n from documents where lang <> 'es' group by 1),
          w as (select lang, min(n) over () / n as weight from c)
        select doc_id, lang, round(coalesce(weight, 1.0), 6) as weight from documents left join w using (lang)""",
    ),
    "p7_label_sets": (
        lambda s, d: label_sets(multi_docs(s, d), "tags", o.atomic_labels(multi_docs(s, d), "tags")).select(
            "doc_id", F.array_join(F.col("label_ids").cast("array<string>"), ",").alias("label_ids")
        ),
        f"""with {MULTI_SQL}, k as (select list(distinct t order by t) as ks from (select unnest(string_split(tags, ',')) as t from multi))
        select doc_id, array_to_string(list_sort(list_transform(list_distinct(string_split(tags, ',')), lambda x: list_position(ks, x) - 1)), ',') as label_ids
        from multi, k""",
    ),
    "p7_multi_hot": (
        lambda s, d: o.multi_hot(multi_docs(s, d), "tags").select(
            "doc_id", F.array_join(F.transform("multi_hot", lambda x: x.cast("int").cast("string")), "").alias("multi_hot")
        ),
        f"""with {ATOMS_SQL}, k as (select list(label order by label) as ks from (select distinct label from atoms))
        select doc_id, array_to_string(list_transform(ks, lambda x: case when list_contains(string_split(tags, ','), x) then '1' else '0' end), '') as multi_hot
        from multi, k""",
    ),
}
