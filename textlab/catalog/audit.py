"""Data-quality audit."""

from pyspark.sql import functions as F

from textlab.catalog.inputs import ATOMS_SQL, documents, multi_docs, norm_sql, rounded, strip_sql
from textlab.operators import quality as q
from textlab.plans import reports

GROUPS_SQL = f"""groups as (select {norm_sql('text')} as k, count(*) as n, count(distinct source) as n_labels
  from documents group by 1)"""


def q2_rows(s, d):
    found = q.near_duplicates(documents(s, d), "text", "doc_id")
    return found.select("doc_id", F.lower("text_key").alias("text_key"), "group_size")


def q3_rows(s, d):
    found = q.label_conflicts(documents(s, d), "text", "source")
    return found.select(F.lower("text_key").alias("text_key"), "n", "n_labels")


def q5(s, d):
    return q.quality_report(documents(s, d), "text", "source")


def q5_verdict(s, d):
    df = documents(s, d)
    return q.quality_verdict(df, q.quality_report(df, "text", "lang", by="source"), by="source")


REPORT_SQL = f"""{GROUPS_SQL}, found as (
  select 'short texts' as "check", '' as subject, count(*) as n from documents where length({strip_sql('text')}) < 5
  union all select 'near duplicates', '', cast(sum(n) as bigint) from groups where n > 1
  union all select 'label conflicts', '', count(*) from groups where n_labels > 1
  union all select 'tiny class', source, count(*) from documents group by source having count(*) < 20)"""

VERDICT_SQL = f"""with g as (select source, {norm_sql('text')} as k, count(*) as n, count(distinct lang) as n_labels
    from documents group by 1, 2),
  found as (select source, count(*) as n from documents where length({strip_sql('text')}) < 5 group by 1
    union all select source, sum(n) from g where n > 1 group by 1
    union all select source, count(*) from g where n_labels > 1 group by 1
    union all select source, n from (select source, lang, count(*) as n from documents group by 1, 2) where n < 20),
  w as (select source, count(*) as c from found where n > 0 group by 1)
  select s.source, coalesce(w.c, 0) as total_warnings, coalesce(w.c, 0) = 0 as passed
  from (select distinct source from documents) s left join w using (source)"""

FLAGSHIP_SQL = f"""with docs as (select * from documents where lang is not null and text is not null and {strip_sql('text')} <> ''
    qualify row_number() over (partition by text order by doc_id) = 1),
  g as (select {norm_sql('text')} as k, count(*) as n, count(distinct lang) as n_labels from docs group by 1),
  c as (select lang as label, count(*) as n from docs group by 1),
  found as (select 'short texts' as measure, '' as subject, count(*) as n from docs where length({strip_sql('text')}) < 5
    union all select 'near duplicates', '', sum(n) from g where n > 1
    union all select 'label conflicts', '', count(*) from g where n_labels > 1
    union all select 'tiny class', label, n from c where n < 20)
select 'rows' as measure, label as subject, cast(n as double) as value from c
union all select 'weight', label, round(min(n) over () / n, 6) from c
union all select measure, subject, cast(n as double) from found where n > 0"""

QUERIES = {
    "q1_short_texts": (
        lambda s, d: rounded(q.short_texts(documents(s, d), "text", by="lang")),
        f"""select lang, count(*) as n_rows, count(case when length({strip_sql('text')}) < 5 then 1 end) as n_short,
          round(count(case when length({strip_sql('text')}) < 5 then 1 end) * 100.0 / count(*), 6) as pct_short
        from documents group by lang""",
    ),
    "q2_near_duplicates": (
        lambda s, d: q.near_duplicate_count(documents(s, d), "text"),
        f"""with {GROUPS_SQL} select cast(sum(n) as bigint) as n_rows, count(*) as n_texts,
          cast(coalesce(sum(case when n > 1 then n end), 0) as bigint) as near_duplicates,
          count(case when n > 1 then 1 end) as duplicate_groups from groups""",
    ),
    "q2_near_duplicate_rows": (
        q2_rows,
        f"""select doc_id, sha256({norm_sql('text')}) as text_key, count(*) over (partition by {norm_sql('text')}) as group_size
        from documents qualify group_size > 1""",
    ),
    "q3_label_conflicts": (
        q3_rows,
        f"with {GROUPS_SQL} select sha256(k) as text_key, n, n_labels from groups where n_labels > 1",
    ),
    "q2_q3_text_checks": (
        lambda s, d: q.text_checks(documents(s, d), "text", "source"),
        f"""with {GROUPS_SQL} select cast(sum(n) as bigint) as n_rows,
          cast(coalesce(sum(case when n > 1 then n end), 0) as bigint) as near_duplicates,
          count(case when n_labels > 1 then 1 end) as label_conflicts from groups""",
    ),
    "q4_tiny_classes": (
        lambda s, d: q.tiny_classes(documents(s, d), "lang", by="source", multi_label=False),
        "select source, lang as label, count(*) as n from documents group by 1, 2 having count(*) < 20",
    ),
    "q4_tiny_classes_multi": (
        lambda s, d: q.tiny_classes(multi_docs(s, d), "tags", by="source"),
        f"with {ATOMS_SQL} select source, label, count(*) as n from atoms group by 1, 2 having count(*) < 20",
    ),
    "q5_quality_report": (q5, f"""with {REPORT_SQL} select "check", subject, n from found where n > 0"""),
    "q5_quality_verdict": (q5_verdict, VERDICT_SQL),
    "q6_class_bars": (
        lambda s, d: q.class_bars(documents(s, d), "lang", by="source"),
        """with c as (select source, lang as label, count(*) as n from documents group by 1, 2),
          t as (select *, max(n) over (partition by source) as m, sum(n) over (partition by source) as s from c)
        select source, label, n, repeat('█', cast(floor(n / m * 30) as bigint)) as bar_of_largest,
          repeat('█', cast(floor(n / s * 30) as bigint)) as bar_of_total from t""",
    ),
    "k4_quality_report": (
        lambda s, d: reports.quality_report(documents(s, d), "text", "lang"),
        f"""with g as (select {norm_sql('text')} as k, count(*) as n, count(distinct lang) as n_labels from documents group by 1),
          c as (select lang as label, count(*) as n from documents group by 1),
          found as (select 'short texts' as "check", '' as subject, count(*) as n from documents where length({strip_sql('text')}) < 5
            union all select 'near duplicates', '', cast(sum(n) as bigint) from g where n > 1
            union all select 'label conflicts', '', count(*) from g where n_labels > 1
            union all select 'tiny class', label, n from c where n < 20),
          hits as (select * from found where n > 0)
        select 'overview' as section, 1 as ord, 'labels' as key, cast(sum(n) as bigint)::varchar as value from c
        union all select 'overview', 2, 'classes', count(*)::varchar from c
        union all select 'classes', row_number() over (order by n desc, label), label,
          n || ' ' || repeat('█', cast(floor(n / (select max(n) from c) * 30) as bigint)) from c
        union all select 'findings', row_number() over (order by "check", subject), "check" || ' ' || subject, n::varchar from hits
        union all select 'verdict', 1, 'warnings', count(*)::varchar from hits
        union all select 'verdict', 2, 'passed', case when count(*) = 0 then 'true' else 'false' end from hits""",
    ),
}
