"""Validation, cleaning and class checks."""

from pyspark.sql import functions as F

from textlab.catalog.inputs import (
    LABELED_SQL,
    MULTI_SQL,
    PARTLY_SQL,
    documents,
    labeled,
    multi_docs,
    partly_labeled,
    rounded,
    strip_sql,
)
from textlab.functions.labels import parse_labels
from textlab.operators import validate as v
from textlab.session import work_path
from textlab.sources.csvfiles import LATIN, read_csv
from textlab.sources.tables import load

BLANK = f"{strip_sql('text')} = ''"


def v5(spark, d):
    df = multi_docs(spark, d)
    return df.select("doc_id", F.array_join(parse_labels(df, "tags"), "|").alias("labels"))


def v7(spark, d):
    items = load(spark, d, "lineitem").select(F.col("l_quantity").alias("label"))
    return v.normalise_label(items, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def s1(spark, d):
    """The documents written as CSV files in two encodings and read again."""
    df = load(spark, d, "documents").select("doc_id", "source", "text", "lang", "n_chars")
    latin = (F.col("doc_id") % 2 == 1) & F.coalesce(F.col("text").rlike(r"^[\x01-\x7f\xa1-\xff]*$"), F.lit(True))
    path = work_path(spark, "csv")
    for name, rows, encoding in (("latin", df.filter(latin), LATIN), ("utf", df.filter(~latin), "UTF-8")):
        rows.write.options(header=True, escape='"', encoding=encoding).csv(f"{path}/{name}")
    got = read_csv(spark, f"{path}/*")
    return got.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"),
    )


FUNNEL_SQL = f"""with {PARTLY_SQL}, c as (select lang, count(*) as c0, count(quality) as c1,
    count(case when quality is not null and text is not null then 1 end) as c2,
    count(case when quality is not null and text is not null and not ({BLANK}) then 1 end) as c3,
    count(distinct case when quality is not null and text is not null and not ({BLANK}) then text end) as c4
  from partly group by lang)
select lang, 1 as stage_no, 'drop null label' as stage, c0 as rows_in, c1 as rows_out, c0 - c1 as dropped from c
union all select lang, 2, 'drop null text', c1, c2, c1 - c2 from c
union all select lang, 3, 'drop blank text', c2, c3, c2 - c3 from c
union all select lang, 4, 'drop duplicate text', c3, c4, c3 - c4 from c"""

QUERIES = {
    "s1_read_csv": (
        s1,
        "select doc_id, source, lang, n_chars, md5(coalesce(text, '')) as text_md5 from documents",
    ),
    "s2_load_documents": (
        lambda s, d: documents(s, d).select("doc_id", "lang", "source", "n_chars"),
        "select doc_id, lang, source, n_chars from documents",
    ),
    "j7_labeled_documents": (
        lambda s, d: labeled(s, d).select("doc_id", "lang", "source", "quality", "toxic"),
        f"with {LABELED_SQL} select doc_id, lang, source, quality, toxic from labeled",
    ),
    "v1_row_guard": (
        lambda s, d: v.row_guard(partly_labeled(s, d), "quality", "text", by="lang"),
        f"""with {PARTLY_SQL}, c as (select lang, count(*) as loaded,
            count(case when quality is not null and text is not null then 1 end) as after_nulls,
            count(case when quality is not null and text is not null and not ({BLANK}) then 1 end) as after_blanks
          from partly group by lang)
        select *, loaded >= 100 as loaded_ok, after_nulls >= 100 as after_nulls_ok,
          after_blanks >= 100 as after_blanks_ok from c""",
    ),
    "v3_null_ratio": (
        lambda s, d: rounded(v.null_ratio(partly_labeled(s, d), ["quality", "toxic", "text"], by="source")),
        f"""with {PARTLY_SQL}, long as (
          select source, 'quality' as "column", avg(case when quality is null then 1.0 else 0.0 end) as r from partly group by source
          union all select source, 'toxic', avg(case when toxic is null then 1.0 else 0.0 end) from partly group by source
          union all select source, 'text', avg(case when text is null then 1.0 else 0.0 end) from partly group by source)
        select source, "column", round(cast(r as double), 6) as null_ratio, r > 0.95 as too_empty from long""",
    ),
    "v4_multi_label_check": (
        lambda s, d: v.multi_label_check(multi_docs(s, d), "tags"),
        f"""with {MULTI_SQL}, told as (select regexp_matches(tags, '[,|]') as b from multi where tags is not null)
        select count(*) as n_values, count(case when b then 1 end) as n_delimited,
          count(case when b then 1 end) > 0.1 * count(*) as is_multi_label from told""",
    ),
    "v5_parse_labels": (
        v5,
        f"""with {MULTI_SQL} select doc_id, array_to_string(list_filter(list_transform(
          regexp_split_to_array(tags, '[,|]'), lambda x: trim(x)), lambda x: x <> ''), '|') as labels from multi""",
    ),
    "v6_regression_guard": (
        lambda s, d: rounded(v.regression_guard(load(s, d, "events"), "value", by="event_type")),
        """with c as (select event_type, count(*) as n_rows, count(distinct value) as n_distinct from events group by event_type)
        select *, round(n_distinct / n_rows, 6) as distinct_ratio,
          n_distinct > 20 and n_distinct / n_rows > 0.2 as is_regression from c""",
    ),
    "v7_normalise_label": (
        v7,
        """select cast(cast(l_quantity as bigint) as varchar) as label, count(*) as n from lineitem
        where l_quantity is not null group by 1""",
    ),
    "v8_drop_missing": (
        lambda s, d: v.drop_missing(partly_labeled(s, d), "quality", "text").select("doc_id", "quality"),
        f"with {PARTLY_SQL} select doc_id, quality from partly where quality is not null and text is not null",
    ),
    "v9_drop_blank": (
        lambda s, d: v.drop_blank(documents(s, d), "text").select("doc_id", "lang"),
        f"select doc_id, lang from documents where text is not null and not ({BLANK})",
    ),
    "v10_dedup_text": (
        lambda s, d: v.dedup_text(documents(s, d), "text", "doc_id").select(
            "doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("text_md5")
        ),
        """select doc_id, lang, md5(text) as text_md5 from documents
        qualify row_number() over (partition by text order by doc_id) = 1""",
    ),
    "v10_dedup_report": (
        lambda s, d: rounded(v.dedup_report(documents(s, d), "text", by="source")),
        """select source, count(*) as n_rows, count(distinct text) as n_distinct,
          count(*) - count(distinct text) as n_removed,
          round((count(*) - count(distinct text)) * 100.0 / count(*), 6) as pct_removed from documents group by source""",
    ),
    "v11_class_checks": (
        lambda s, d: rounded(v.class_checks(documents(s, d), "lang", by="source")),
        """with c as (select source, lang, count(*) as n from documents group by 1, 2)
        select source, count(*) as n_classes, cast(sum(n) as bigint) as n_rows, min(n) as min_class,
          arg_min(lang, (n, lang)) as smallest_class, round(sum(n) / count(*), 6) as rows_per_class,
          count(*) >= 2 as enough_classes, min(n) >= 2 as enough_per_class,
          case when count(*) > 20 and sum(n) / count(*) < 50 then 'many classes, few rows each'
            when count(*) > 50 then 'very many classes' else 'none' end as warning
        from c group by source""",
    ),
    "v12_class_checks_by_brand": (
        lambda s, d: rounded(v.class_checks(load(s, d, "part"), "p_brand")),
        """with c as (select p_brand as b, count(*) as n from part group by 1)
        select count(*) as n_classes, cast(sum(n) as bigint) as n_rows, min(n) as min_class,
          arg_min(b, (n, b)) as smallest_class, round(sum(n) / count(*), 6) as rows_per_class,
          count(*) >= 2 as enough_classes, min(n) >= 2 as enough_per_class,
          case when count(*) > 20 and sum(n) / count(*) < 50 then 'many classes, few rows each'
            when count(*) > 50 then 'very many classes' else 'none' end as warning from c""",
    ),
    "v13_class_warnings_multi": (
        lambda s, d: rounded(v.class_checks(multi_docs(s, d), "tags", multi_label=True)),
        f"""with {MULTI_SQL}, a as (select unnest(string_split(tags, ',')) as t from multi),
          c as (select t, count(*) as n from a group by t)
        select count(*) as n_classes, cast(sum(n) as bigint) as n_rows, min(n) as min_class,
          arg_min(t, (n, t)) as smallest_class, round(sum(n) / count(*), 6) as rows_per_class,
          count(*) >= 2 as enough_classes, true as enough_per_class, 'none' as warning from c""",
    ),
    "v14_cleaning_funnel": (lambda s, d: v.cleaning_funnel(partly_labeled(s, d), "quality", "text", by="lang"), FUNNEL_SQL),
    "v15_basic_stats": (
        lambda s, d: rounded(v.basic_stats(documents(s, d), "lang", "text", by="source")),
        """select source, count(*) as num_rows, count(distinct lang) as num_classes,
          round(avg(length(text)), 6) as avg_text_length, min(length(text)) as min_text_length,
          max(length(text)) as max_text_length from documents group by source""",
    ),
}
