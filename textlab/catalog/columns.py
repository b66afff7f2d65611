"""Column profiles, text column choice, merging and truncation."""

from pyspark.sql import functions as F

from textlab.catalog.inputs import documents, rounded, strip_sql, words_sql
from textlab.operators import merge as m
from textlab.operators import profile as p
from textlab.sources.tables import load

PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]
DOCS = ["text", "source", "n_chars"]
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


def profile_sql(table: str, columns: list[str], by: str = "") -> str:
    """CTE ``profile``: value counts per column, then their summary."""
    g = by + ", " if by else ""
    long = " union all ".join(
        f"select {g}'{c}' as \"column\", cast({c} as varchar) as v from {table}" for c in columns
    )
    return f"""long as ({long}),
  vals as (select {g}"column", v, count(*) as n, length(coalesce(v, 'nan')) as len, {words_sql("coalesce(v, 'nan')")} as w
    from long group by {g}"column", v),
  profile as (select {g}"column", cast(sum(n) as bigint) as n_rows,
    cast(coalesce(sum(case when v is not null then n end), 0) as bigint) as non_null, count(v) as num_unique,
    count(v) / sum(n) as uniqueness, sum(n * len) / sum(n) as avg_length, min(len) as min_length, max(len) as max_length,
    sum(n * w) / sum(n) as avg_words, max(n) / sum(n) as top_share from vals group by {g}"column"),
  kinds as (select *, case when uniqueness > 0.85 and avg_length < 40 and avg_words <= 1.3 then 'id'
      when avg_length > 20 then 'text'
      when avg_length > 1 and num_unique >= 2 and top_share <= 0.95 then 'categorical' else 'ignored' end as kind from profile)"""


PROFILE_COLUMNS = """"column", n_rows, non_null, num_unique, round(uniqueness, 6) as uniqueness,
  round(avg_length, 6) as avg_length, min_length, max_length, round(avg_words, 6) as avg_words, round(top_share, 6) as top_share"""

RESOLVE_SQL = """, ranked as (select *, row_number() over (order by
      case kind when 'text' then 0 when 'categorical' then 1 else 2 end, avg_length desc, "column") as r
    from kinds where kind <> 'id' and avg_length > 0)
  select "column" as text_column, round(avg_length, 6) as avg_length,
    case kind when 'text' then 'detected' when 'categorical' then 'promoted' else 'fallback' end as found,
    kind in ('text', 'categorical') or avg_length >= 5 as usable from ranked where r = 1"""


def _table(name, columns):
    return lambda s, d: load(s, d, name).select(*columns)


part, docs, customer = _table("part", PART), _table("documents", DOCS), _table("customer", CUSTOMER)


def merged_sql(columns: list[str]) -> str:
    parts = []
    for c in columns:
        value = strip_sql(f"cast({c} as varchar)")
        parts.append(f"case when {value} <> '' and lower({value}) <> 'nan' then '{c}: ' || {value} end")
    return f"concat_ws(' [SEP] ', {', '.join(parts)})"


MERGED_DOCS = ["source", "lang", "text"]
MERGED_PART = ["p_type", "p_brand", "p_name"]


def v20(s, d):
    return m.merge_text(load(s, d, "part"), MERGED_PART).select("p_partkey", "combined_text")


def v21(s, d):
    return rounded(m.token_budget(m.merge_text(documents(s, d), MERGED_DOCS), "combined_text", by="source"))


def v22(mode):
    def run(s, d):
        cut = m.truncate_text(documents(s, d), "text", mode=mode)
        return cut.select(
            "doc_id", F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("text_md5")
        )

    return run


def v24(s, d):
    return m.auto_text(load(s, d, "part").select(*PART), "p_type", "p_partkey").select("p_partkey", "combined_text")


def approximate(df):
    """The profile by sketches with the roles it gives, and whether what is estimated there is
    within its error of the exact profile."""
    told = p.classify_columns(p.profile_columns(df, approximate=True))
    exact = p.profile_columns(df).select("column", F.col("num_unique").alias("u"), F.col("top_share").alias("t"))
    off = F.col("top_share") - F.col("t")
    both = told.join(exact, "column")
    return rounded(both.select(
        "column", "kind", "n_rows", "non_null", "avg_length", "min_length", "max_length", "avg_words",
        (F.abs(F.col("num_unique") - F.col("u")) <= 5 * p.DISTINCT_ERROR * F.col("u")).alias("unique_near"),
        (F.abs(off) <= p.TOP_ERROR).alias("share_near"),
    ))


CUT = "substr(text, 1, 1638)"

QUERIES = {
    "v16_profile_part": (
        lambda s, d: rounded(p.profile_columns(part(s, d))),
        f"with {profile_sql('part', PART)} select {PROFILE_COLUMNS} from profile",
    ),
    "v16_profile_documents_by_lang": (
        lambda s, d: rounded(p.profile_columns(load(s, d, "documents").select("lang", *DOCS), by="lang")),
        f"with {profile_sql('documents', DOCS, 'lang')} select lang, {PROFILE_COLUMNS} from profile",
    ),
    "v16_approximate_profile_part": (
        lambda s, d: approximate(part(s, d)),
        f"""with {profile_sql('part', PART)} select "column", kind, n_rows, non_null, round(avg_length, 6) as avg_length, min_length, max_length,
          round(avg_words, 6) as avg_words, true as unique_near, true as share_near from kinds""",
    ),
    "v16_approximate_profile_documents": (
        lambda s, d: approximate(docs(s, d)),
        f"""with {profile_sql('documents', DOCS)} select "column", kind, n_rows, non_null, round(avg_length, 6) as avg_length, min_length, max_length,
          round(avg_words, 6) as avg_words, true as unique_near, true as share_near from kinds""",
    ),
    "v17_classify_part": (
        lambda s, d: p.classify_columns(p.profile_columns(part(s, d))).select("column", "kind", "near_constant"),
        f"""with {profile_sql('part', PART)} select "column", kind, kind = 'text' and top_share > 0.5 as near_constant from kinds""",
    ),
    "v17_classify_documents": (
        lambda s, d: p.classify_columns(p.profile_columns(docs(s, d))).select("column", "kind", "near_constant"),
        f"""with {profile_sql('documents', DOCS)} select "column", kind, kind = 'text' and top_share > 0.5 as near_constant from kinds""",
    ),
    "v18_resolve_text_part": (
        lambda s, d: rounded(p.resolve_text_column(p.profile_columns(part(s, d)))),
        f"with {profile_sql('part', PART)}{RESOLVE_SQL}",
    ),
    "v18_resolve_text_documents": (
        lambda s, d: rounded(p.resolve_text_column(p.profile_columns(docs(s, d)))),
        f"with {profile_sql('documents', DOCS)}{RESOLVE_SQL}",
    ),
    "v19_detect_text_column": (
        lambda s, d: rounded(p.detect_text_column(p.profile_columns(customer(s, d)))),
        f"""with {profile_sql('customer', CUSTOMER)} select arg_max("column", (avg_length, "column")) as text_column,
          round(max(avg_length), 6) as avg_length from profile""",
    ),
    "v20_merge_text": (v20, f"select p_partkey, {merged_sql(MERGED_PART)} as combined_text from part"),
    "v21_token_budget": (
        v21,
        f"""with t as (select source, length({merged_sql(MERGED_DOCS)}) / 4 as n from documents)
        select source, round(avg(n), 6) as avg_tokens, round(max(n), 6) as max_tokens,
          count(case when n > 512 then 1 end) as n_over,
          round(count(case when n > 512 then 1 end) * 100.0 / count(*), 6) as pct_over from t group by source""",
    ),
    "v22_truncate_text": (
        v22("own"),
        f"""with t as (select doc_id, case when length(text) > 2048 then {CUT} else text end as text from documents)
        select doc_id, length(text) as chars, md5(text) as text_md5 from t""",
    ),
    "v22_truncate_text_all": (
        v22("reference"),
        f"""with t as (select doc_id, case when (select max(length(text)) > 2048 from documents) and length(text) > 1638
            then {CUT} else text end as text from documents)
        select doc_id, length(text) as chars, md5(text) as text_md5 from t""",
    ),
    "v23_leakage_columns": (
        lambda s, d: rounded(p.leakage_columns(p.profile_columns(customer(s, d)), ["c_name", "c_mktsegment"])).select(
            "column", "uniqueness", "avg_length"
        ),
        f"""with {profile_sql('customer', CUSTOMER)} select "column", round(uniqueness, 6) as uniqueness,
          round(avg_length, 6) as avg_length from profile
        where "column" in ('c_name', 'c_mktsegment') and uniqueness > 0.85 and avg_length < 40""",
    ),
    "v24_auto_text": (
        v24,
        # The columns follow from the profile: categorical ones by length, then the promoted text.
        f"select p_partkey, {merged_sql(['p_size', 'p_brand', 'p_name'])} as combined_text from part",
    ),
    "v25_preview_stats": (
        lambda s, d: p.preview_stats(load(s, d, "documents").join(load(s, d, "labels"), "doc_id", "left"), "lang", "text", by="source"),
        """select d.source, count(*) as n_rows, count(distinct d.lang) as n_classes,
          cast(floor(avg(length(d.text))) as bigint) as avg_text_length,
          cast(sum(case when l.quality is null then 1 else 0 end + case when l.toxic is null then 1 else 0 end) as bigint) as missing_cells
        from documents d left join labels l using (doc_id) group by d.source""",
    ),
    "v25_preview_rows": (
        lambda s, d: p.preview_rows(documents(s, d).select("doc_id", "lang", "source", "n_chars"), "doc_id"),
        "select doc_id, lang, source, n_chars from documents order by doc_id limit 10",
    ),
}
