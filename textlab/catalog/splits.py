"""Splits, folds, encodings, ranks and running totals."""

from pyspark.sql import functions as F

from textlab.catalog.analytics import SPLIT_RANKS, VAL_SPLIT_SQL
from textlab.catalog.inputs import TOKEN_SQL, documents, hash_rank_sql, multi_docs, strip_sql
from textlab.functions.text import fill_empty, tokens
from textlab.operators import labels as o
from textlab.operators import ranks
from textlab.operators import split as sp
from textlab.sources.tables import load

RANKED = hash_rank_sql("documents", "doc_id", "lang")
RANKED_ALL = hash_rank_sql("documents", "doc_id")


def lang_docs(s, d):
    return documents(s, d).select("doc_id", "lang", "source")


def by_doc(df, *columns):
    return df.select("doc_id", *columns)


def p4(s, d):
    """A split with two classes wholly in validation, repaired."""
    part = F.when(F.col("lang").isin("es", "de"), "val").otherwise(F.when(F.col("doc_id") % 4 == 0, "val").otherwise("train"))
    return sp.repair_split(lang_docs(s, d).withColumn("split", part), "lang", "doc_id").select("doc_id", "split")


def j4(s, d):
    """Sources that occur with French texts only in the later half of the ids."""
    df = documents(s, d)
    return o.unseen_labels(df.filter("lang = 'es'"), df.filter("lang = 'fr'"), "n_chars")


def j3(s, d):
    classes = o.index_labels(documents(s, d), "lang")
    ids = F.array((F.col("doc_id") % 4).cast("int"), ((F.col("doc_id") + 1) % 4).cast("int"))
    told = o.decode_id_lists(documents(s, d).select("doc_id", ids.alias("class_ids")), classes)
    return told.select("doc_id", F.array_join("decoded", ",").alias("decoded"))


def j2(s, d):
    classes = o.index_labels(documents(s, d), "lang")
    rows = documents(s, d).select("doc_id", (F.col("doc_id") % 4).cast("int").alias("class_id"))
    return o.decode_ids(rows, classes).select("doc_id", "class_id", "decoded")


def p6(s, d):
    df = lang_docs(s, d)
    return o.encode_labels(df, "lang", o.index_labels(df, "lang")).select("doc_id", "lang", F.col("class_id").cast("int").alias("class_id"))


def p11(s, d):
    found = tokens(F.col("text"), 512)
    return documents(s, d).select("doc_id", F.size(found).alias("n_tokens"), F.md5(F.array_join(found, " ").cast("binary")).alias("tokens_md5"))


def w1(s, d):
    return ranks.top_n(documents(s, d).select("doc_id", "source", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 5, "source")


def w2(s, d):
    df = load(s, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    df = df.groupBy("l_returnflag", "l_orderkey").agg(F.sum("q").alias("q"))
    return ranks.running_sum(df, "q", "l_returnflag", "l_orderkey")


PROXY_SQL = f"""with n as (select count(*) as n from documents),
  z as (select n, greatest(20, least(500, cast(floor(n * cast(0.1 as double)) as bigint))) as nv,
    greatest(40, least(2000, cast(floor(n * cast(0.3 as double)) as bigint))) as nt from n),
  c as (select lang, count(*) as k from documents group by 1),
  a as (select *, cast(nv as double) * k / n as x, floor(cast(nv as double) * k / n) as fl from c, z),
  b as (select *, fl + case when row_number() over (order by x - fl desc, lang) <= nv - sum(fl) over () then 1 else 0 end as qv from a),
  e as (select *, k - qv as rest, cast(nt as double) * (k - qv) / sum(k - qv) over () as y from b),
  f as (select *, floor(y) + case when row_number() over (order by y - floor(y) desc, lang) <= nt - sum(floor(y)) over () then 1 else 0 end as qt from e)
select doc_id, case when nv + nt >= n then 'both' when rnk <= qv then 'proxy_val' when rnk <= qv + qt then 'proxy_train' else 'unused' end as role
from {RANKED} t join f using (lang)"""

QUERIES = {
    "p1_fill_empty": (
        lambda s, d: documents(s, d).select("doc_id", F.md5(fill_empty(F.col("text")).cast("binary")).alias("text_md5")),
        f"select doc_id, md5(case when text is null or {strip_sql('text')} = '' then '[EMPTY]' else text end) as text_md5 from documents",
    ),
    "p2_stratified_split": (
        lambda s, d: by_doc(sp.stratified_split(lang_docs(s, d), "lang", "doc_id", ratio=0.2), "lang", "split"),
        f"""with {SPLIT_RANKS} select doc_id, lang, case when rnk <= t.n_c - quota then 'train' else 'val' end as split
        from {RANKED} t join g using (lang)""",
    ),
    "p2_stratified_split_by_source": (
        lambda s, d: by_doc(sp.stratified_split(lang_docs(s, d), "lang", "doc_id", by="source"), "split"),
        f"""with q as (select source, lang, count(*) as n_c from documents group by 1, 2),
          h as (select *, sum(n_c) over (partition by source) as n_rows from q),
          e as (select *, ceil({VAL_SPLIT_SQL} * n_rows) as nv from h),
          f as (select *, nv * n_c / n_rows as x, floor(nv * n_c / n_rows) as fl from e),
          g as (select *, fl + case when row_number() over (partition by source order by x - fl desc, lang)
            <= nv - sum(fl) over (partition by source) then 1 else 0 end as quota from f)
        select doc_id, case when rnk <= t.n_c - quota then 'train' else 'val' end as split
        from {hash_rank_sql('documents', 'doc_id', 'source, lang')} t join g using (source, lang)""",
    ),
    "p3_random_split": (
        lambda s, d: by_doc(sp.random_split(lang_docs(s, d), "doc_id"), "split"),
        f"""with t as (select doc_id, rnk, n_c as n_rows from {RANKED_ALL})
        select doc_id, case when rnk <= floor(n_rows * (1 - {VAL_SPLIT_SQL})) then 'train' else 'val' end as split from t""",
    ),
    "p4_repair_split": (
        p4,
        f"""with t as (select *, case when lang in ('es', 'de') or doc_id % 4 = 0 then 'val' else 'train' end as s0 from {RANKED})
        select doc_id, case when lang in ('es', 'de') and rnk = n_c then 'train' else s0 end as split from t""",
    ),
    "p5_split_report": (
        lambda s, d: sp.split_report(sp.random_split(lang_docs(s, d), "doc_id"), by="source"),
        f"""with t as (select source, rnk, n_c as n_rows from {RANKED_ALL}),
          u as (select source, rnk <= floor(n_rows * (1 - {VAL_SPLIT_SQL})) as train from t)
        select source, count(case when train then 1 end) as n_train, count(case when not train then 1 end) as n_val,
          case when count(case when not train then 1 end) = 0 then 'empty' when count(case when not train then 1 end) < 5
            then 'unreliable' else 'ok' end as verdict from u group by source""",
    ),
    "p6_index_labels": (
        p6,
        "select doc_id, lang, cast(dense_rank() over (order by lang) - 1 as integer) as class_id from documents",
    ),
    "p8_stratified_folds": (
        lambda s, d: by_doc(sp.stratified_folds(lang_docs(s, d), "lang", "doc_id", 5), "fold"),
        f"select doc_id, cast((rnk - 1) * 5 // n_c as integer) as fold from {RANKED}",
    ),
    "p8_folds_by_source": (
        lambda s, d: by_doc(sp.stratified_folds(lang_docs(s, d), "lang", "doc_id", 5, by="source"), "fold"),
        f"""with t as (select *, min(n_c) over (partition by source) as least from {hash_rank_sql('documents', 'doc_id', 'source, lang')})
        select doc_id, cast((rnk - 1) * greatest(2, least(5, least)) // n_c as integer) as fold from t""",
    ),
    "p9_random_folds": (
        lambda s, d: by_doc(sp.random_folds(multi_docs(s, d), "doc_id", 5), "fold"),
        f"""with m as (select doc_id from documents join labels using (doc_id))
        select doc_id, cast((rnk - 1) * 5 // n_c as integer) as fold from {hash_rank_sql('m', 'doc_id')}""",
    ),
    "p10_proxy_sample": (lambda s, d: by_doc(sp.proxy_sample(lang_docs(s, d), "lang", "doc_id"), "role"), PROXY_SQL),
    "p11_tokenize": (
        p11,
        f"""with t as (select doc_id, list_slice(regexp_extract_all(lower(text), '{TOKEN_SQL}'), 1, 512) as ts from documents)
        select doc_id, cast(len(ts) as integer) as n_tokens, md5(array_to_string(ts, ' ')) as tokens_md5 from t""",
    ),
    "p12_hash_rank": (
        lambda s, d: by_doc(ranks.hash_rank(lang_docs(s, d), "doc_id", "lang"), "lang", "rank"),
        f"select doc_id, lang, rnk as rank from {RANKED}",
    ),
    "j2_decode_ids": (
        j2,
        """with k as (select lang, dense_rank() over (order by lang) - 1 as c from (select distinct lang from documents))
        select doc_id, cast(doc_id % 4 as integer) as class_id, k.lang as decoded from documents d join k on d.doc_id % 4 = k.c""",
    ),
    "j3_decode_id_lists": (
        j3,
        """with k as (select list(lang order by lang) as ks from (select distinct lang from documents))
        select doc_id, ks[doc_id % 4 + 1] || ',' || ks[(doc_id + 1) % 4 + 1] as decoded from documents, k""",
    ),
    "j4_unseen_labels": (
        j4,
        "select distinct n_chars from documents where lang = 'fr' and n_chars not in (select n_chars from documents where lang = 'es')",
    ),
    "w1_top_n": (
        w1,
        """select doc_id, source, n_chars, row_number() over (partition by source order by n_chars desc, doc_id) as rank
        from documents qualify rank <= 5""",
    ),
    "w2_running_sum": (
        w2,
        """with t as (select l_returnflag, l_orderkey, cast(sum(cast(l_quantity as bigint)) as bigint) as q from lineitem group by 1, 2)
        select *, cast(sum(q) over (partition by l_returnflag order by l_orderkey) as bigint) as running from t""",
    ),
}
