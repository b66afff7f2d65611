"""The registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.llm import (
    fingerprints, language, links, mixing, ngramjoin, packing, periodic, pseudonyms, quality, repeats, sharding, toxicity,
    vectorcodes,
)
from textlab.sources.tables import load


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the vocabulary file is; the package that knows it is on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_next(load(spark, folder, "documents"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.document_mix(load(spark, folder, "documents"))


def op4_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 16 shards whose row counts differ by one at most."""
    shards = sharding.document_shards(load(spark, folder, "documents"))
    grown = F.lit(None).cast("int").alias("grown_shard")
    return shards.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", grown, "curve")


#: Both ways over whole tables; a join of all shingles and a recursion over the links.
OP2_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents),
s AS MATERIALIZED (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS g
    FROM d),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o, any_value(a.n) AS n, any_value(b.n) AS m
    FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * o >= 90 * (n + m - o)),
both_ways AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, seen) AS (
    SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, both_ways.b FROM r JOIN both_ways ON r.seen = both_ways.a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(seen) AS component_id
FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, len(g)
"""


def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Documents linked at 90 % of their shingles of three words."""
    docs = load(spark, folder, "documents")
    return ngramjoin.near_components(docs, width=3, share=Fraction(9, 10))


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.document_packing(load(spark, folder, "documents"), tokenizer_path())


RULES = [
    links.Rule("com", "/", "allow"),
    links.Rule("example.com", "/en/", "block"),
    links.Rule("www.example.com", "/en/", "allow"),
    links.Rule("net", "/es/", "block"),
    links.Rule("net", "/fr/", "block"),
]


def op8_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return links.url_verdicts(load(spark, folder, "pages"), RULES)


def op6_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonyms.document_pseudonyms(load(spark, folder, "documents"), pseudonyms.session_key(spark))


OP7_SQL = r"""
WITH d AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM d, unnest(range(1, len(w) - 33)) AS t(i)),
again AS (SELECT k FROM x GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS j FROM x JOIN again USING (k), range(35) AS t(o)),
words AS (SELECT doc_id, j, w[j] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(j)),
kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text
    FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op7_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.repeated_words(load(spark, folder, "documents"))


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.cross_predicted(load(spark, folder, "documents"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_rules(load(spark, folder, "documents"))


def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.cross_scored(load(spark, folder, "documents"), load(spark, folder, "labels"))


def op12_sql() -> str:
    """Vectors and first codebook, then for each round the nearest entries and the next codebook."""
    assign = """a{k} AS MATERIALIZED (
    SELECT vec_id, any_value(label) AS label, p, any_value(y) AS y, min(o) // 256 AS d, min(o) % 256 AS e
    FROM (SELECT vec_id, label, p, y, e + 256 * CAST(list_sum(list_transform(range(len(y)),
              lambda i: (y[i + 1] - c[i + 1]) * (y[i + 1] - c[i + 1]))) AS BIGINT) AS o
          FROM parts JOIN b{k} USING (p))
    GROUP BY vec_id, p)"""
    learn = """b{n} AS MATERIALIZED (
    SELECT p, e, coalesce(m, c) AS c FROM b{k} LEFT JOIN (
        SELECT p, e, list(m ORDER BY i) AS m FROM (
            SELECT p, e, i, CAST(floor(CAST(sum(y[i + 1]) AS DOUBLE) / count(*)) AS BIGINT) AS m
            FROM a{k}, unnest(range(len(y))) AS t(i) GROUP BY p, e, i)
        GROUP BY p, e) USING (p, e))"""
    rounds = [step.format(k=k, n=k + 1) for k in range(6) for step in (assign, learn)]
    steps = ",\n".join([*rounds, assign.format(k=6)])
    return f"""WITH v AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS x FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
    SELECT vec_id, label, p, x[p * len(x) // 8 + 1:(p + 1) * len(x) // 8] AS y FROM v, range(8) AS t(p)),
b0 AS MATERIALIZED (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, y AS c
    FROM parts SEMI JOIN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16) USING (vec_id)),
{steps},
codes AS MATERIALIZED (
    SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
    FROM a6 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b6) AS codebooks_sha256
FROM codes"""


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vectorcodes.vector_codes(load(spark, folder, "embeddings"))


#: Equal runs of three words that lie q apart, in unbroken streaks, are the stretches of period q.
OP13_SQL = r"""
WITH h AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0,
        xor(4294967295::BIGINT, list_reduce(list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, CAST(i AS INT) + 1, 1))::BIGINT),
            lambda c, b: list_reduce(range(8)::BIGINT[], lambda r, k: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END), xor(c, b)), 4294967295::BIGINT)) AS h
    FROM documents),
p AS MATERIALIZED (
    SELECT *, CASE WHEN h % 10 = 0 AND len(w0) > 0 THEN (h // 10) % len(w0) END AS a,
        1 + (len(w0) - (h // 10) % greatest(len(w0), 1)) // (3 + (h // 10) % 8) AS p FROM h),
d AS MATERIALIZED (
    SELECT doc_id, CASE WHEN a IS NULL THEN w0
        ELSE list_transform(range(len(w0)), lambda i: w0[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM p),
g AS MATERIALIZED (
    SELECT doc_id, i, hash(w[i + 1], w[i + 2], w[i + 3]) AS x FROM d, unnest(range(len(w) - 2)) AS t(i)),
again AS MATERIALIZED (
    SELECT * FROM g SEMI JOIN (SELECT doc_id, x FROM g GROUP BY ALL HAVING count(*) > 1) USING (doc_id, x)),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM again a JOIN again b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i),
streaks AS (
    SELECT doc_id, q, min(i) AS s, count(*) + q + 2 AS n
    FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS r FROM pairs) GROUP BY doc_id, q, r),
runs AS MATERIALIZED (
    SELECT doc_id, s, n, min(q) AS q FROM streaks WHERE n >= greatest(6, 4 * q) GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id, j FROM runs, unnest(range(s + q, s + n)) AS t(j)),
told AS (
    SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s, n, q), (-(n::DOUBLE / q), s, q)) AS best,
        string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines
    FROM runs GROUP BY doc_id),
kept AS (
    SELECT doc_id, string_agg(w[j + 1], ' ' ORDER BY j) AS text
    FROM (SELECT doc_id, w, unnest(range(len(w))) AS j FROM d SEMI JOIN runs USING (doc_id)) ANTI JOIN gone USING (doc_id, j)
    GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.n AS length, best.q AS period,
    1000 * best.n // best.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
    sha256(coalesce(kept.text, array_to_string(w, ' '))) AS collapsed_sha256
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.run_digests(load(spark, folder, "documents"))


def queries() -> dict:
    """``name -> (callable(spark, folder), sql or None)``, the pipeline among them."""
    import corpus_pipeline

    return {
        "op1_fingerprints": (op1_fingerprints, None),
        "op2_ngram_join": (op2_ngram_join, OP2_SQL),
        "op3_packing": (op3_packing, None),
        "op4_hilbert_shards": (op4_hilbert_shards, None),
        "op5_mixing": (op5_mixing, None),
        "op6_pseudonyms": (op6_pseudonyms, None),
        "op7_repeats": (op7_repeats, OP7_SQL),
        "op8_url_verdicts": (op8_url_verdicts, None),
        "op9_language": (op9_language, None),
        "op10_quality_rules": (op10_quality_rules, None),
        "op11_toxicity": (op11_toxicity, None),
        "op12_vector_codes": (op12_vector_codes, op12_sql()),
        "op13_periodic_runs": (op13_periodic_runs, OP13_SQL),
        "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
    }
