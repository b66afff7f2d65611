"""Every operator over the odd table and the empty one: no crash, and the stated results."""

import pytest

from textlab.llm import (
    fingerprints, language, links, mixing, ngramjoin, packing, periodic, pseudonyms, quality, repeats, sharding, toxicity,
    vectorcodes,
)
from textlab.llm.catalog import RULES, tokenizer_path

RULE_TABLE = RULES
OPERATORS = {
    "fingerprints": lambda d: fingerprints.fingerprints(d),
    "edited_next": lambda d: fingerprints.edited_next(d),
    "near_components": lambda d: ngramjoin.near_components(d),
    "packing": lambda d: packing.document_packing(d, tokenizer_path()),
    "pieces": lambda d: packing.pieces(d, tokenizer_path()),
    "shards": lambda d: sharding.document_shards(d),
    "own_shards": lambda d: sharding.hilbert_shards(d, ["source", "n_chars"], "doc_id", 4),
    "mix": lambda d: mixing.document_mix(d),
    "pseudonyms": lambda d: pseudonyms.pseudonymised(d, "k"),
    "repeats": lambda d: repeats.repeated_words(d),
    "urls": lambda d: links.url_verdicts(d, RULE_TABLE, "doc_id", "text", "lang"),
    "language": lambda d: language.cross_predicted(d),
    "quality": lambda d: quality.quality_rules(d),
    "toxicity": lambda d: toxicity.cross_scored(d, d.selectExpr("doc_id", "doc_id % 2 as toxic")),
    "unlabelled": lambda d: toxicity.cross_scored(d, d.selectExpr("doc_id", "cast(null as int) as toxic")),
    "run_digests": lambda d: periodic.run_digests(d),
    "runs": lambda d: periodic.with_runs(d),
}
CHANGES_ROWS = {"packing", "pieces"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, name):
    rows = OPERATORS[name](odd).collect()
    if name not in CHANGES_ROWS:
        assert len(rows) == 12


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(empty, name):
    assert OPERATORS[name](empty).collect() == []


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_odd_fingerprints(odd):
    rows = by_id(fingerprints.fingerprints(odd).collect())
    assert rows[1]["fingerprint"] == rows[2]["fingerprint"] == rows[3]["fingerprint"] == ""
    assert rows[5]["fingerprint"] == rows[6]["fingerprint"] != ""
    assert rows[5]["n_shingles"] == 1 and rows[4]["n_chars"] > 500_000


def test_odd_components(odd):
    rows = by_id(ngramjoin.near_components(odd).collect())
    assert rows[1]["n_shingles"] == 0 and rows[1]["component_id"] == 1
    assert rows[6]["component_id"] == 5 and rows[7]["component_id"] == 7 and rows[7]["n_shingles"] == 10
    assert rows[None]["component_id"] is None


def test_odd_distinct(odd):
    kept = ngramjoin.distinct_documents(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9]


def test_odd_repeats(odd):
    rows = by_id(repeats.repeated_words(odd).collect())
    assert rows[1]["n_words"] == 0 == rows[1]["n_removed"]
    assert rows[7]["n_words"] == 200 == rows[7]["n_removed"]
    assert rows[5]["n_removed"] == 0


def test_odd_mixture(odd, empty):
    mixed = mixing.mixture(odd)
    assert mixed.columns == odd.columns
    assert all(r["text"] for r in mixed.collect())
    assert mixing.mixture(empty).collect() == []


def test_odd_languages(odd):
    rows = by_id(language.cross_predicted(odd).collect())
    assert rows[1]["lang_pred"] == rows[9]["lang_pred"] == language.UNKNOWN and rows[9]["score"] == 0
    assert rows[5]["lang_pred"] != language.UNKNOWN


def test_odd_pseudonyms(odd):
    rows = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymised(odd, "k").collect()}
    assert rows == {r["doc_id"]: r["text"] for r in odd.collect()}


def test_odd_quality(odd):
    rows = by_id(quality.quality_rules(odd).collect())
    assert rows[1]["base_failed"] and not rows[1]["kept"] and rows[7]["n_repeat_words"] == 200
    assert rows[8]["n_symbols"] == 6


def test_without_repeats_keeps_columns(spark, odd):
    unique = odd.filter("doc_id is not null and doc_id != 7")
    out = repeats.without_repeats(unique)
    assert out.columns == odd.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()}[5] == "short text"


def test_odd_toxicity(odd):
    nothing = by_id(OPERATORS["unlabelled"](odd).collect())
    assert {r["predicted"] for r in nothing.values()} == {0}
    rows = OPERATORS["toxicity"](odd).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert by_id(rows)[1]["score"] == by_id(rows)[2]["score"]
    assert not by_id(rows)[None]["held_out"]


def test_odd_runs(odd):
    rows = by_id(periodic.with_runs(odd).collect())
    assert periodic.with_runs(odd).columns == [*odd.columns, "runs", "collapsed"]
    assert rows[1]["runs"] == rows[3]["runs"] == [] and rows[1]["collapsed"] == rows[3]["collapsed"] == ""
    assert [tuple(r) for r in rows[7]["runs"]] == [(0, 200, 10)]
    assert rows[7]["collapsed"] == "one two three four five six seven eight nine ten"
    # Every second word of the long text is the same, and the rest repeat after 977.
    assert [tuple(r) for r in rows[4]["runs"]] == [(0, 120_000, 1954)]


VECTORS = "vec_id bigint, embedding array<double>, label string, code string, error string, x string, id string"


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    fine = [(i, [float(i + k) for k in range(8)], "a" if i % 2 else None) for i in range(20)]
    bad = [
        (20, None, "a"), (21, [], "a"), (22, [None] * 8, "a"), (23, [nan] + [0.0] * 7, "a"), (24, [inf] + [0.0] * 7, "a"),
        (25, [1.0] * 7, "a"), (26, [1.0] * 16, "a"), (27, [1e30] + [0.0] * 7, None), (None, None, None),
    ]
    again = [(3, fine[3][1], "a"), (None, fine[5][1], "b")]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in fine + bad + again], VECTORS).repartition(3)
    rows = vectorcodes.vector_codes(df).collect()
    assert sorted(r["vec_id"] is None or r["vec_id"] for r in rows) == sorted([*range(20), 3, True])
    assert len({r["code"] for r in rows if r["vec_id"] == 3}) == 1
    sums = {}
    for r in rows:
        key = "b" if r["vec_id"] is None else fine[r["vec_id"]][2]
        sums.setdefault(key, [0, set()])
        sums[key][0] += r["error"]
        sums[key][1].add(r["label_error"])
    assert all(found == {total} for total, found in sums.values()) and len(sums) == 3
    few = vectorcodes.vector_codes(df.filter("vec_id < 2")).collect()
    assert {r["code"] for r in few} == {"00" * 8, "01" * 8} and {r["error"] for r in few} == {0}
    assert vectorcodes.vector_codes(df.filter("vec_id > 19 and vec_id <> 26")).collect() == []
    assert vectorcodes.vector_codes(df.limit(0)).collect() == []
