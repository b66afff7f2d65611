"""The pipeline's stages, each on what the one before has kept."""

import re
from collections import Counter
from fractions import Fraction

import pytest

import corpus_pipeline
from textlab.llm import language, mixing, packing
from textlab.sources.tables import load


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    frames = {"documents": load(spark, small, "documents")}
    docs = frames["documents"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(str(folder / name))
        docs = frames[name] = spark.read.parquet(str(folder / name))
    return frames


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_language_keeps_all_documents_with_a_language(stages):
    kept = ids(stages["language"])
    model = language.fit(stages["documents"])
    names, scores = model.score([r["text"] for r in stages["documents"].collect()])
    wanted = [r["doc_id"] for r, n, s in zip(stages["documents"].collect(), names, scores) if n != language.UNKNOWN and s >= 0.5]
    assert kept == Counter(wanted) and len(kept) > 190


def test_one_of_each_group_stays(stages):
    rows = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in r["text"])) for r in stages["language"].collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in rows.items()}
    label = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if i < j and both and both >= Fraction(4, 5) * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    assert ids(stages["near_copies"]) == Counter({i: 1 for i in set(label.values())})


def test_personal_data_changes_texts_only(stages):
    before = {r["doc_id"]: r for r in stages["near_copies"].collect()}
    after = {r["doc_id"]: r for r in stages["personal_data"].collect()}
    assert before.keys() == after.keys() and not any(re.search(r"[a-z]\.\d+@mail\d", r["text"]) for r in after.values())
    assert all(r["source"] == before[i]["source"] and r["n_chars"] == before[i]["n_chars"] for i, r in after.items())


def test_mix_and_packing(spark, stages, small):
    copies = {r["doc_id"]: r["copies"] for r in mixing.document_mix(stages["personal_data"]).collect()}
    assert ids(stages["mix"]) == Counter({i: n for i, n in copies.items() if n})
    rows = stages["packing"].collect()
    tokens = Counter()
    for r in rows:
        tokens[r["doc_id"]] += r["length"]
    per_row = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert all(tokens[i] == n * per_row[i] for i, n in copies.items() if n)
    assert len({r["sequence_id"] for r in rows}) == len(rows) and packing.lengths(5000) == [4096, 512, 256, 128, 8]
    assert corpus_pipeline.run(spark, small).count() == len(rows)
