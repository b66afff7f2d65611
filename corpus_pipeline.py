"""From raw documents to packed training sequences, in five stages.

Each stage works on all rows that its predecessor kept, and all but the last return the columns
of ``documents``. Between stages the rows are a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.llm import language, mixing, ngramjoin, packing, pseudonyms
from textlab.llm.catalog import tokenizer_path
from textlab.llm.common import stored
from textlab.sources.tables import load

#: A document is rejected if its language is unknown or less certain than this.
LEAST_CERTAINTY = 0.5
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Whole texts that a packing worker gets at a time.
PACKED_ROWS = 1000


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled rows have; no text or no letters, none.

    Without any labelled row nothing is known, and all documents with letters would go. Repeated
    rows are judged alike; no rows give none.
    """
    model = language.fit(docs)
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    judged = language.predict(row, model)
    kept = judged.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_CERTAINTY))
    return kept.select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies.

    Documents without words are near to none and all stay; of rows that repeat an id one stays. No
    rows give none.
    """
    return ngramjoin.distinct_documents(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the personal data of their texts replaced under the key of the session.

    Null and empty texts, repeated rows and other columns stay as they are; no rows give none.
    """
    return pseudonyms.pseudonymised(docs, pseudonyms.session_key(spark))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, as repeated rows.

    Documents without words, null and empty texts among them, are not taken; null sources are one
    source. No rows give none.
    """
    return mixing.mixture(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, one piece a sequence; repeated rows are packed each.

    Null and empty texts are the end token alone. No rows give none. Texts go to the workers in batches
    of at most PACKED_ROWS rows, for the rest of the session: a batch is held twice, by Spark and by the worker.
    """
    rows = int(spark.conf.get(BATCH_ROWS))
    # No limit is 0 or less.
    spark.conf.set(BATCH_ROWS, str(min(rows, PACKED_ROWS) if rows > 0 else PACKED_ROWS))
    return packing.document_packing(docs, tokenizer_path())


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_each),
    ("personal_data", without_personal_data),
    ("mix", mixed_sources),
    ("packing", packed_sequences),
]

#: Naive Bayes, components and tokenizers are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the whole table of documents."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
