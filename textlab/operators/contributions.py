"""What each word of a text adds to the linear score of its predicted class.

A linear classifier over hashed terms is a table of weights by bucket and class. The terms of a text,
its words and the pairs of neighbours where the model has pairs, are hashed by the model's own stage
and meet that table. The weight of a pair is shared by its two words. So the words of a text
add up to its score without the intercept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import NaiveBayesModel
from pyspark.ml.feature import HashingTF, IDFModel, NGram
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.functions.text import tokens


def stage_of(model: PipelineModel, kind):
    return next((s for s in model.stages if isinstance(s, kind)), None)


def weight_matrix(model: PipelineModel) -> np.ndarray:
    """Weights of the hashed counts, one row per class; scaling stages are part of them."""
    last = model.stages[-1]
    if isinstance(last, NaiveBayesModel):
        weights = last.theta.toArray()
    else:
        weights = last.coefficientMatrix.toArray()
        # With two classes there is one margin, which the first class has with the other sign.
        weights = np.vstack([-weights, weights]) if len(weights) == 1 else weights
    scaling = stage_of(model, IDFModel)
    return weights if scaling is None else weights * scaling.idf.toArray()


#: Weights that are sent to all tasks, as scoring does with the whole model; a larger table is joined.
SENT_WEIGHTS = 1 << 24


def weight_table(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """``(bucket, weights)``: the weights of all classes, for the buckets that have any."""
    weights = weight_matrix(model)
    bucket = np.flatnonzero(weights.any(axis=0))
    ends = np.arange(len(bucket) + 1, dtype=np.int32) * len(weights)
    each = pa.ListArray.from_arrays(ends, np.ascontiguousarray(weights[:, bucket].T).ravel())
    return spark.createDataFrame(pa.table({"bucket": bucket.astype(np.int32), "weights": each}))


def class_table(spark: SparkSession, weights: np.ndarray) -> DataFrame:
    """``(class_id, weights)``: the weights of a class, one for each bucket."""
    ends = np.arange(len(weights) + 1, dtype=np.int32) * weights.shape[1]
    each = pa.ListArray.from_arrays(ends, np.ascontiguousarray(weights).ravel())
    return spark.createDataFrame(pa.table({"class_id": np.arange(len(weights), dtype=np.int32), "weights": each}))


def terms(model: PipelineModel, rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, class_id, term, first, second)``: the terms of each row, as often as it has them.

    ``class_id`` is the predicted class; ``second`` is null for single words.
    """
    scored = model.transform(rows).select(
        id_col, F.col("prediction").cast("int").alias("class_id"), tokens(F.col(text)).alias("_words")
    )
    none = F.lit(None).cast("string")
    found = F.transform("_words", lambda w: F.struct(w.alias("term"), w.alias("first"), none.alias("second")))
    if stage_of(model, NGram) is not None:
        words = F.col("_words")
        at = F.when(F.size(words) > 1, F.sequence(F.lit(0), F.size(words) - 2)).otherwise(F.array().cast("array<int>"))
        pair = lambda a, b: F.struct(F.concat_ws(" ", a, b).alias("term"), a.alias("first"), b.alias("second"))
        found = F.concat(found, F.transform(at, lambda i: pair(F.get(words, i), F.get(words, i + 1))))
    return scored.select(id_col, "class_id", F.inline(found))


def bucketed(model: PipelineModel, found: DataFrame) -> DataFrame:
    """``found`` with the bucket that the model hashes each term to."""
    hashing = stage_of(model, HashingTF)
    one = found.withColumn(hashing.getInputCol(), F.array("term"))
    vector = F.unwrap_udt(F.col(hashing.getOutputCol()))
    return hashing.transform(one).select(*found.columns, F.get(vector["indices"], F.lit(0)).alias("bucket"))


def places(model: PipelineModel, rows: DataFrame, id_col: str) -> DataFrame:
    """``(id, class_id, word, next)``: the words of each row, with their followers where the model has pairs."""
    pairs, words = stage_of(model, NGram), F.col("_words")
    found = (stage_of(model, HashingTF) if pairs is None else pairs).getInputCol()
    scored = model.transform(rows).select(id_col, F.col("prediction").cast("int").alias("class_id"), F.col(found).alias("_words"))
    after = lambda i: F.lit(None).cast("string") if pairs is None else F.get(words, i + 1)
    return scored.select(id_col, "class_id", F.inline(F.transform(words, lambda w, i: F.struct(w.alias("word"), after(i).alias("next")))))


def place_shares(model: PipelineModel, found: DataFrame, id_col: str, weights: np.ndarray) -> DataFrame:
    """``(id, word, next, own, pair)``: the weights of the word and of the pair at each place.

    The word and its pair are hashed together. The pair is counted twice, so that the counts tell the buckets apart:
    1 is the word, 2 the pair, and 3 a bucket that they share.
    """
    hashing, pair = stage_of(model, HashingTF), F.concat_ws(" ", "word", "next")
    both = F.when(F.col("next").isNull(), F.array("word")).otherwise(F.array(F.col("word"), pair, pair))
    vector = F.unwrap_udt(F.col(hashing.getOutputCol()))
    hashed = hashing.transform(found.withColumn(hashing.getInputCol(), both))
    met = hashed.select(*found.columns, vector["indices"].alias("_at"), vector["values"].alias("_n")).join(
        F.broadcast(class_table(found.sparkSession, weights)), "class_id", "left"
    )
    weight = [F.coalesce(F.get("weights", F.get("_at", F.lit(k))), F.lit(0.0)) for k in (0, 1)]
    of = lambda n: sum(F.when(F.get("_n", F.lit(k)).isin(n, 3), weight[k]).otherwise(0.0) for k in (0, 1))
    return met.select(id_col, "word", "next", of(1).alias("own"), of(2).alias("pair"))


def word_contributions(model: PipelineModel, rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, word, contribution)``: the share of each word in the linear score of the predicted
    class, with its sign. A row without words has none.

    Ids are expected to be unique. The texts are dealt out by id once. All terms of a row are then in
    one task, where they meet the weights and are summed, so that no term is shuffled. A model of more than
    SENT_WEIGHTS numbers is joined by bucket instead.
    """
    dealt, weights = rows.select(id_col, text).repartition(id_col), weight_matrix(model)
    if weights.size <= SENT_WEIGHTS:
        half = F.col("pair") / 2
        own = F.struct("word", (F.col("own") + half).alias("_share"))
        parts = F.array(own, F.struct(F.col("next").alias("word"), half.alias("_share")))
        met = place_shares(model, places(model, dealt, id_col), id_col, weights)
        shares = met.select(id_col, F.inline(F.when(F.col("next").isNull(), F.array(own)).otherwise(parts)))
    else:
        long = bucketed(model, terms(model, dealt, id_col, text))
        met = long.join(weight_table(rows.sparkSession, model), "bucket", "left")
        weight = F.coalesce(F.get("weights", F.col("class_id")), F.lit(0.0))
        words = F.when(F.col("second").isNull(), F.array("first")).otherwise(F.array("first", "second"))
        shares = met.select(id_col, F.explode(words).alias("word"), (weight / F.size(words)).alias("_share"))
    return shares.groupBy(id_col, "word").agg(F.sum("_share").alias("contribution"))
