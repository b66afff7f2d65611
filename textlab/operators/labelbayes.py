"""Multi-label naive Bayes in closed form: all labels from one count of (label, term).

For one label the model is the multinomial naive Bayes with smoothing 1 of its rows, each counted
``pos_weight`` times, against all other rows. A term that no row of the label has adds a part that is
the same for all labels and a part that depends on the label alone. So only terms that occur with a
label are kept for it, and fitting and scoring take the same number of passes however many labels
there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.functions.groups import join_on, lookup_join, small_table
from textlab.functions.labels import parse_labels
from textlab.functions.text import tokens
from textlab.operators.labels import POS_WEIGHT_CAP
from textlab.session import written


@dataclass
class LabelBayes:
    """``terms`` (term, the ``lift`` of all labels, and ``own``, that of each label that has the term)
    and ``labels`` (label, prior, shift)."""

    terms: DataFrame
    labels: DataFrame

    def save(self, path: str) -> None:
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.labels.write.mode("overwrite").parquet(f"{path}/labels")

    @classmethod
    def load(cls, spark, path: str) -> LabelBayes:
        return cls(spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/labels"))

    def margins(self, df: DataFrame, text: str, id_col: str) -> DataFrame:
        """``(id_col, label, lift, n_terms)``: of each row the sum over its known terms for the labels
        that have one of them, and, without a label, for all labels."""
        found = df.select(id_col, F.explode(tokens(F.col(text))).alias("term"))
        counts = found.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n"))
        # A row per term, which is met once. A text counts a term once, and the terms are a table in
        # files, so where a term is in most of very short texts, adaptive execution splits its rows.
        met = counts.join(small_table(self.terms), "term")
        every = F.struct(F.lit(None).cast("string").alias("label"), F.col("lift"))
        long = met.select(id_col, "n", F.inline(F.concat(F.array(every), F.col("own"))))
        return long.groupBy(id_col, "label").agg(F.sum(F.col("n") * F.col("lift")).alias("lift"), F.sum("n").alias("n_terms"))

    def score(self, df: DataFrame, text: str, id_col: str) -> DataFrame:
        """``df`` with the sorted ``predicted`` labels, those with a margin of 0 or more.

        ``id_col`` is unique. Terms that the training rows don't have say nothing, so a row without
        known terms (a null or empty text too) is judged by the priors. The labels are one array of
        the plan, a row per label; a row of the result has the predicted ones only.
        """
        one = F.struct("label", "prior", "shift")
        every = self.labels.agg(F.sort_array(F.collect_list(one)).alias("v")).scalar()
        sums = self.margins(df, text, id_col)
        # At most as many as there are labels.
        told = sums.groupBy(id_col).agg(
            F.max(F.when(F.col("label").isNull(), F.struct("lift", "n_terms"))).alias("_all"),
            F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "lift"))).alias("_met"),
        )
        rows = join_on(df, told, [id_col], "left").withColumn("_every", every)
        shared = F.coalesce(F.col("_all.lift"), F.lit(0.0))
        n = F.coalesce(F.col("_all.n_terms"), F.lit(0))
        names = F.transform("_every", lambda x: x["label"])
        met = F.transform("_met", lambda x: x["label"])

        def margin(x: Column, lift) -> Column:
            return x["prior"] + n * x["shift"] + shared + lift

        own = F.filter("_met", lambda m: margin(F.get(F.col("_every"), F.array_position(names, m["label"]).cast("int") - 1), m["lift"]) >= 0)
        others = F.filter("_every", lambda x: margin(x, F.lit(0.0)) >= 0)
        untouched = F.array_except(F.transform(others, lambda x: x["label"]), F.coalesce(met, F.array().cast("array<string>")))
        chosen = F.concat(F.coalesce(F.transform(own, lambda x: x["label"]), F.array().cast("array<string>")), untouched)
        return rows.select(*df.columns, F.array_sort(chosen).alias("predicted"))


def fit_label_bayes(train: DataFrame, text: str, label: str) -> LabelBayes:
    """All labels of a multi-label column at once, from two aggregates of the training rows.

    Null and empty texts count as rows without terms, null labels as rows without labels, repeated
    rows count each. A table without labels gives a model that predicts none.
    """
    mine = F.coalesce(F.array_distinct(parse_labels(train, label)), F.array().cast("array<string>"))
    terms = F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))
    # Rows with the same labels are counted together. The entry without a label counts all rows.
    rows = train.select(F.array_sort(mine).alias("labels"), terms.alias("terms"))
    each = F.explode(F.concat(F.col("labels"), F.array(F.lit(None).cast("string")))).alias("label")
    alike = rows.select("labels", F.explode("terms").alias("term")).groupBy("labels", "term").agg(F.count(F.lit(1)).alias("n"))
    counts = written(alike.select(each, "term", "n").groupBy("label", "term").agg(F.sum("n").alias("n")), "label_terms")
    whole = counts.filter("label is null").agg(F.struct(F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.count(F.lit(1)).alias("different")).alias("v"))
    sets = rows.groupBy("labels").agg(F.count(F.lit(1)).alias("n"))
    n_rows = sets.select(each, "n").groupBy("label").agg(F.sum("n").alias("n_rows"))
    sizes = join_on(n_rows, counts.groupBy("label").agg(F.sum("n").alias("n_terms")), ["label"], "left").fillna(0, ["n_terms"])
    sizes = written(sizes, "label_sizes")
    n = F.coalesce(sizes.filter("label is null").select("n_rows").scalar(), F.lit(0))
    weight = F.least(F.greatest(F.col("n") - F.col("n_rows"), F.lit(1)) / F.greatest("n_rows", F.lit(1)), F.lit(POS_WEIGHT_CAP))
    told = sizes.filter("label is not null").withColumn("n", n).withColumn("v", whole.scalar()).withColumn("weight", weight)
    inside = F.col("weight") * F.col("n_terms") + F.col("v.different")
    outside = F.col("v.terms") - F.col("n_terms") + F.col("v.different")
    labels = told.select(
        "label", "weight",
        (F.ln(F.col("weight") * F.col("n_rows") + 1) - F.ln(F.col("n") - F.col("n_rows") + 1)).alias("prior"),
        F.when(F.col("v.different") > 0, F.ln(outside) - F.ln(inside)).otherwise(0.0).alias("shift"),
    )
    own = lookup_join(counts.filter("label is not null"), labels.select("label", "weight"), ["label"])
    both = own.unionByName(counts.filter("label is null").withColumn("weight", F.lit(None).cast("double")))
    # At most as many entries as there are labels.
    of_term = both.groupBy("term").agg(
        F.max(F.when(F.col("label").isNull(), F.col("n"))).alias("total"),
        F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "n", "weight"))).alias("own"),
    )
    total = F.col("total")

    def lift(x: Column) -> Column:
        return F.struct(x["label"].alias("label"), (F.ln(x["weight"] * x["n"] + 1) - F.ln(total - x["n"] + 1) + F.ln(total + 1)).alias("lift"))

    terms = of_term.select("term", (-F.ln(total + 1)).alias("lift"), F.transform("own", lift).alias("own"))
    model = LabelBayes(terms, labels.select("label", "prior", "shift"))
    return LabelBayes(written(model.terms, "label_bayes"), written(model.labels, "label_priors"))
