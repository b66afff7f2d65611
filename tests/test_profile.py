"""Profiles by sketches against exact ones."""

import pytest
from pyspark.sql import functions as F

from textlab.operators import profile


def test_roles_and_shares_by_sketch(spark):
    n = 60_000
    i = F.col("id")
    df = spark.range(n).select(
        i.cast("string").alias("unique"), (i % 40_000).cast("string").alias("wide"), F.format_string("kind %d", i % 5).alias("few"),
        F.when(i % 10 < 9, "constant one").otherwise(i.cast("string")).alias("skewed"), F.when(i % 3 == 0, i).cast("string").alias("holes"),
        F.repeat(F.concat(i.cast("string"), F.lit(" word ")), 6).alias("text"), F.lit(None).cast("string").alias("nothing"),
    )
    exact, near = ({r["column"]: r for r in profile.classify_columns(profile.profile_columns(df, approximate=a)).collect()} for a in (False, True))
    for name, row in exact.items():
        assert near[name]["kind"] == row["kind"]
        assert abs(near[name]["top_share"] - row["top_share"]) <= profile.TOP_ERROR
        assert near[name]["num_unique"] == pytest.approx(row["num_unique"], rel=0.05)
    # No exchange of values: the plan shuffles one sketch per task and column.
    plan = profile.profile_columns(df, approximate=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
