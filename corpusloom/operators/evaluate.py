"""Checks of rankings against expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(rankings: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, check, passed). rankings is (case_id, key, rank); cases (case_id, first, expected_top, expected_all,
    ranked_below, excluded, max_results), any of which may be null."""
    listed = [("first", F.array("first")), ("expected_top", F.col("expected_top")), ("expected_all", F.col("expected_all")), ("ranked_below", F.col("ranked_below")), ("excluded", F.col("excluded"))]
    one = lambda name, keys: cases.select("case_id", F.lit(name).alias("check"), F.explode(F.array_compact(keys)).alias("key"))
    wanted = one(*listed[0])
    for pair in listed[1:]:
        wanted = wanted.union(one(*pair))
    placed = wanted.join(rankings, ["case_id", "key"], "left")
    lowest_top = placed.filter("check = 'expected_top'").groupBy("case_id").agg(F.max(F.coalesce("rank", F.lit(1 << 30))).alias("top"))
    placed = placed.join(lowest_top, "case_id", "left")
    ok = (
        F.when(F.col("check") == "first", F.coalesce(F.col("rank") == 1, F.lit(False)))
        .when(F.col("check") == "expected_top", F.coalesce(F.col("rank") <= 3, F.lit(False)))
        .when(F.col("check") == "expected_all", F.col("rank").isNotNull())
        .when(F.col("check") == "excluded", F.col("rank").isNull())
        .otherwise(F.col("rank").isNull() | F.col("top").isNull() | (F.col("rank") > F.col("top")))
    )
    verdicts = placed.groupBy("case_id", "check").agg(F.bool_and(ok).alias("passed"))
    sizes = rankings.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    limits = cases.filter("max_results is not null").join(sizes, "case_id", "left").select("case_id", F.lit("max_results").alias("check"), (F.coalesce("n", F.lit(0)) <= F.col("max_results")).alias("passed"))
    return verdicts.unionByName(limits)
