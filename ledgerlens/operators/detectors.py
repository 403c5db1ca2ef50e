"""Detectors: what the values recorded for a subject say about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_entropy(annotations: DataFrame, threshold: float | None = None) -> DataFrame:
    """(subject, state, score) of (subject, body): the share of different values among all but one."""
    per = annotations.groupBy("subject").agg(F.count("*").alias("n"), F.countDistinct(F.get_json_object("body", "$.value")).alias("d"))
    score = F.when(F.col("n") <= 1, 0.0).otherwise((F.col("d") - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    scored = per.select("subject", score.cast("double").alias("score"))
    return scored.select("subject", F.when(F.col("score") == 0, "green").when(F.col("score") <= (1.0 if threshold is None else threshold), "yellow").otherwise("red").alias("state"), "score")


def rate_tolerance(annotations: DataFrame, threshold: float | None = None) -> DataFrame:
    """(subject, state, score) of (subject, actor_kind, body): the measured breach rate against what is tolerated.

    A human's tolerance outranks an agent's, which outranks the threshold; no check yet is yellow.
    """
    number = lambda key, kind: F.max(F.when(F.col("actor_kind") == kind, F.expr(f"try_cast(get_json_object(body, '$.{key}') AS DOUBLE)")))
    per = annotations.groupBy("subject").agg(number("breach_rate", "function").alias("rate"), F.coalesce(number("tolerance", "human"), number("tolerance", "agent"), F.lit(threshold).cast("double"), F.lit(0.0)).alias("tolerance"))
    fine = F.col("rate") <= F.col("tolerance")
    return per.select("subject", F.when(F.col("rate").isNull(), "yellow").when(fine, "green").otherwise("red").alias("state"), F.when(F.col("rate").isNull() | fine, 0.0).otherwise(F.least(F.greatest("rate", F.lit(0.0)), F.lit(1.0))).alias("score"))
