"""How far two labellers agree on the calls that both have labelled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import kappa_reading
from ..functions.text import normalise
from .versions import agreement


def both(a: DataFrame, b: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(id, and for each side situation, failed, is_new, kind): kind is null where they agree. a, b: (id, situation, failed, is_new)"""
    side = lambda df, s: df.select("id", normalise(F.col("situation"), aliases).alias(f"situation_{s}"), F.col("failed").alias(f"failed_{s}"), F.col("is_new").alias(f"is_new_{s}"))
    rows = side(a, "a").join(side(b, "b"), "id")
    same, agree = F.col("situation_a") == F.col("situation_b"), F.col("failed_a") == F.col("failed_b")
    return rows.withColumn("kind", F.when(same & agree, None).when(same, "failure_only").when(agree, "situation_only").otherwise("both"))


def report(rows: DataFrame) -> DataFrame:
    """One row from both(): agreement, kappa with its reading, rates, and disagreements by kind. No shared call is an error when it runs."""
    rate = lambda c: F.avg(F.col(c).cast("int"))
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("situation_only", "failure_only", "both")]
    more = rows.agg(F.avg((F.col("situation_a") == F.col("situation_b")).cast("int")).alias("situation_agreement"), rate("is_new_a").alias("new_rate_a"), rate("is_new_b").alias("new_rate_b"), *kinds)
    kappa = agreement(rows.select(F.col("failed_a").cast("int").alias("a"), F.col("failed_b").cast("int").alias("b")))
    kappa = kappa.withColumn("n", F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("the labellers share no calls")).cast("long")))
    return kappa.withColumn("reading", kappa_reading(F.col("kappa"))).drop("chance").crossJoin(more)


def only_in(rows: DataFrame, side: str) -> DataFrame:
    """(situation) that only side a or b has."""
    other = "b" if side == "a" else "a"
    return rows.select(F.col(f"situation_{side}").alias("situation")).distinct().exceptAll(rows.select(F.col(f"situation_{other}").alias("situation")).distinct())
