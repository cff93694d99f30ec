"""Which situations changed between two versions of an agent, and how far two raters agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import fisher_at_least, wilson

# Calls a side needs, the level of significance, and the order in which verdicts are shown.
LEAST, ALPHA = 8, 0.05
VERDICTS = ["regression", "new", "disappeared", "unchanged", "improvement", "insufficient_data"]


def compare(rows: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """(cluster, counts, verdict, p, intervals): rows (cluster, version, failed). One shuffle of counts."""
    side = lambda v: (F.count_if(F.col("version") == v), F.count_if((F.col("version") == v) & F.col("failed")))
    (nb, fb), (nc, fc) = side(baseline), side(candidate)
    t = rows.groupBy("cluster").agg(nb.alias("n_base"), fb.alias("f_base"), nc.alias("n_cand"), fc.alias("f_cand")).filter("n_base + n_cand > 0")
    c = F.col
    t = t.withColumn("p_worse", fisher_at_least(c("f_cand"), c("n_cand"), c("f_base"), c("n_base")))
    t = t.withColumn("p_better", fisher_at_least(c("f_base"), c("n_base"), c("f_cand"), c("n_cand")))
    delta = c("f_cand") / F.nullif(c("n_cand"), F.lit(0)) - c("f_base") / F.nullif(c("n_base"), F.lit(0))
    verdict = (
        F.when(c("n_base") == 0, "new").when(c("n_cand") == 0, "disappeared").when((c("n_base") < LEAST) | (c("n_cand") < LEAST), "insufficient_data")
        .when((c("p_worse") < ALPHA) & (c("delta") > 0), "regression").when((c("p_better") < ALPHA) & (c("delta") < 0), "improvement").otherwise("unchanged")
    )
    p = F.when(c("verdict") == "regression", c("p_worse")).when(c("verdict") == "improvement", c("p_better")).when(c("verdict") == "unchanged", F.least("p_worse", "p_better"))
    t = t.withColumn("delta", delta).withColumn("verdict", verdict).withColumn("p", p)
    ends = {f"{s}_{e}": wilson(c(f"f_{s}"), c(f"n_{s}"), e == "high") for s in ("base", "cand") for e in ("low", "high")}
    return t.withColumns(ends).drop("p_worse", "p_better")


def ordered(diffs: DataFrame) -> DataFrame:
    """Regressions first, then by the size of the change."""
    rank = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))
    return diffs.orderBy(rank, F.desc(F.abs(F.coalesce("delta", F.lit(0.0)))), "cluster")


def overall(diffs: DataFrame) -> DataFrame:
    """One row: each version's failures over all compared clusters, and how the rate moved."""
    total = diffs.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_base", "f_base", "n_cand", "f_cand")), F.count_if(F.col("verdict") == "regression").alias("regressions"))
    rate = lambda v: F.coalesce(F.try_divide(F.col(f"f_{v}"), F.col(f"n_{v}")), F.lit(0.0))
    return total.withColumns({"rate_base": rate("base"), "rate_cand": rate("cand")}).withColumns({"delta": F.col("rate_cand") - F.col("rate_base"), "should_block": F.col("regressions") > 0})


def agreement(pairs: DataFrame) -> DataFrame:
    """One row for booleans a and b: agreement and Cohen's kappa (1 where chance alone would agree)."""
    t = pairs.agg(F.count("*").alias("n"), F.avg(F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)).alias("agreement"), F.avg(F.col("a").cast("double")).alias("rate_a"), F.avg(F.col("b").cast("double")).alias("rate_b"))
    t = t.withColumn("chance", F.col("rate_a") * F.col("rate_b") + (1 - F.col("rate_a")) * (1 - F.col("rate_b")))
    return t.withColumn("kappa", F.when(F.col("chance") >= 1, 1.0).otherwise((F.col("agreement") - F.col("chance")) / (1 - F.col("chance"))))
