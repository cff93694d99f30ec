"""Clusters of synonymous slugs, their rollup, and coverage by declared scenarios.

labels: (id, ord, situation, failed, conditions, flags, version, confidence, cost), and where they are known
situation_label, is_new and mode. `ord` is the order of ingest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SIMILAR, jaccard, normalise, tokens

#: Up to so many distinct situations are folded in one expression; more are folded as a stream.
SLUGS_MOST = 5000
# The smallest cluster that is ranked; shares and counts from which conditions and flags count; modes that are kept.
LEAST = 3
OBSERVED, CRITICAL_RATE, CRITICAL_COUNT, COMPLIANCE_RATE = 0.25, 0.15, 2, 0.1
MODES = 6
KEYS = "array<struct<slug:string,tokens:array<string>,guarded:boolean>>"


def fold_in_stream(batches):
    """Slugs in order of appearance join the first similar key. Keys are found by their tokens, so this takes memory for keys only."""
    import pyarrow as pa

    keys: list[tuple[str, set, bool]] = []
    by_token: dict[str, list[int]] = {}
    for b in batches:
        out = []
        for slug, words, guarded in zip(*(b.column(c).to_pylist() for c in ("slug", "tokens", "guarded")), strict=True):
            own = set(words)
            near = sorted({i for w in own for i in by_token.get(w, ())})
            fits = (i for i in near if not (guarded and keys[i][2]) and len(own & keys[i][1]) >= SIMILAR * len(own | keys[i][1]))
            at = next(fits, None)
            if at is None:
                at = len(keys)
                keys.append((slug, own, guarded))
                for w in own:
                    by_token.setdefault(w, []).append(at)
            out.append(keys[at][0])
        yield pa.RecordBatch.from_arrays([b.column("slug"), pa.array(out, pa.string())], names=["slug", "cluster"])


def cluster_keys(labels: DataFrame, aliases: dict[str, str] | None = None, protected: list[str] | None = None, most: int = SLUGS_MOST) -> DataFrame:
    """(slug, cluster): slugs in order of appearance join the first key that is similar, or become keys.

    Two protected slugs, which the suite declares separately, never join. The fold reads
    distinct slugs only; their number is that of kinds of calls, not of calls.
    """
    guarded = [*(protected or [])]
    slugs = labels.groupBy(normalise(F.col("situation"), aliases).alias("slug")).agg(F.min("ord").alias("first"))
    slugs = slugs.select("first", "slug", tokens(F.col("slug"), aliases).alias("tokens"), (F.col("slug").isin(guarded) if guarded else F.lit(False)).alias("guarded"))
    if slugs.limit(most + 1).count() > most:
        return slugs.repartition(1).sortWithinPartitions("first", "slug").mapInArrow(fold_in_stream, "slug string, cluster string")
    one = slugs.agg(F.array_sort(F.collect_list(F.struct("first", "slug", "tokens", "guarded"))).alias("all"))

    def step(acc: Column, s: Column) -> Column:
        near = F.filter(acc["keys"], lambda k: ~(k["guarded"] & s["guarded"]) & (jaccard(k["tokens"], s["tokens"]) >= SIMILAR))
        key = F.coalesce(F.get(near, F.lit(0))["slug"], s["slug"])
        fresh = F.when(F.size(near) == 0, F.array(F.struct(*(s[c].alias(c) for c in ("slug", "tokens", "guarded"))))).otherwise(F.array().cast(KEYS))
        return F.struct(F.concat(acc["keys"], fresh).alias("keys"), F.concat(acc["out"], F.array(F.struct(s["slug"].alias("slug"), key.alias("cluster")))).alias("out"))

    start = F.struct(F.array().cast(KEYS).alias("keys"), F.array().cast("array<struct<slug:string,cluster:string>>").alias("out"))
    return one.select(F.explode(F.aggregate("all", start, step, lambda a: a["out"])).alias("x")).select("x.*")


def clustered(labels: DataFrame, aliases: dict[str, str] | None = None, protected: list[str] | None = None) -> DataFrame:
    """The labels with their slug and cluster. Spark broadcasts the keys if they are small enough."""
    keys = cluster_keys(labels, aliases, protected)
    return labels.withColumn("slug", normalise(F.col("situation"), aliases)).join(keys, "slug")


def rollup(rows: DataFrame) -> DataFrame:
    """One row per cluster, one partial aggregation and one shuffle of partial sums."""
    some = lambda c, otherwise: F.col(c) if c in rows.columns else otherwise
    label = some("situation_label", F.replace(F.col("cluster"), F.lit("_"), F.lit(" ")))
    return rows.groupBy("cluster").agg(
        F.count("*").alias("volume"),
        F.count_if("failed").alias("failures"),
        F.count_if(F.size("flags") > 0).alias("compliance_hits"),
        F.count_if(some("is_new", F.lit(False))).alias("flagged_new"),
        F.sum("confidence").alias("confidence_sum"),
        F.sum("cost").alias("cost"),
        F.sum(F.when(F.col("failed"), F.col("cost")).otherwise(0.0)).alias("cost_of_failed"),
        F.min("ord").alias("first"),
        F.min_by(label, "ord").alias("label"),
    )


def rates(clusters: DataFrame) -> DataFrame:
    """clusters with their rates, 0 where empty, and failed_cost: the cost shared out by the rate of failures."""
    over = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("volume")), F.lit(0.0))
    c = clusters.withColumns({"fail_rate": over("failures"), "compliance_rate": over("compliance_hits"), "mean_confidence": over("confidence_sum")})
    return c.withColumn("failed_cost", F.col("cost") * F.col("fail_rate"))


def main_and_tail(clusters: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Clusters of `least` calls or more, and the long tail, the largest first."""
    order = [F.desc("volume"), "first", "cluster"]
    return clusters.filter(F.col("volume") >= least).orderBy(*order), clusters.filter(F.col("volume") < least).orderBy(*order)


def condition_counts(rows: DataFrame) -> DataFrame:
    """(cluster, condition, n); flags count as compliance:<flag>."""
    both = F.concat(F.transform("flags", lambda f: F.concat(F.lit("compliance:"), f)), F.col("conditions"))
    return rows.select("cluster", F.explode(both).alias("condition")).groupBy("cluster", "condition").agg(F.count("*").alias("n"))


def _first(rows: DataFrame, by: str, n: int, *order) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= n)


def top_conditions(counts: DataFrame, n: int = 4) -> DataFrame:
    """(cluster, condition, n, place) of each cluster's most frequent conditions."""
    return _first(counts, "cluster", n, F.desc("n"), "condition")


def failure_modes(rows: DataFrame, n: int = MODES) -> DataFrame:
    """(cluster, mode, place): the first distinct modes of each cluster's failed calls."""
    modes = rows.filter("failed AND mode IS NOT NULL").groupBy("cluster", "mode").agg(F.min("ord").alias("first"))
    return _first(modes, "cluster", n, "first", "mode").select("cluster", "mode", "place")


def version_counts(rows: DataFrame) -> DataFrame:
    """(cluster, version, n, failed, cost)"""
    return rows.groupBy("cluster", "version").agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"), F.sum("cost").alias("cost"))


def exemplars(rows: DataFrame, n: int = 3) -> DataFrame:
    """(cluster, id, place) of each cluster's first calls."""
    return _first(rows.select("cluster", "id", "ord"), "cluster", n, "ord", "id").select("cluster", "id", "place")


def declared(scenarios: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(slug, first, matched, declared): for each declared slug the scenarios of its last one's situation, and their conditions."""
    s = scenarios.withColumn("slug", normalise(F.col("situation"), aliases))
    slugs = s.groupBy("slug").agg(F.min("ord").alias("first"), F.max_by("situation", "ord").alias("situation"))
    of = s.groupBy("situation").agg(F.array_sort(F.collect_list(F.struct("ord", "scenario_id"))).alias("all"), F.array_distinct(F.transform(F.flatten(F.collect_list("conditions")), F.lower)).alias("declared"))
    return slugs.join(of, "situation").select("slug", F.col("first").alias("turn"), F.transform("all", lambda x: x["scenario_id"]).alias("matched"), "declared")


def coverage(rows: DataFrame, scenarios: DataFrame, critical: list[str], least: int = LEAST, aliases: dict[str, str] | None = None) -> DataFrame:
    """(cluster, label, volume, failures, ..., status, matched, reason, missing, critical_flags, suppressed_flags, priority)

    scenarios: (scenario_id, ord, situation, conditions), from declared files. Everything after
    the two aggregations has one row per cluster.
    """
    main = rates(rollup(rows)).filter(F.col("volume") >= least)
    counts = condition_counts(rows).join(main.select("cluster", "volume"), "cluster").withColumn("share", F.col("n") / F.col("volume"))
    is_flag = F.col("condition").startswith("compliance:")
    strong = (F.col("n") >= CRITICAL_COUNT) & (F.col("share") >= CRITICAL_RATE)
    kinds = F.col("condition").isin([f"compliance:{f}" for f in critical])
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("condition"))))
    seen = counts.groupBy("cluster").agg(
        pick(~is_flag & (F.col("share") >= OBSERVED)).alias("observed"), pick(kinds & strong).alias("critical_flags"), pick(kinds & ~strong).alias("suppressed_flags")
    )
    by = declared(scenarios, aliases)
    exact = by.select("slug", *(F.col(c).alias(f"e_{c}") for c in ("matched", "declared")))
    near = main.select("cluster").join(by, jaccard(tokens(F.col("cluster"), aliases), tokens(F.col("slug"), aliases)) >= SIMILAR)
    near = near.groupBy("cluster").agg(F.min_by(F.struct("matched", "declared", "slug"), "turn").alias("near"))
    out = main.join(seen, "cluster", "left").join(exact, F.col("cluster") == F.col("slug"), "left").join(near, "cluster", "left")
    empty = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, empty) for c in ("observed", "critical_flags", "suppressed_flags")})
    out = out.withColumns({"matched": F.coalesce("e_matched", "near.matched"), "declared": F.coalesce("e_declared", "near.declared")})
    reason = F.when(F.col("e_matched").isNotNull(), "same situation").when(F.col("near").isNotNull(), F.concat(F.lit("tokens shared with "), F.col("near.slug")))
    hit = F.col("matched").isNotNull()
    out = out.withColumn("reason", reason).withColumn("missing", F.when(hit, F.array_except("observed", "declared")).otherwise(empty))
    partial = (F.size("missing") > 0) | (F.size("critical_flags") > 0)
    out = out.withColumn("status", F.when(~hit, "uncovered").when(partial, "partial").otherwise("covered"))
    weight = F.when(F.size("critical_flags") > 0, 3.0).when(F.col("compliance_rate") > COMPLIANCE_RATE, 2.0).otherwise(1.0)
    total = main.agg(F.sum("volume").alias("total"))
    priority = F.when(F.col("status") == "covered", 0.0).otherwise(F.col("volume") / F.col("total") * F.col("fail_rate") * weight)
    out = out.crossJoin(total).withColumn("priority", priority).withColumn("matched", F.coalesce("matched", empty))
    return out.select(
        "cluster", "label", "volume", "failures", "compliance_hits", "flagged_new", "fail_rate", "compliance_rate", "mean_confidence", "status", "matched", "reason", "missing",
        "critical_flags", "suppressed_flags", "priority", "cost", "failed_cost", "first",
    )


def ranked_gaps(rows: DataFrame, n: int | None = None) -> DataFrame:
    """Clusters that aren't covered, by falling priority; the first n of them, all where n is None or 0."""
    gaps = rows.filter("status <> 'covered'").orderBy(F.desc("priority"), "first", "cluster")
    return gaps.limit(n) if n else gaps


def summary(rows: DataFrame, tail: DataFrame | None = None) -> DataFrame:
    """One row: shares of the clustered volume in per cent, counts by status, spend that gaps leave, and the tail's size."""
    s = F.col("status")
    volume = lambda c: F.coalesce(F.sum(F.when(c, F.col("volume"))), F.lit(0))
    share = lambda c: F.coalesce(F.try_divide(100 * volume(c), F.sum("volume")), F.lit(0.0)).cast("double")
    gap = (s != "covered") & (F.size("critical_flags") > 0)
    out = rows.agg(
        share(s != "uncovered").alias("declared_pct"), share(s == "covered").alias("coverage_pct"), share(s == "uncovered").alias("undeclared_pct"),
        *(F.count_if(s == x).alias(x) for x in ("covered", "partial", "uncovered")), volume(s == "partial").alias("partial_volume"), volume(s == "uncovered").alias("uncovered_volume"),
        F.coalesce(F.sum(F.when(s != "covered", F.col("failed_cost"))), F.lit(0.0)).alias("unaddressed_spend"), F.count_if(gap).alias("critical_gaps"), F.count("*").alias("n_clusters"),
    )
    if tail is None:
        return out
    return out.crossJoin(tail.agg(F.count("*").alias("tail_clusters"), F.coalesce(F.sum("volume"), F.lit(0)).alias("tail_volume")))


def gate(total: DataFrame, declared: float = 85.0, covered: float = 60.0, grades: DataFrame | None = None) -> DataFrame:
    """(name, passed): one row per check. grades: (critical), of which none may be true"""
    tests = [("declared", F.col("declared_pct") >= declared), ("coverage", F.col("coverage_pct") >= covered), ("critical_gaps", F.col("critical_gaps") == 0)]
    if grades is not None:
        total = total.crossJoin(grades.agg(F.count_if("critical").alias("critical_failed")))
        tests.append(("critical_grades", F.col("critical_failed") == 0))
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in tests))
    return total.select(F.explode(rows).alias("x")).select("x.*")
