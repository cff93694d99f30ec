"""One run from transcripts to a coverage report. The command line, payloads and tests all take it from here."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings, load_settings
from ..functions import costs
from ..functions.text import normalise, pii_spans, redacted
from ..operators import compliance, coverage, graders, labels, versions
from ..operators.generate import generate
from ..remote.client import Transport, http_post
from ..remote.labels import label_remotely, run_stats
from ..sources.conversations import accepted, enforce_quality, ingest_summary, read_jsonl, said, turn_count
from ..sources.known import load_known, save_known
from ..sources.packs import DEFAULT, Pack, load_pack
from ..sources.suites import Scenario, expectation_table, load_suite, scenario_table

PARTS = ["stt", "llm_in", "llm_cached", "llm_out", "tts", "telephony"]
USAGE = ["audio_seconds", "tts_characters", "llm_input_tokens", "llm_cached_input_tokens", "llm_output_tokens", "telephony_seconds", "turns"]


@dataclass
class Run:
    """What a run has made. Tables that several payloads read are kept by Spark, in memory or on disk; none holds texts."""

    pack: Pack
    suite: list[Scenario]
    conversations: DataFrame
    ingest: str
    labels: DataFrame
    rows: DataFrame
    coverage: DataFrame
    tail: DataFrame
    graded: DataFrame
    usage: DataFrame

    def close(self) -> None:
        for kept in (self.labels, self.rows, self.coverage, self.graded):
            kept.unpersist()


def usage_of(conversations: DataFrame) -> DataFrame:
    """(id, the fields of usage, estimated): as the source reports it, else estimated from the transcript."""
    t, u = F.col("turns"), F.col("usage")
    e = costs.estimated(F.length(said(t, "agent")), F.length(said(t, "caller")), turn_count(t))
    made = {"audio_seconds": F.col("duration_s"), "telephony_seconds": F.col("duration_s"), "tts_characters": e["tts_characters"], "llm_input_tokens": e["in_tokens"], "llm_cached_input_tokens": e["cached_tokens"], "llm_output_tokens": e["out_tokens"], "turns": e["turns"]}
    pick = lambda c: F.when(u.isNull(), made[c]).otherwise(F.coalesce(u[c], F.lit(0))).alias(c)
    return conversations.select("id", *map(pick, USAGE), u.isNull().alias("estimated"))


def component_costs(c=F.col) -> dict[str, Column]:
    return costs.components(c("audio_seconds"), c("telephony_seconds"), c("tts_characters"), c("llm_input_tokens"), c("llm_cached_input_tokens"), c("llm_output_tokens"))


def with_cost(usage: DataFrame, mode: str = "component") -> DataFrame:
    total = costs.platform(F.col("audio_seconds"), F.col("telephony_seconds")) if mode == "platform" else sum(component_costs().values(), F.lit(0.0))
    return usage.withColumn("cost", total)


def run_report(
    spark: SparkSession, transcripts: str | DataFrame, suite_dir: str | Path | None = None, pack: str | Pack = DEFAULT, cost_mode: str = "component", least: int = coverage.LEAST,
    remote: bool = False, converge: bool = False, settings: Settings | None = None, transport: Transport = http_post, sleep=None,
) -> Run:
    """transcripts: a path of JSON lines, or conversations as accepted() gives them. A path over the reject rate is an error."""
    settings = settings or load_settings()
    pack = load_pack(pack) if isinstance(pack, str) else pack
    suite = load_suite(suite_dir or pack.suite_dir)
    if isinstance(transcripts, str):
        read = read_jsonl(spark, transcripts)
        enforce_quality(read)
        calls, ingest = accepted(read), ingest_summary(read)
    else:
        calls, ingest = transcripts, "conversations were given as a table"
    known = {s.situation for s in suite} | (load_known(settings.state_dir, pack.name) if converge else set())
    made = labels.keyword_labels(calls, pack.rules, pack.condition_rules, pack.flags, sorted(known))
    if remote:
        made = label_remotely(calls, sorted(known), settings, f"{settings.state_dir}/labels", made, transport, sleep)
    else:
        made = made.withColumns({"error": F.lit(None).cast("string"), "cost": F.lit(0.0), "from_cache": F.lit(False), "stopped": F.lit(False)})
    made = made.persist()
    ok = made.filter("situation IS NOT NULL").drop("cost", "error", "from_cache", "stopped")
    usage = usage_of(calls)
    facts = calls.select("id", F.col("agent_version").alias("version")).join(with_cost(usage, cost_mode).select("id", "cost"), "id")
    # ingest has no order of its own on a cluster; ids give one that is the same from run to run
    rows = ok.join(facts, "id").withColumn("ord", F.col("id"))
    protected = [r[0] for r in scenario_table(spark, suite).select(normalise(F.col("situation"), pack.aliases)).distinct().collect()]
    rows = coverage.clustered(rows, pack.aliases, protected).persist()
    scenarios = scenario_table(spark, suite)
    covered = coverage.coverage(rows, scenarios, [*compliance.FLAGS], least, pack.aliases).persist()
    _, tail = coverage.main_and_tail(coverage.rates(coverage.rollup(rows)), least)
    to_grade = calls.join(ok.select("id", "situation"), "id").join(graders.last_scenario(scenarios), "situation")
    graded = graders.graded(to_grade, expectation_table(spark, suite)).persist()
    save_known(settings.state_dir, pack.name, {r[0] for r in covered.select("cluster").collect()})
    return Run(pack, suite, calls, ingest, made, rows, covered, tail, graded, usage)


# --- payloads: plain values, rounded only here --------------------------------------------------------


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _listed(df: DataFrame, key: str, value: str) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in sorted(_rows(df), key=lambda r: r["place"]):
        out.setdefault(r[key], []).append(r[value])
    return out


def clusters_of(run: Run) -> list[dict]:
    """The report's rows, the highest priority first. As many as clusters."""
    counts = coverage.condition_counts(run.rows)
    conditions, modes = _listed(coverage.top_conditions(counts, 6), "cluster", "condition"), _listed(coverage.failure_modes(run.rows), "cluster", "mode")
    examples, by_version = _listed(coverage.exemplars(run.rows), "cluster", "id"), {}
    for r in _rows(coverage.version_counts(run.rows)):
        by_version.setdefault(r["cluster"], {})[r["version"]] = {"n": r["n"], "failed": r["failed"], "cost": round(r["cost"], 2), "fail_rate": round(r["failed"] / r["n"], 3)}
    slugs: dict[str, list] = {}
    for r in _rows(run.rows.select("cluster", "slug").distinct()):
        slugs.setdefault(r["cluster"], []).append(r["slug"])
    out = []
    for r in _rows(run.coverage.orderBy(F.desc("priority"), "first", "cluster")):
        key = r["cluster"]
        bare = [f.removeprefix("compliance:") for f in r.pop("critical_flags")]
        rounded = {"priority": 4, "fail_rate": 3, "compliance_rate": 3, "mean_confidence": 2, "cost": 2, "failed_cost": 2}
        out.append(r | {k: round(r[k], n) for k, n in rounded.items()} | {
            "critical_flags": bare, "is_critical": bool(bare), "suppressed_flags": [f.removeprefix("compliance:") for f in r["suppressed_flags"]], "conditions": conditions.get(key, []),
            "modes": modes.get(key, []), "exemplars": examples.get(key, []), "by_version": dict(sorted(by_version.get(key, {}).items())), "member_slugs": sorted(slugs.get(key, [])),
        })
    return out


def report_payload(run: Run) -> dict:
    s = _rows(coverage.summary(run.coverage, run.tail))[0]
    stats = _rows(run_stats(run.labels))[0]
    n, passed, critical = run.graded.agg(F.count("*"), F.count_if("passed"), F.count_if("critical")).first()
    notes = []
    if s["tail_clusters"]:
        notes.append(f"{s['tail_clusters']} clusters of few calls ({s['tail_volume']} in all) aren't ranked, but listed as the tail")
    degraded = stats["stopped_early"] or len(stats["labelers"]) > 1
    if degraded:
        notes.append("some labels aren't from the remote labeller, so clusters are provisional")
    summary = {k: round(v, 1) if k.endswith("_pct") else round(v, 2) if isinstance(v, float) else v for k, v in s.items()}
    return {
        "summary": summary | {"total_conversations": run.conversations.count(), "suite_size": len(run.suite), "labeler": "+".join(stats["labelers"]) or "none", "degraded": degraded, "notes": notes},
        "rows": clusters_of(run), "tail": _rows(run.tail.select("cluster", "volume", "failures")),
        "meta": {"ingest": run.ingest, "labels": stats, "suite_pass_rate": round(passed / n, 4) if n else 0.0, "graded": n, "graded_failed": n - passed, "graded_critical": critical, "versions": [r[0] for r in run.conversations.select("agent_version").distinct().orderBy("agent_version").collect()], "pack": run.pack.name},
    }


def inspected(run: Run, call_id: str) -> dict | None:
    """All that is known of one call, None if there is no such call."""
    one = run.conversations.filter(F.col("id") == call_id)
    found = _rows(one.drop("metadata"))
    if not found:
        return None
    get = lambda df: next(iter(_rows(df.filter(F.col("id") == call_id))), None)
    cluster = next(iter(_rows(run.rows.filter(F.col("id") == call_id).select("cluster").join(run.coverage, "cluster"))), None)
    shown = F.transform(F.filter("turns", lambda t: t["role"] != "system"), lambda t: F.concat(F.upper(t["role"]), F.lit(": "), redacted(t["text"], pii_spans(t["text"]))))
    return {"conversation": found[0], "transcript": one.select(shown).first()[0], "label": get(run.labels), "grade": get(run.graded), "cluster": cluster, "cost": round(get(with_cost(run.usage))["cost"], 3)}


def cluster_payload(run: Run, key: str, limit: int = 4) -> dict | None:
    """A cluster with examples, calls that failed their scenario first."""
    row = next((r for r in clusters_of(run) if r["cluster"] == key), None)
    if row is None:
        return None
    calls = run.rows.filter(F.col("cluster") == key).join(run.graded.select("id", "passed"), "id", "left")
    ids = calls.orderBy(F.coalesce("passed", F.lit(True)), "ord").limit(limit).select("id").collect()
    return row | {"examples": [inspected(run, r.id) for r in ids]}


def diff_payload(run: Run, baseline: str, candidate: str) -> dict:
    have = {r[0] for r in run.conversations.select("agent_version").distinct().collect()}
    if unknown := [v for v in (baseline, candidate) if v not in have]:
        raise ValueError(f"no version {unknown[0]}; there are {sorted(have)}")
    diffs = versions.compare(run.rows.join(run.coverage.select("cluster"), "cluster", "left_semi"), baseline, candidate)
    return {"baseline": baseline, "candidate": candidate, "overall": _rows(versions.overall(diffs))[0], "diffs": _rows(versions.ordered(diffs))}


def costs_payload(run: Run) -> dict:
    """What calls cost by component and on a managed platform, and what failures cost."""
    u = run.usage.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in USAGE))
    r = _rows(u.withColumns(component_costs()).withColumn("platform", costs.platform(F.col("audio_seconds"), F.col("telephony_seconds"))))[0]
    if not r["n"]:
        raise ValueError("no conversations")
    total, n = sum(r[p] for p in PARTS), r["n"]
    failed = run.coverage.agg(F.coalesce(F.sum("failed_cost"), F.lit(0.0))).first()[0]
    return {
        "n_conversations": n, "component": {"total": round(total, 2), "per_call": round(total / n, 3), "breakdown": {p: round(r[p], 2) for p in PARTS}, "share": {p: round(r[p] / total, 4) for p in PARTS} if total else {}},
        "platform": {"total": round(r["platform"], 2), "per_call": round(r["platform"] / n, 3)}, "managed_premium": round(r["platform"] / total, 2) if total else None,
        "human_per_call": costs.HUMAN_CALL, "savings_pct": round((1 - total / n / costs.HUMAN_CALL) * 100, 2), "failed_cost": round(failed, 2), "note": "usage is estimated where the source reports none",
    }


def gap_proposals(run: Run, n: int = 1, cluster: str | None = None, ask=None) -> list[Scenario]:
    """Scenarios for the first n uncovered clusters, or for one."""
    gaps = [r for r in clusters_of(run) if r["status"] == "uncovered" and cluster in (None, r["cluster"])]
    return [generate(r, ask) for r in gaps[:n]]


def health(run: Run | None) -> dict:
    stats = _rows(run_stats(run.labels))[0] if run else {}
    return {"report_loaded": run is not None, "conversations": run.conversations.count() if run else 0, "labelers": stats.get("labelers"), "stopped_early": stats.get("stopped_early")}
