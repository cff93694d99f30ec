"""Command line: report, inspect, agreement, close-gap, diff, gate."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .config import load_settings
from .errors import AtlasError
from .operators import agreement, coverage, labels
from .plans import run as runs
from .remote.labels import label_remotely
from .sources.packs import DEFAULT, load_pack
from .sources.suites import load_suite, write_scenario


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("callatlas", description="Which situations of production calls a suite of scenarios covers.")
    p.add_argument("-v", "--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, does, about: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        c.add_argument("--domain", default=DEFAULT, help="the pack, which also names the suite")
        c.add_argument("--transcripts", required=True, help="JSON lines")
        c.add_argument("--suite", type=Path)
        c.add_argument("--llm", action="store_true", help="label by the remote service")
        c.add_argument("--offline", action="store_true", help="no network: answers come from the cache only")
        c.add_argument("--converge", action="store_true", help="let the labeller reuse slugs of earlier runs")
        c.add_argument("--progress", action="store_true", help="show Spark's progress")
        c.set_defaults(does=does)
        return c

    c = command("report", report, "the coverage report")
    c.add_argument("--top", type=int, default=12)
    c.add_argument("--json", type=Path)
    c.add_argument("--cost-mode", choices=["component", "platform"], default="component")
    c.add_argument("--min-cluster-size", type=int, default=coverage.LEAST)
    command("inspect", inspect, "all that is known of one call").add_argument("call_id")
    command("agreement", agree, "how far labels depend on the labeller").add_argument("--json", type=Path)
    c = command("close-gap", close_gap, "propose scenarios for what nothing tests")
    c.add_argument("-n", type=int, default=1)
    c.add_argument("--cluster")
    c.add_argument("--write", action="store_true", help="into the suite; otherwise they are only shown")
    c = command("diff", diff, "two versions, cluster by cluster")
    c.add_argument("--baseline", default="v2")
    c.add_argument("--candidate", default="v3")
    c.add_argument("--min-cluster-size", type=int, default=coverage.LEAST)
    c.add_argument("--fail-on-regression", action="store_true")
    c = command("gate", gate, "exit code 1 where coverage or compliance isn't good enough")
    c.add_argument("--min-coverage", type=float, default=60.0)
    c.add_argument("--min-declared", type=float, default=85.0)
    return p


def _run(spark, args, **more) -> runs.Run:
    return runs.run_report(spark, args.transcripts, args.suite, args.domain, remote=args.llm, converge=args.converge, settings=load_settings(offline=args.offline or None), **more)


def report(spark, args) -> int:
    got = runs.report_payload(_run(spark, args, cost_mode=args.cost_mode, least=args.min_cluster_size))
    if args.json:
        args.json.write_text(json.dumps(got, indent=1, ensure_ascii=False, default=str), encoding="utf-8")
    s = got["summary"]
    print(f"{s['total_conversations']} conversations, {s['suite_size']} scenarios, labels by {s['labeler']}{' (DEGRADED)' if s['degraded'] else ''}")
    print(f"declared {s['declared_pct']} %, fully covered {s['coverage_pct']} %; spend on failing calls in gaps: {s['unaddressed_spend']:,.2f}")
    for i, r in enumerate([r for r in got["rows"] if r["status"] != "covered"][: args.top or None], 1):
        print(f"{i:3} {r['cluster']:32} {r['status']:9} {r['volume']:6} calls {r['fail_rate']:6.0%} {r['priority']:.4f} {', '.join(r['critical_flags'])}")
    for r in sorted((r for r in got["rows"] if r["status"] == "covered"), key=lambda r: -r["volume"])[:10]:
        print(f"    {r['cluster']:32} covered by {', '.join(r['matched'])} {r['volume']:6} calls {r['fail_rate']:6.0%}")
    print(f"graded {got['meta']['graded']}, {got['meta']['graded_failed']} failed, {got['meta']['graded_critical']} of them critically")
    print(*(f"note: {n}" for n in s["notes"]), sep="\n")
    return 0


def inspect(spark, args) -> int:
    got = runs.inspected(_run(spark, args), args.call_id)
    if got is None:
        print(f"no call {args.call_id}", file=sys.stderr)
        return 2
    print(*got.pop("transcript"), sep="\n")
    got["conversation"].pop("turns")
    print(json.dumps(got, indent=1, ensure_ascii=False, default=str))
    return 0


def agree(spark, args) -> int:
    settings, pack = load_settings(offline=args.offline or None), load_pack(args.domain)
    calls = runs.accepted(runs.read_jsonl(spark, args.transcripts))
    known = sorted(s.situation for s in load_suite(args.suite or pack.suite_dir))
    by_rules = labels.keyword_labels(calls, pack.rules, pack.condition_rules, pack.flags, known)
    by_model = label_remotely(calls, known, settings, f"{settings.state_dir}/labels").filter("situation IS NOT NULL")
    rows = agreement.both(by_rules, by_model, pack.aliases).persist()
    got = agreement.report(rows).first().asDict() | {f"only_{s}": sorted(r[0] for r in agreement.only_in(rows, s).collect()) for s in "ab"}
    if args.json:
        args.json.write_text(json.dumps(got, indent=1), encoding="utf-8")
    print(json.dumps(got, indent=1))
    return 0


def close_gap(spark, args) -> int:
    found = runs.gap_proposals(_run(spark, args), args.n, args.cluster)
    if args.cluster and not found:
        print(f"no uncovered cluster {args.cluster}", file=sys.stderr)
        return 2
    for s in found:
        print(f"{s.id} {s.name} [{s.priority}]", *(f"  - {e.type} {e.tool or e.values or e.value or e.pattern or e.patterns or ''}" for e in s.expectations), sep="\n")
        if args.write:
            print(f"  written: {write_scenario(s, args.suite or load_pack(args.domain).suite_dir)}")
    return 0


def diff(spark, args) -> int:
    got = runs.diff_payload(_run(spark, args, least=args.min_cluster_size), args.baseline, args.candidate)
    o = got["overall"]
    print(f"all: {o['rate_base']:.1%} -> {o['rate_cand']:.1%}")
    for d in got["diffs"]:
        p = "" if d["p"] is None else f"p = {d['p']:.4f}"
        print(f"{d['cluster']:32} {d['verdict']:18} {d['f_base']}/{d['n_base']} -> {d['f_cand']}/{d['n_cand']} {p}")
    return int(o["should_block"] and args.fail_on_regression)


def gate(spark, args) -> int:
    run = _run(spark, args)
    rows = coverage.gate(coverage.summary(run.coverage), args.min_declared, args.min_coverage, run.graded).collect()
    for r in rows:
        print(f"{r.name}: {'passed' if r.passed else 'FAILED'}")
    return int(not all(r.passed for r in rows))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO if args.verbose else logging.WARNING)
    spark = spark or SparkSession.builder.appName("callatlas").config("spark.ui.showConsoleProgress", str(args.progress).lower()).getOrCreate()
    try:
        return args.does(spark, args)
    except (AtlasError, ValueError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
