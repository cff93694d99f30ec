"""Packs, suites, sources and whole runs."""

import json

import pytest
import yaml
from pyspark.sql import functions as F

from callatlas import cli
from callatlas.config import Settings
from callatlas.errors import AuthError, ConfigError, IngestError, ServerError, SuiteError
from callatlas.functions import sql, stats, text
from callatlas.operators import compliance, coverage, generate, graders, labels
from callatlas.plans import run as runs
from callatlas.sources import call_log, conversations, corpus, known, packs, suites
from callatlas.streaming import rollup


@pytest.mark.parametrize("name", packs.available())
def test_packs_and_suites_fit(name):
    pack, suite = packs.load_pack(name), suites.load_suite(packs.load_pack(name).suite_dir)
    assert suites.mismatch(suite, pack) == (set(), set())
    assert {*pack.aliases.values()} <= {*pack.situations} and {f for fs in pack.flags.values() for f in fs} <= {*compliance.FLAGS}
    assert {s for s in pack.situations if pack.situations[s].get("keywords")} == {*pack.rules}


def test_broken_packs(tmp_path):
    with pytest.raises(ConfigError, match="no pack"):
        packs.load_pack("absent")
    good = yaml.safe_load((packs.PACKS / "lending.yaml").read_text())
    one = good["situations"]["wrong_number"]
    bad = [{**good, "situations": {}}, {k: v for k, v in good.items() if k != "rule_order"}, {**good, "rule_order": ["nowhere"]}, *({**good, "rule_order": [], "situations": {"x": {**one, **c}}} for c in ({"fail": 1.5}, {"keywords": ["Upper"]}))]
    bad += [{**good, "rule_order": [], "situations": {"x": {k: v for k, v in one.items() if k != "weight"}}}, ["list"]]
    for i, raw in enumerate(bad):
        (tmp_path / f"p{i}.yaml").write_text(yaml.safe_dump(raw))
        with pytest.raises(ConfigError):
            packs.load_pack(f"p{i}", tmp_path)
    (tmp_path / "odd.yaml").write_text("a: [")
    with pytest.raises(ConfigError):
        packs.load_pack("odd", tmp_path)


def test_unknown_expectations_and_other_errors_in_suites(tmp_path):
    good = {"id": "A", "name": "n", "situation": "s", "expectations": [{"type": "max_turns", "value": 3}]}
    bad = [{**good, "expectations": [{"type": "max_turnz"}]}, {**good, "expectations": [{"type": "max_turns", "stray": 1}]}, {**good, "stray": 1}, {k: v for k, v in good.items() if k != "situation"}, {**good, "conditions": "x"}, {**good, "expectations": [{"type": "max_turns", "value": "3"}]}, ["x"]]
    for i, raw in enumerate(bad):
        at = tmp_path / str(i)
        at.mkdir()
        (at / "a.yaml").write_text(yaml.safe_dump(raw))
        with pytest.raises(SuiteError, match="a.yaml"):
            suites.load_suite(at)
    two = tmp_path / "two"
    two.mkdir()
    with pytest.raises(SuiteError):
        suites.load_suite(two)
    for f in ("b.yml", "a.yaml"):
        (two / f).write_text(yaml.safe_dump(good))
    with pytest.raises(SuiteError, match="b.yml.*a.yaml"):
        suites.load_suite(two)
    with pytest.raises(SuiteError):
        suites.load_suite(tmp_path / "nowhere")


def test_known_slugs(tmp_path):
    assert known.load_known(tmp_path, "p") == set()
    known.save_known(tmp_path, "p", {"a"})
    known.save_known(tmp_path, "p", {"b"})
    assert known.load_known(tmp_path, "p") == {"a", "b"}
    (tmp_path / "known_p.json").write_text("{broken")
    assert known.load_known(tmp_path, "p") == set()


LABELS = "id string, ord long, situation string, failed boolean, conditions array<string>, flags array<string>, version string, confidence double, cost double, mode string"


def labelled(spark, *groups):
    """groups: (situation, n, conditions, flags, failed)"""
    rows = [(f"{g}-{i}", g * 1000 + i, s, i < failed, c, f if i < nf else [], "v2", 0.9, 2.0, f"mode {i % 9}") for g, (s, n, c, f, nf, failed) in enumerate(groups) for i in range(n)]
    return spark.createDataFrame(rows, LABELS)


def scenarios(spark, *declared):
    return spark.createDataFrame([(f"S{i}", i, "n", s, c) for i, (s, c) in enumerate(declared)], suites.SCENARIO)


def covered(spark, rows, *declared, **more):
    keyed = coverage.clustered(rows, more.pop("aliases", None), more.pop("protected", None))
    return {r.cluster: r for r in coverage.coverage(keyed, scenarios(spark, *declared), [*compliance.FLAGS], **more).collect()}


def test_two_declared_situations_never_merge(spark):
    rows = labelled(spark, ("payment date change", 5, [], [], 0, 5), ("payment date check", 5, [], [], 0, 0))
    declared = [("payment_date_change", []), ("payment_date_check", [])]
    assert len(covered(spark, rows, *declared)) == 1
    kept = covered(spark, rows, *declared, protected=["payment_date_change", "payment_date_check"])
    assert {k: r.failures for k, r in kept.items()} == {"payment_date_change": 5, "payment_date_check": 0}


@pytest.mark.parametrize("most", [5000, 1])
def test_folding_and_aliases(spark, most):
    rows = labelled(spark, ("disputes_amount", 3, [], [], 0, 0), ("Amount dispute!", 3, [], [], 0, 0), ("disputed outstanding amount", 3, [], [], 0, 0), ("xyz", 1, [], [], 0, 0), (None, 1, [], [], 0, 0))
    keys = {r.slug: r.cluster for r in coverage.cluster_keys(rows, {"xyz": "disputes_amount"}, None, most).collect()}
    assert keys == {"disputes_amount": "disputes_amount", "amount_dispute": "disputes_amount", "disputed_outstanding_amount": "disputed_outstanding_amount", "": ""}


def test_statuses(spark):
    flags = ["pii_exposure"]
    rows = labelled(spark, ("click", 90, [], [], 0, 9), ("other thing", 10, [], [], 0, 5), ("angry", 20, ["angry_caller"], [], 0, 0), ("few flags", 84, [], flags, 3, 0), ("flagged", 4, [], flags, 4, 4), ("rare", 2, [], [], 0, 0))
    got = covered(spark, rows, ("click", []), ("angry", []), ("few_flags", []), ("flagged", []), ("click", ["late"]))
    assert {k: r.status for k, r in got.items()} == {"click": "covered", "other_thing": "uncovered", "angry": "partial", "few_flags": "covered", "flagged": "partial"}
    assert got["click"].matched == ["S0", "S4"] and got["angry"].missing == ["angry_caller"] and got["other_thing"].missing == []
    assert got["few_flags"].suppressed_flags == ["compliance:pii_exposure"] and got["flagged"].critical_flags == ["compliance:pii_exposure"]
    assert got["flagged"].priority == pytest.approx(4 / 208 * 3) and got["click"].priority == 0
    keyed = coverage.clustered(rows)
    main, tail = coverage.main_and_tail(coverage.rates(coverage.rollup(keyed)))
    assert [r.cluster for r in tail.collect()] == ["rare"] and main.first().cluster == "click"
    table = coverage.coverage(keyed, scenarios(spark, ("click", [])), [*compliance.FLAGS])
    s = coverage.summary(table, tail).first()
    assert (s.declared_pct, s.tail_clusters, s.tail_volume, s.uncovered) == (pytest.approx(9000 / 208), 1, 2, 4)
    assert s.declared_pct + s.undeclared_pct == pytest.approx(100)
    assert len(coverage.ranked_gaps(table, 2).collect()) == 2
    modes = [r.mode for r in coverage.failure_modes(keyed).filter("cluster = 'click'").orderBy("place").collect()]
    assert modes == [f"mode {i}" for i in range(6)]


def test_scenarios_from_gaps(tmp_path):
    row = {"cluster": "deceased_borrower", "volume": 9, "fail_rate": 0.5, "critical_flags": ["deceased_borrower_pursued", "pii_exposure"], "conditions": ["compliance:pii_exposure", "poor_audio", "hardship"], "modes": ["went on"]}
    s = generate.generate(row)
    assert [e.type for e in s.expectations] == ["must_escalate", "no_amount_disclosed", "no_pii_disclosed", "no_repeated_agent_turn", "max_turns", "outcome_in"]
    assert (s.id, s.priority, s.conditions) == (generate.scenario_id("deceased_borrower"), "P0", ["poor_audio", "hardship"])
    assert suites.load_suite(suites.write_scenario(s, tmp_path).parent) == [s]
    wish = {"name": "Better", "priority": "P9", "request_expectations": ["max_turns", "tool_called", "outcome_in", "must_respond_in_caller_language"], "tags": ["a"], "persona_temperament": "calm"}
    m = generate.generate({**row, "conditions": []}, lambda r: wish)
    assert [e.type for e in m.expectations][-2:] == ["max_turns", "must_respond_in_caller_language"] and m.name == "Better" and m.priority == "P0"
    assert generate.generate(row, lambda r: 1 / 0) == s


def test_redacted_mappings(spark):
    got = text.redact_mapping({"Token": "abc", "n": 1, "deep": [{"mine": "x", "t": "call 9876543210"}, ["a@b.org"]]}, drop=("MINE",))
    assert got == {"Token": "[REDACTED_SECRET]", "n": 1, "deep": [{"mine": "[REDACTED_SECRET]", "t": "call [PHONE]"}, ["[EMAIL]"]]}
    df = spark.createDataFrame([('{"auth": 1, "x": ["9876543210"]}',), ("not json 9876543210",), (None,)], "t string")
    assert [r[0] for r in df.select(text.redacted_json(F.col("t"))).collect()] == ['{"auth": "[REDACTED_SECRET]", "x": ["[PHONE]"]}', "not json [PHONE]", None]
    rows = spark.createDataFrame([("card 4111 1111 1111 1111 or 4111 1111 1111 1112, a.b@x.org xy@ybl",)], "t string").withColumn("s", text.pii_spans(F.col("t")))
    t, shown = rows.select("t", text.redacted(F.col("t"), F.col("s"))).first()
    assert text.redact_text(t) == shown


def test_fisher_at_any_size(spark):
    rows = [(10, 21, 1, 25), (5, 18, 2, 18), (4, 8, 0, 8), (5, 40, 5, 40), (50_200_000, 10**8, 50_000_000, 10**8), (0, 10**8, 10**8, 10**8)]
    p = stats.fisher_at_least(*(F.col(c) for c in "abcd"))
    got = [r[0] for r in spark.createDataFrame(rows, "a long, b long, c long, d long").select(p).collect()]
    assert got[:4] == pytest.approx([0.0006874121155607752, 0.20087976539589444, 0.03846153846153846, 0.6314839364861712], rel=1e-9)
    assert got[4] < 1e-150 and got[5] == pytest.approx(1)


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("SELECT slug_normal(' Ab-C! '), slug_similarity('disputes amount', 'the amount_dispute'), slug_similarity('the', 'a'), wilson_low(0, 20), round(wilson_high(0, 20), 9), wilson_high(0, 0)").first()
    assert tuple(r) == ("ab_c", 1.0, 0.0, 0.0, round(0.16113012549493322, 9), 1.0)


def test_call_log(spark):
    turn = {"speaker": "bot", "content": " hi ", "tools": [{"tool": "t", "success": False}], "start_ms": 5}
    rows = [{"call_id": i, "messages": [turn, {"role": "who", "text": "x"}, {"role": "user", "text": "yes", "interrupted": True}], "status": "User_Hangup", "duration_seconds": 12, "version": "" if i % 2 else "v9"} for i in range(130)]
    rows += [{"id": "e", "turns": []}, {"id": "s", "transcript": "text"}, {"turns": [turn]}]

    def fetch(page, size):
        return 200, json.dumps({"data": rows[(page - 1) * 100 :][:size]})

    read = call_log.read_call_log(spark, fetch, "a1", 500)
    good = conversations.accepted(read)
    assert good.count() == 130 and {(r.reason, r.n) for r in conversations.reasons(read).collect()} == {("empty transcript", 1), ("unrecognised call-log shape", 2)}
    r = good.filter("id = '1'").first()
    assert (r.agent_id, r.agent_version, r.outcome, r.disposition, r.duration_s, r.usage.audio_seconds) == ("a1", "unversioned", "caller_abandoned", "user_hangup", 12.0, 12.0)
    assert [(t.role, t.text, t.offset_ms, t.barge_in) for t in r.turns] == [("agent", "hi", 5, False), ("caller", "yes", None, True)] and r.turns[0].tool_calls[0].ok is False
    assert call_log.read_call_log(spark, fetch, "a1", 110).count() == 110
    for status, error in ((401, AuthError), (404, IngestError), (503, ServerError)):
        with pytest.raises(error):
            call_log.rows_of(status, "")


def test_strict_ingest(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("{bad\n")
    with pytest.raises(Exception, match="rejected: invalid JSON"):
        conversations.read_jsonl(spark, str(tmp_path / "x.jsonl"), strict=True).collect()


@pytest.fixture(scope="module")
def calls(tmp_path_factory):
    at = tmp_path_factory.mktemp("calls") / "calls.jsonl"
    at.write_text("\n".join(corpus.lines(packs.load_pack("lending"), 300, 3)))
    return str(at)


@pytest.mark.parametrize("name", packs.available())
def test_a_run_end_to_end(spark, tmp_path, name):
    pack = packs.load_pack(name)
    made = corpus.corpus(spark, pack, 250, 2)
    run = runs.run_report(spark, made, pack=name, settings=Settings(state_dir=str(tmp_path)))
    got = runs.report_payload(run)
    s = got["summary"]
    assert s["total_conversations"] == 250 == sum(r["volume"] for r in got["rows"]) + s["tail_volume"]
    assert 0 < s["declared_pct"] < 100 and got["meta"]["graded"] > 0 and got["meta"]["versions"] == ["v2", "v3"]
    assert {r["cluster"] for r in got["rows"]} <= {*pack.situations, "unclassified"}
    assert [r["priority"] for r in got["rows"]] == sorted((r["priority"] for r in got["rows"]), reverse=True)
    assert known.load_known(tmp_path, name) == {r["cluster"] for r in got["rows"]}
    again = runs.report_payload(runs.run_report(spark, made.repartition(7), pack=name, converge=True, settings=Settings(state_dir=str(tmp_path))))
    assert [r["cluster"] for r in again["rows"]] == [r["cluster"] for r in got["rows"]] and not any(r["flagged_new"] for r in again["rows"])
    costs = runs.costs_payload(run)
    assert sum(costs["component"]["share"].values()) == pytest.approx(1, abs=1e-3) and costs["managed_premium"] > 0
    key = got["rows"][0]["cluster"]
    assert len(runs.cluster_payload(run, key, 2)["examples"]) == 2 and runs.cluster_payload(run, "nowhere") is None
    assert runs.health(run)["conversations"] == 250 and not runs.health(None)["report_loaded"]
    with pytest.raises(ValueError):
        runs.diff_payload(run, "v2", "v7")
    run.close()


def test_labels_of_made_calls(spark):
    pack = packs.load_pack("lending")
    made = corpus.corpus(spark, pack, 300, 3)
    told = labels.keyword_labels(made, pack.rules, pack.condition_rules, pack.flags, ["already_paid"])
    rows = told.join(made.selectExpr("id", "try_variant_get(metadata, '$._truth_situation', 'string') AS truth"), "id").collect()
    assert sum(r.situation == r.truth for r in rows) > 290
    assert {f for r in rows for f in r.flags} >= {"deceased_borrower_pursued", "call_frequency_complaint_unhandled"}
    assert all(r.is_new == (r.situation != "already_paid") for r in rows)


def test_command_line(spark, tmp_path, calls, capsys, monkeypatch):
    monkeypatch.setenv("CALLATLAS_STATE_DIR", str(tmp_path))
    call = lambda *a: cli.main([*a, "--transcripts", calls], spark)
    out = tmp_path / "r.json"
    assert call("report", "--json", str(out), "--cost-mode", "platform") == 0 and json.loads(out.read_text())["summary"]["total_conversations"] == 300
    assert call("gate", "--min-coverage", "0", "--min-declared", "0") == 1
    assert call("diff") == 0 and "disputes_amount" in capsys.readouterr().out
    first = json.loads(open(calls).readline())["id"]
    assert call("inspect", first) == 0 and "CALLER:" in capsys.readouterr().out
    assert call("close-gap", "--cluster", "nowhere") == 2
    suite = tmp_path / "suite"
    assert call("close-gap", "-n", "2") == 0
    assert "GEN-" in capsys.readouterr().out and not suite.exists()
    assert call("report", "--domain", "nowhere") == 2


def test_gate_looks_at_grades(spark):
    total = spark.createDataFrame([(90.0, 70.0, 0)], "declared_pct double, coverage_pct double, critical_gaps long")
    grades = spark.createDataFrame([(True,), (False,)], "critical boolean")
    assert {r.name: r.passed for r in coverage.gate(total, grades=grades).collect()} == {"declared": True, "coverage": True, "critical_gaps": True, "critical_grades": False}


def test_last_scenario_grades(spark):
    assert graders.last_scenario(scenarios(spark, ("s", []), ("s", []))).first().scenario_id == "S1"


def test_streaming_rollup(spark, tmp_path):
    rows = [("2026-01-01 10:00:00", "Click", True, "v2", 1.0), ("2026-01-01 11:00:00", "clicks", False, "v2", 2.0), ("2026-01-05 11:00:00", "new one", False, "v3", 2.0)]
    spark.createDataFrame(rows, "ts string, situation string, failed boolean, version string, cost double").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "situation", "failed", "version", "cost").write.parquet(str(tmp_path / "in"))
    keys = spark.createDataFrame([("click", "click"), ("clicks", "click")], "slug string, cluster string")
    stream = spark.readStream.schema("ts timestamp, situation string, failed boolean, version string, cost double").parquet(str(tmp_path / "in"))
    rollup.write(rollup.rolled_up(stream, keys), str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.cluster, r.n, r.failed, r.cost) for r in got] == [("click", 2, 1, 3.0)]
