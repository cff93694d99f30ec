"""The remote labeller against a scripted service, with a clock and a sleep of our own."""

import json
import random

import pytest

from callatlas.config import Settings, load_settings
from callatlas.errors import AtlasError, AuthError, BadRequestError, BudgetExceededError, CallTimeoutError, CircuitOpenError, ConfigError, RateLimitError, ServerError, StructuredOutputError, TruncatedError
from callatlas.remote.client import Breaker, Budget, Client, found_json, request_key
from callatlas.remote.labels import label_remotely, run_stats, valid_label

SETTINGS = Settings(api_key="k", backoff_base_s=0.01, backoff_most_s=0.05, run_budget=10.0)
MESSAGE = [{"role": "user", "content": "hello"}]


def ok(text, fresh=100, out=20, why="stop"):
    return 200, {}, json.dumps({"choices": [{"message": {"content": text}, "finish_reason": why}], "usage": {"prompt_tokens": fresh, "completion_tokens": out}})


class Script:
    def __init__(self, *steps):
        self.steps, self.calls, self.slept = [*steps], [], []

    def __call__(self, url, body, headers, timeout):
        self.calls.append(body)
        step = self.steps.pop(0)
        if isinstance(step, Exception):
            raise step
        return step


def client(*steps, **more):
    s = Script(*steps)
    return Client(SETTINGS, s, sleep=s.slept.append, rng=random.Random(1), **more), s


def test_retries_until_it_works():
    c, s = client((500, {}, "x"), TimeoutError(), OSError(), ok("fine"))
    assert (c.chat(MESSAGE).text, len(s.calls), len(s.slept)) == ("fine", 4, 3)


@pytest.mark.parametrize("status, error, calls", [(401, AuthError, 1), (403, AuthError, 1), (400, BadRequestError, 1), (500, ServerError, 4), (429, RateLimitError, 4)])
def test_what_is_tried_again(status, error, calls):
    c, s = client(*[(status, {}, "card 4111 1111 1111 1111")] * 4)
    with pytest.raises(error) as e:
        c.chat(MESSAGE)
    assert len(s.calls) == calls and "4111" not in str(e.value)


def test_timeout_is_an_error_of_its_own():
    c, _ = client(*[TimeoutError()] * 4)
    with pytest.raises(CallTimeoutError):
        c.chat(MESSAGE)


def test_waits():
    c, s = client((429, {"Retry-After": "2.5"}, ""), ok("x"))
    c.chat(MESSAGE)
    assert s.slept[0] >= 2.5
    waits = {c.wait(3, None) for _ in range(50)}
    assert len(waits) > 40 and all(0 <= w <= 0.04 for w in waits)


def test_unknown_shapes_are_final():
    for body in ("{}", "[]", "no json", json.dumps({"choices": [1]})):
        c, s = client((200, {}, body))
        with pytest.raises(BadRequestError):
            c.chat(MESSAGE)
        assert len(s.calls) == 1


def test_breaker():
    now = [0.0]
    b = Breaker(2, 30.0, lambda: now[0])
    c, s = client((500, {}, ""), (500, {}, ""), breaker=b)
    with pytest.raises(ServerError):
        c.chat(MESSAGE)
    assert b.state == "open" and len(s.calls) == 2
    with pytest.raises(CircuitOpenError):
        c.chat([{"role": "user", "content": "other"}])
    assert len(s.calls) == 2
    now[0] = 31.0
    assert b.state == "half_open"
    b.before()
    with pytest.raises(CircuitOpenError):  # one call tries, others wait
        b.before()
    b.fails()
    assert b.state == "open"
    now[0] = 62.0
    b.before()
    b.succeeded()
    assert b.state == "closed"


def test_budget():
    c, s = client(ok("x"), budget=Budget(0.0001))
    with pytest.raises(BudgetExceededError):
        c.chat(MESSAGE)
    assert not s.calls
    c, _ = client(ok("x", 1_000_000, 1_000_000))
    c.chat(MESSAGE)
    c.chat(MESSAGE)
    assert c.budget.spent == pytest.approx(29.28 + 73.20) and c.budget.calls == 1
    with pytest.raises(ValueError):
        Budget(0)


def test_cache():
    c, s = client(ok("a"), ok("b"))
    assert [c.chat(MESSAGE).from_cache for _ in range(2)] == [False, True]
    assert c.chat(MESSAGE, version="2").text == "b" and len(s.calls) == 2
    assert request_key({"a": 1, "b": 2}) == request_key({"b": 2, "a": 1})
    offline = Client(Settings(offline=True), Script())
    with pytest.raises(AtlasError):
        offline.chat(MESSAGE)


def test_truncation_asks_for_more_once():
    c, s = client(ok("", why="length"), ok("long enough"))
    assert c.chat(MESSAGE).text == "long enough" and [b["max_tokens"] for b in s.calls] == [3000, 9000]
    c, s = client(ok("", why="length"), ok("", why="length"))
    with pytest.raises(TruncatedError):
        c.chat(MESSAGE)


LABEL = {"situation": "disputes_amount", "situation_label": "Disputes", "is_new_situation": False, "agent_failed": True, "confidence": 0.9}


def test_structured():
    c, s = client(ok("```json\n" + json.dumps(LABEL) + "\n```"))
    assert c.structured(MESSAGE, valid_label, "s")[0]["conditions"] == []
    c, s = client(ok('{"situation": "x"}'), ok(json.dumps(LABEL)))
    assert c.structured(MESSAGE, valid_label, "s")[0]["confidence"] == 0.9 and len(s.calls) == 2
    c, s = client(ok("no"), ok(json.dumps(LABEL | {"confidence": 2})))
    with pytest.raises(StructuredOutputError):
        c.structured(MESSAGE, valid_label, "s")
    assert found_json('so: {"a": {}} there') == '{"a": {}}'


def service(url, body, headers, timeout):
    text = body["messages"][1]["content"]
    if "refused" in text:
        return 400, {}, ""
    return ok(json.dumps(LABEL | {"situation": "late" if "late" in text else "disputes_amount"}))


def down(url, body, headers, timeout):
    return 500, {}, ""


CALLS = "id string, turns array<struct<role string, text string>>"


def test_label_table(spark, tmp_path):
    said = {"a": "late again", "b": "too much", "c": "refused here", "d": "my card 4111 1111 1111 1111"}
    calls = spark.createDataFrame([(i, [("caller", t), ("system", "hidden")]) for i, t in said.items()], CALLS)
    first = {r.id: r for r in label_remotely(calls, ["late"], SETTINGS, str(tmp_path), transport=service).collect()}
    assert {i: r.situation for i, r in first.items()} == {"a": "late", "b": "disputes_amount", "c": None, "d": "disputes_amount"}
    assert "BadRequestError" in first["c"].error and not any(r.from_cache for r in first.values())
    again = label_remotely(calls, ["late"], SETTINGS, str(tmp_path), transport=service)
    stats = run_stats(again).first()
    assert (stats.n, stats.labeled, stats.cached, stats.failed, stats.spent) == (4, 3, 3, 1, 0.0) and stats.recorded > 0
    other = label_remotely(calls, ["other"], SETTINGS, str(tmp_path), transport=service)
    assert not other.filter("from_cache").count()  # known slugs are part of the question


def test_budget_stops_the_same_calls_everywhere(spark, tmp_path):
    calls = spark.createDataFrame([(f"{i:03}", [("caller", f"late {i}")]) for i in range(20)], CALLS)
    got = label_remotely(calls, [], Settings(api_key="k", run_budget=1.2), str(tmp_path), transport=service)
    rows = got.orderBy("id").collect()
    assert [r.stopped for r in rows] == [False] * 5 + [True] * 15
    assert run_stats(got).first().stopped_early
    rest = label_remotely(calls, [], Settings(api_key="k", run_budget=100.0), str(tmp_path), transport=service)
    assert rest.filter("from_cache").count() == 5 and rest.filter("situation = 'late'").count() == 20


def test_fallback_while_the_breaker_is_open(spark, tmp_path):
    calls = spark.createDataFrame([(f"{i:03}", [("caller", "late")]) for i in range(30)], CALLS)
    fallback = calls.selectExpr("id", "'by_rule' AS situation", "'By rule' AS situation_label", "true AS is_new", "array('x') AS conditions", "array('y') AS flags", "false AS failed", "'none' AS mode", "0.5D AS confidence", "'keywords' AS labeler")
    quick = Settings(api_key="k", max_attempts=1, breaker_failures=2, max_concurrency=1, run_budget=100.0)
    got = label_remotely(calls, [], quick, str(tmp_path), fallback, down)
    assert got.filter("situation = 'by_rule' AND labeler = 'keywords' AND error IS NULL").count() == 28
    assert got.filter("error LIKE 'ServerError%'").count() == 2


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# mine\nCALLATLAS_RUN_BUDGET='7'\nCALLATLAS_API_KEY=file\n")
    monkeypatch.setenv("CALLATLAS_API_KEY", "shell")
    s = load_settings(tmp_path / ".env")
    assert (s.run_budget, s.api_key) == (7.0, "shell")
    for name, value in (("RUN_BUDGET", "much"), ("RUN_BUDGET", "0"), ("MAX_ATTEMPTS", "0")):
        monkeypatch.setenv(f"CALLATLAS_{name}", value)
        with pytest.raises(ConfigError):
            load_settings(tmp_path / ".env")
        monkeypatch.delenv(f"CALLATLAS_{name}")
    with pytest.raises(ConfigError):
        Settings().key()
