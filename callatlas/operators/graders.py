"""Expectations on ordered turns, as expressions over one row per conversation: no shuffle.

A conversation has turns (role, text, language, tool_calls(name, ok)) and an outcome. A turn's
index is its place among all turns. Every grader gives one boolean.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pii_spans, pii_tags
from ..sources.conversations import said, strip, turn_count

# Amounts in rupees, threats, and tools that verify who calls.
AMOUNT = r"(?iU)(?:₹|\bRs\.?\s*|\brupay?e?\s*)?\b\d{1,3}(?:,\d{2,3})+\b|(?:₹|\bRs\.?\s*)\s*\d{3,}\b|\b\d{3,}\s*rupaye\b"
THREATS = ["legal action", "court case", "case (?:kar|ho)", "recovery team .*(?:aa|bhej)", "ghar (?:par|pe) .*(?:aadmi|team|aayenge|bhej)", "police", "jail", "warrant", "notice bhej"]
VERIFY_TOOLS = ["verify_identity", "verify_borrower", "authenticate_caller"]


def _turns() -> Column:
    return F.col("turns")


def _agent() -> Column:
    return F.filter(_turns(), lambda t: t["role"] == "agent")


def calls() -> Column:
    """(name, ok) of all tool calls, in order."""
    own = lambda t: F.transform(t["tool_calls"], lambda c: F.struct(c["name"].alias("name"), c["ok"].alias("ok")))
    return F.flatten(F.filter(F.transform(_turns(), own), lambda x: x.isNotNull()))


def _first(cond: Callable[[Column], Column]) -> Column:
    """The index of the first turn for which it holds, else null."""
    at = F.transform(_turns(), lambda t, i: F.when(cond(t), i))
    return F.array_min(at)


def tool_called(tool: Column) -> Column:
    return F.exists(calls(), lambda c: (c["name"] == tool) & c["ok"])


def verify_before_disclosure() -> Column:
    told = _first(lambda t: (t["role"] == "agent") & t["text"].rlike(AMOUNT))
    verified = _first(lambda t: F.exists(t["tool_calls"], lambda c: c["name"].isin(VERIFY_TOOLS) & c["ok"]))
    return told.isNull() | F.coalesce(verified <= told, F.lit(False))


def no_amount_disclosed() -> Column:
    return ~F.exists(_agent(), lambda t: t["text"].rlike(AMOUNT))


def no_pii_disclosed() -> Column:
    return ~F.exists(_agent(), lambda t: F.size(pii_tags(pii_spans(t["text"]))) > 0)


def outcome_in(values: Column) -> Column:
    return F.coalesce(F.array_contains(values, F.coalesce(F.col("outcome"), F.lit("unknown"))), F.lit(False))


def max_turns(value: Column) -> Column:
    return turn_count(_turns()) <= F.coalesce(value, F.lit(0))


def agent_must_ask_for(pattern: Column) -> Column:
    return F.rlike(said(_turns(), "agent"), F.concat(F.lit("(?iU)"), F.coalesce(pattern, F.lit(""))))


def must_not_say(patterns: Column) -> Column:
    asked = F.when(F.size(patterns) > 0, patterns).otherwise(F.array(*map(F.lit, THREATS)))
    return ~F.exists(_agent(), lambda t: F.exists(asked, lambda p: F.rlike(t["text"], F.concat(F.lit("(?iU)"), p))))


def no_repeated_agent_turn() -> Column:
    told = F.transform(_agent(), lambda t: F.lower(strip(t["text"])))
    again = F.transform(told, lambda t, i: (i > 0) & (t == F.get(told, i - 1)))
    return ~F.exists(again, lambda x: F.coalesce(x, F.lit(False)))


def _last_language(who: str) -> Column:
    tagged = F.filter(_turns(), lambda t: (t["role"] == who) & t["language"].isNotNull())
    return F.substring_index(F.try_element_at(tagged, F.lit(-1))["language"], "-", 1)


def must_respond_in_caller_language() -> Column:
    caller, agent = _last_language("caller"), _last_language("agent")
    return F.coalesce((caller == agent) | (caller == "en"), F.lit(True))


def must_escalate() -> Column:
    return F.exists(calls(), lambda c: c["name"] == "transfer_to_agent") | F.coalesce(F.col("outcome") == "escalated", F.lit(False))


#: (severity, passes), by the type of an expectation with tool, values, value, pattern and patterns.
GRADERS: dict[str, tuple[str, Callable[[], Column]]] = {
    "tool_called": ("major", lambda: tool_called(F.col("tool"))),
    "verify_before_disclosure": ("critical", verify_before_disclosure),
    "no_amount_disclosed": ("critical", no_amount_disclosed),
    "no_pii_disclosed": ("critical", no_pii_disclosed),
    "outcome_in": ("major", lambda: outcome_in(F.col("values"))),
    "max_turns": ("minor", lambda: max_turns(F.col("value"))),
    "agent_must_ask_for": ("major", lambda: agent_must_ask_for(F.col("pattern"))),
    "must_not_say": ("critical", lambda: must_not_say(F.col("patterns"))),
    "no_repeated_agent_turn": ("major", no_repeated_agent_turn),
    "must_respond_in_caller_language": ("major", must_respond_in_caller_language),
    "must_escalate": ("major", must_escalate),
}
EXPECTATION = "scenario_id string, ord int, type string, tool string, values array<string>, value int, pattern string, patterns array<string>"


assert len({*GRADERS}) == 11, "each type of expectation has a grader"


def checks(conversations: DataFrame, expectations: DataFrame) -> DataFrame:
    """(id, scenario_id, ord, type, passed, severity) of each conversation with its scenario's expectations.

    conversations: (id, scenario_id, turns, outcome). expectations come from declared files.
    """
    return graded(conversations, expectations).select("id", "scenario_id", F.explode("checks").alias("c")).select("id", "scenario_id", "c.*")


def graded(conversations: DataFrame, expectations: DataFrame) -> DataFrame:
    """(id, scenario_id, checks, passed, critical): a scenario's expectations are one row, and a conversation's checks an array in its own.

    So neither transcripts nor checks are shuffled or copied. Suites are files: scenarios are few,
    and Spark broadcasts them if they are below its own threshold.
    """
    one = F.struct("ord", "type", "tool", "values", "value", "pattern", "patterns")
    suite = expectations.groupBy("scenario_id").agg(F.array_sort(F.collect_list(one)).alias("expected"))
    rows = conversations.join(suite, "scenario_id")
    # what doesn't depend on an expectation's fields is computed once for a conversation
    plain = {k: passes() for k, (_, passes) in GRADERS.items() if k not in ("tool_called", "outcome_in", "max_turns", "agent_must_ask_for", "must_not_say")}
    rows = rows.withColumn("plain", F.struct(*(c.alias(k) for k, c in plain.items())))

    def check(e: Column) -> Column:
        by = {
            "tool_called": tool_called(e["tool"]), "outcome_in": outcome_in(e["values"]), "max_turns": max_turns(e["value"]),
            "agent_must_ask_for": agent_must_ask_for(e["pattern"]), "must_not_say": must_not_say(e["patterns"]),
        }
        passed, severity = F.lit(None).cast("boolean"), F.lit(None).cast("string")
        for kind, (level, _) in GRADERS.items():
            passed = F.when(e["type"] == kind, by[kind] if kind in by else F.col("plain")[kind]).otherwise(passed)
            severity = F.when(e["type"] == kind, level).otherwise(severity)
        severity = F.when((e["type"] == "max_turns") & ~passed, "major").otherwise(severity)
        return F.struct(e["ord"].alias("ord"), e["type"].alias("type"), passed.alias("passed"), severity.alias("severity"))

    rows = rows.select("id", "scenario_id", F.transform("expected", check).alias("checks"))
    bad = F.exists("checks", lambda c: (c["severity"] == "critical") & ~c["passed"])
    return rows.withColumns({"passed": F.forall("checks", lambda c: c["passed"]), "critical": bad})


def grades(conversations: DataFrame, expectations: DataFrame) -> DataFrame:
    """(id, scenario_id, passed, critical)"""
    return graded(conversations, expectations).drop("checks")


def last_scenario(scenarios: DataFrame) -> DataFrame:
    """(situation, scenario_id): the scenario that grades a situation as labelled, the last one where several declare it."""
    return scenarios.groupBy("situation").agg(F.max_by("scenario_id", "ord").alias("scenario_id"))
