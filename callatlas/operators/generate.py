"""Scenarios proposed for clusters that nothing tests. What they expect comes from compliance tables, not from what agents did."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from ..sources.suites import Expectation, Scenario
from .compliance import CONDITIONS, FLAGS

# What every scenario accepts as an outcome, and what a model may ask for beside the tables.
OUTCOMES = ["resolved", "partial", "escalated"]
MAY_ASK = ["outcome_in", "max_turns", "must_escalate", "no_repeated_agent_turn", "must_respond_in_caller_language", "no_pii_disclosed"]
TURNS_MOST = 10


def scenario_id(key: str) -> str:
    return f"GEN-{int(hashlib.sha256(key.encode()).hexdigest()[:6], 16) % 10_000:04d}"


def expectations(flags: list[str], conditions: list[str]) -> list[Expectation]:
    """flags: above the threshold; conditions: the six most frequent. Each expectation once."""
    wanted = [e for f in sorted(flags) for e in FLAGS.get(f, [])] + [e for c in conditions[:6] for e in CONDITIONS.get(c, [])]
    if not any(kind == "outcome_in" for kind, _ in wanted):
        wanted.append(("outcome_in", {"values": OUTCOMES}))
    made: dict[tuple, Expectation] = {}
    for kind, fields in wanted:
        e = Expectation(kind, **fields)
        made.setdefault(e.signature(), e)
    return list(made.values())


def proposed(row: dict) -> Scenario:
    """row: cluster, volume, fail_rate, critical_flags (bare names), conditions in order of frequency, modes"""
    flags, key = row["critical_flags"], row["cluster"]
    seen = "; ".join(row.get("modes") or []) or "none was recorded"
    return Scenario(
        id=scenario_id(key), name=f"{key.replace('_', ' ').capitalize()} (from production)", situation=key,
        description=f"{row['volume']} production calls, {row['fail_rate']:.0%} of them handled badly, and no scenario. How they failed: {seen}.",
        priority="P0" if flags else "P1", conditions=[c for c in row["conditions"][:4] if not c.startswith("compliance:")],
        expectations=expectations(flags, row["conditions"]), tags=["generated", "from_production", *(["compliance"] if flags else [])], generated_from_cluster=key,
    )


def merged(base: Scenario, wish: dict) -> Scenario:
    """base with a model's words and those of its expectations that it may ask for."""
    have = {e.type for e in base.expectations}
    for kind in dict.fromkeys(wish.get("request_expectations") or []):
        if kind in MAY_ASK and kind not in have and kind != "outcome_in":  # one without values tests nothing
            base.expectations.append(Expectation(kind, value=TURNS_MOST if kind == "max_turns" else None))
    for field in ("name", "description", "opening_utterance"):
        setattr(base, field, wish.get(field) or getattr(base, field))
    if wish.get("persona_temperament"):
        base.persona = {**base.persona, "temperament": wish["persona_temperament"]}
    if wish.get("priority") in ("P0", "P1", "P2"):
        base.priority = wish["priority"]
    base.tags = sorted({*base.tags, *(wish.get("tags") or [])})
    return base


def generate(row: dict, ask: Callable[[dict], dict] | None = None) -> Scenario:
    """ask: gives a model's wishes for the row. If it fails, the proposal stands without them."""
    base = proposed(row)
    if ask is None:
        return base
    try:
        return merged(base, ask(row))
    except Exception:  # a proposal is a convenience; any failure leaves the plain one
        return proposed(row)
