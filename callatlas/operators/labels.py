"""Keyword labels: the first rule that matches, every condition that does, failures and compliance flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pii_spans, pii_tags
from ..sources.conversations import said
from . import graders

# What an agent says that gives in to an injected instruction.
GIVES_IN = r"(?iU)waive|maaf kar|cancel|check karti"
LABEL = "id, situation, situation_label, is_new, conditions, flags, failed, mode, confidence, labeler"


def any_keyword(text: Column, keywords: list[str]) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(text, F.lit(k))
    return out


def first_match(text: Column, rules: dict[str, list[str]]) -> Column:
    """The first rule with a keyword in the lower-cased text, else unclassified."""
    low, out = F.lower(text), F.lit("unclassified")
    for slug, keywords in reversed(rules.items()):
        out = F.when(any_keyword(low, keywords), slug).otherwise(out)
    return out


def all_matches(text: Column, rules: dict[str, list[str]]) -> Column:
    """Every rule with a keyword in the lower-cased text, in the rules' order."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(any_keyword(low, k), F.lit(slug)) for slug, k in rules.items()), F.lit(None).cast("string")))


def failure(outcome: Column, looped: Column, tool_failed: Column) -> tuple[Column, Column]:
    """(failed, mode): a loop before a failed tool before the outcome."""
    bad = F.coalesce(outcome.isin("agent_error", "compliance_breach"), F.lit(False))
    mode = F.when(looped, "the agent repeats a turn").when(tool_failed, "a tool call fails").when(bad, "the outcome is a failure of the agent")
    return looped | tool_failed | bad, mode


def confidence(situation: Column) -> Column:
    return F.when(situation == "unclassified", 0.2).otherwise(0.55)


def flags(situation: Column, conditions: Column, by_situation: dict[str, list[str]]) -> Column:
    """Compliance flags that the transcript shows: four of all domains, then those of the situation. Each once, in this order."""
    agent = F.filter(F.col("turns"), lambda t: t["role"] == "agent")
    told = ~graders.no_amount_disclosed()
    shown = F.exists(agent, lambda t: F.size(pii_tags(pii_spans(t["text"]))) > 0)
    threatens = ~graders.must_not_say(F.array().cast("array<string>"))
    own = [
        F.when(shown, "pii_exposure"),
        F.when(~graders.verify_before_disclosure(), "disclosure_without_verification"),
        F.when(F.array_contains(conditions, "third_party") & (situation != "wrong_number") & told, "third_party_disclosure"),
        F.when(threatens, "unauthorised_legal_threat"),
    ]
    needs = {
        "deceased_borrower_pursued": told,
        "third_party_disclosure": told,
        "prompt_injection_engaged": said(F.col("turns"), "agent").rlike(GIVES_IN),
        "call_frequency_complaint_unhandled": ~F.exists(graders.calls(), lambda c: c["name"] == "transfer_to_agent"),
    }
    for slug, listed in by_situation.items():
        own += [F.when((situation == slug) & needs.get(f, F.lit(True)), f) for f in listed]
    return F.array_distinct(F.array_compact(F.array(*own)))


def keyword_labels(conversations: DataFrame, rules: dict[str, list[str]], conditions: dict[str, list[str]], by_situation: dict[str, list[str]], known: list[str]) -> DataFrame:
    """LABEL for each conversation (id, turns, outcome), by rules only. No shuffle."""
    c = conversations.withColumn("caller", said(F.col("turns"), "caller"))
    c = c.withColumn("situation", first_match(F.col("caller"), rules)).withColumn("conditions", all_matches(F.col("caller"), conditions))
    looped = ~graders.no_repeated_agent_turn()
    broke = F.exists(graders.calls(), lambda t: ~F.coalesce(t["ok"], F.lit(True)))
    failed, mode = failure(F.col("outcome"), looped, broke)
    return c.select(
        "id", "situation", F.initcap(F.replace(F.col("situation"), F.lit("_"), F.lit(" "))).alias("situation_label"), (~F.col("situation").isin(known) if known else F.lit(True)).alias("is_new"),
        "conditions", flags(F.col("situation"), F.col("conditions"), by_situation).alias("flags"), failed.alias("failed"), F.when(failed, mode).alias("mode"),
        confidence(F.col("situation")).alias("confidence"), F.lit("keywords").alias("labeler"),
    )
