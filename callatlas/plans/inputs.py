"""The engine's relations over the test tables, each with its SQL. Attributes that a table lacks are stand-ins, made alike on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graders import EXPECTATION
from ..sources.conversations import from_turns, role

OUTCOMES = ["resolved", "partial", "escalated", "caller_abandoned", "not_connected", "agent_error", "compliance_breach"]
RULES = {"billing": ["tion le"], "delivery": ["der die", "und der"], "account": ["que la", "que el"], "general": ["the "]}
CONDITIONS = {"hurried": ["ou"], "formal": ["sch", "ment"], "foreign": ["ç", "ñ", "ü"]}
CRITICAL = ["pii_exposure", "intimidation"]
#: (scenario_id, ord, situation, conditions)
SCENARIOS = [("s-click", 0, "click", ["Hardship"]), ("s-view", 1, "view page", ["hardship", "poor_audio"]), ("s-error", 2, "the error", ["hardship", "poor_audio"]), ("s-buy", 3, "purchase", ["hardship"])]
EXPECTATIONS = [
    ("a", 0, "tool_called", "verify_identity", None, None, None, None),
    ("a", 1, "verify_before_disclosure", None, None, None, None, None),
    ("a", 2, "no_amount_disclosed", None, None, None, None, None),
    ("a", 3, "no_pii_disclosed", None, None, None, None, None),
    ("a", 4, "outcome_in", None, ["resolved", "escalated", "partial"], None, None, None),
    ("a", 5, "max_turns", None, None, 6, None, None),
    ("b", 0, "agent_must_ask_for", None, None, None, "que", None),
    ("b", 1, "must_not_say", None, None, None, None, ["tion le", "der die"]),
    ("b", 2, "no_repeated_agent_turn", None, None, None, None, None),
    ("b", 3, "must_respond_in_caller_language", None, None, None, None, None),
    ("b", 4, "must_escalate", None, None, None, None, None),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("role", role(F.col("role")))


TURNS = "turn_v AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'agent' WHEN 'user' THEN 'caller' ELSE 'system' END AS role, trim(text, E' \\t\\n\\r\\f\\x0B') AS text FROM conversations)"


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, turns, outcome, agent_version, scenario_id)"""
    c = from_turns(table(spark, sf_dir, "conversations"))
    tools = "array<struct<name:string,ok:boolean>>"
    kind = lambda t: F.pmod(F.col("id") + t["turn"], F.lit(5))
    call = lambda name, ok: F.array(F.struct(F.lit(name).alias("name"), ok.alias("ok")))
    made = lambda t: F.when(kind(t) == 0, call("verify_identity", t["turn"] % 2 == 0)).when(kind(t) == 1, call("transfer_to_agent", F.lit(True))).otherwise(F.array().cast(tools))
    language = lambda t: F.when(t["role"] == "agent", "fr-FR").when(F.col("id") % 3 == 0, "en-GB").when(F.col("id") % 3 == 1, "fr-CA").otherwise("de-DE")
    c = c.withColumn("turns", F.transform("turns", lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text"), language(t).alias("language"), made(t).alias("tool_calls"))))
    outcome = F.get(F.array(*map(F.lit, OUTCOMES)), (F.col("id") % 7).cast("int"))
    version = F.when(F.col("id") % 100 < 62, "v2").otherwise("v3")
    return c.withColumns({"outcome": outcome, "agent_version": version, "scenario_id": F.when(F.col("id") % 2 == 0, "a").otherwise("b")})


def expectations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXPECTATIONS, EXPECTATION)


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCENARIOS, "scenario_id string, ord int, situation string, conditions array<string>")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as labelled conversations."""
    e = table(spark, sf_dir, "events")
    kind, n = F.col("event_type"), F.col("event_id")
    situation = F.when(n % 3 == 0, kind).when(n % 3 == 1, F.concat(kind, F.lit("s"))).otherwise(F.concat(F.lit("The "), kind))
    flags = F.array_compact(F.array(F.when((kind == "error") & (F.col("user_id") % 4 == 0), "pii_exposure"), F.when((kind == "purchase") & (n % 50 == 0), "intimidation")))
    conditions = F.array_compact(F.array(F.when(F.col("user_id") % 2 == 0, "hardship"), F.when(F.col("value") < 4, "poor_audio")))
    failed = F.col("value") > F.when((kind == "view") & (n % 100 >= 62), 8).otherwise(14)
    return e.select(
        n.alias("id"), n.alias("ord"), situation.alias("situation"), failed.alias("failed"), conditions.alias("conditions"), flags.alias("flags"),
        F.when(n % 100 < 62, "v2").otherwise("v3").alias("version"), F.lit(0.55).alias("confidence"), (n % 10).cast("double").alias("cost"),
    )


LABELS = """label_v AS (
  SELECT event_id AS id, event_type AS kind,
         CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN event_type || 's' ELSE 'the_' || event_type END AS slug,
         value > CASE WHEN event_type = 'view' AND event_id % 100 >= 62 THEN 8 ELSE 14 END AS failed,
         user_id % 2 = 0 AS hardship, value < 4 AS poor_audio,
         event_type = 'error' AND user_id % 4 = 0 AS pii_exposure, event_type = 'purchase' AND event_id % 50 = 0 AS intimidation,
         CASE WHEN event_id % 100 < 62 THEN 'v2' ELSE 'v3' END AS version, CAST(event_id % 10 AS DOUBLE) AS cost
  FROM events),
keyed AS (SELECT l.*, k.cluster FROM label_v l JOIN (SELECT kind, arg_min(slug, id) AS cluster FROM label_v GROUP BY kind) k USING (kind))"""
