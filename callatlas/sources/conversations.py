"""Conversations from JSON lines and from turn tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IngestError

# Roles as sources name them.
ROLES = {"agent": "agent", "assistant": "agent", "bot": "agent", "user": "caller", "caller": "caller", "customer": "caller", "human": "caller", "system": "system", "tool": "system"}
# What dispositions of call platforms mean; others mean nothing.
OUTCOMES = {
    "goal_achieved": "resolved", "completed": "resolved", "success": "resolved", "partial": "partial", "in_progress": "partial", "transferred": "escalated", "escalated": "escalated",
    "user_hangup": "caller_abandoned", "abandoned": "caller_abandoned", "no_answer": "not_connected", "busy": "not_connected", "failed": "not_connected", "error": "agent_error", "bot_error": "agent_error",
}
REJECT_MOST = 0.20

TOOL = "struct<name:string,arguments:string,ok:boolean,latency_ms:int,error:string>"
TURN = f"struct<role:string,text:string,language:string,offset_ms:int,duration_ms:int,asr_confidence:double,tool_calls:array<{TOOL}>,barge_in:boolean>"
USAGE = "struct<audio_seconds:double,tts_characters:int,llm_input_tokens:int,llm_cached_input_tokens:int,llm_output_tokens:int,telephony_seconds:double,turns:int>"
SCHEMA = f"id string, agent_id string, agent_version string, channel string, language string, started_at timestamp, duration_s double, turns array<{TURN}>, outcome string, disposition string, usage {USAGE}, metadata variant"


def role(name: Column) -> Column:
    """The role that a source's name means, else null."""
    return F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))[F.lower(F.trim(name))]


def outcome(disposition: Column) -> Column:
    """The outcome that a source's disposition means, else null: a guess would be worse."""
    return F.create_map(*(F.lit(x) for pair in OUTCOMES.items() for x in pair))[F.lower(F.trim(disposition))]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def read_jsonl(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(conv, reason): each line that isn't blank as a conversation, or why it is rejected. strict: the first reject is an error when it is read."""
    lines = spark.read.text(path).filter(F.length(strip(F.col("value"))) > 0)
    return checked(lines, strict)


def checked(lines: DataFrame, strict: bool = False) -> DataFrame:
    """read_jsonl() of (value). A line is parsed once, as a variant; its fields are cast from there."""
    parsed = lines.select(F.try_parse_json("value").alias("v")).withColumn("conv", F.try_variant_get("v", "$", f"struct<{as_struct(SCHEMA)}>"))
    kind = lambda f: F.schema_of_variant(F.try_variant_get(F.col("v"), f"$.{f}", "variant"))
    missing = [F.when(F.coalesce(kind(f), F.lit("VOID")) == "VOID", F.lit(f"{f}: missing")).when(kind(f) != "STRING", F.lit(f"{f}: not a string")) for f in ("id", "agent_id", "agent_version")]
    turns = F.col("conv.turns")
    reason = F.when(F.col("v").isNull(), F.lit("invalid JSON"))
    for m in missing:
        reason = F.coalesce(reason, m)
    reason = F.coalesce(
        reason,
        F.when(F.coalesce(F.size(turns), F.lit(0)) < 1, F.lit("empty transcript")),
        F.when(F.exists(turns, lambda t: ~F.coalesce(t["role"], F.lit("")).isin("agent", "caller", "system")), F.lit("unknown role")),
    )
    if strict:
        reason = F.when(reason.isNotNull(), F.raise_error(F.concat(F.lit("rejected: "), reason)).cast("string"))
    clean = F.transform(turns, lambda t: t.withField("text", strip(F.coalesce(t["text"], F.lit("")))).withField("tool_calls", F.transform(F.coalesce(t["tool_calls"], F.array().cast(f"array<{TOOL}>")), lambda c: c.withField("ok", F.coalesce(c["ok"], F.lit(True))))))
    defaults = {"channel": "telephony", "language": "hi-IN", "duration_s": 0.0}
    conv = F.col("conv").withField("turns", clean)
    for name, value in defaults.items():
        conv = conv.withField(name, F.coalesce(F.col(f"conv.{name}"), F.lit(value)))
    return parsed.select(F.when(reason.isNull(), conv).alias("conv"), reason.alias("reason"))


def as_struct(ddl: str) -> str:
    """A table's columns as a struct's fields."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString().removeprefix("struct<").removesuffix(">")


def accepted(read: DataFrame) -> DataFrame:
    return read.filter("reason IS NULL").select("conv.*", F.lit("jsonl").alias("source"))


def reasons(read: DataFrame, n: int | None = None) -> DataFrame:
    """Reasons by how often they occur; the first n."""
    out = read.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")
    return out.limit(n) if n else out


def ingest_summary(read: DataFrame) -> str:
    n, bad = read.agg(F.count("*"), F.count("reason")).first()
    top = ", ".join(f"{r.reason} ({r.n})" for r in reasons(read, 3).collect()) if bad else ""
    return f"accepted {n - bad} of {n} conversations" + (f"; rejected: {top}" if top else "")


def enforce_quality(read: DataFrame, most: float = REJECT_MOST) -> None:
    """Raises where over this share of the lines is rejected, and where there are none."""
    n, bad = read.agg(F.count("*"), F.count("reason")).first()
    if n == 0:
        raise IngestError("no conversations")
    if bad / n > most:
        raise IngestError(f"{bad} of {n} lines rejected")


def from_turns(turns: DataFrame) -> DataFrame:
    """(id, turns) from one row per turn: (conv_id, turn, role, text). One shuffle; turns in order."""
    one = F.struct("turn", role(F.col("role")).alias("role"), strip(F.col("text")).alias("text"))
    return turns.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))


def turn_count(turns: Column) -> Column:
    return F.size(F.filter(turns, lambda t: t["role"].isin("agent", "caller")))


def said(turns: Column, who: str) -> Column:
    """What one role says, joined by spaces."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == who), lambda t: t["text"]), " ")


def transcript(turns: Column) -> Column:
    told = F.filter(turns, lambda t: t["role"] != "system")
    return F.array_join(F.transform(told, lambda t: F.concat(F.upper(t["role"]), F.lit(": "), t["text"])), "\n")
