"""Conversations from a call platform's paged log.

Pages are the partitions of a Python data source: each is fetched by one task. Fields go
by several names, so rows come as JSON and are brought to one schema by DataFrame functions;
a row of unknown shape is rejected with a reason. A high share of rejects isn't an error here,
since it means that names have changed, which the rows that did work should show.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import AuthError, BadRequestError, IngestError, RateLimitError, ServerError
from .conversations import USAGE, outcome, role, strip

PAGE = 100
#: (status, body) of page number n (from 1) with so many rows.
Fetch = Callable[[int, int], tuple[int, str]]


def rows_of(status: int, body: str) -> list[str]:
    """The rows of a page, each as JSON text."""
    if status in (401, 403):
        raise AuthError("the call log refuses the credentials", status=status)
    if status == 404:
        raise IngestError("there is no call log; export conversations as JSON lines instead")
    if status == 429:
        raise RateLimitError("too many requests to the call log", status=status)
    if status >= 500:
        raise ServerError("the call log is failing", status=status)
    if status >= 400:
        raise BadRequestError("the call log refuses the request", status=status)
    got = json.loads(body)
    return [json.dumps(r, ensure_ascii=False) for r in next((got[k] for k in ("items", "data", "call_logs") if got.get(k)), [])]


def source_of(fetch: Fetch, limit: int) -> type[DataSource]:
    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(n) for n in range(1, -(-limit // PAGE) + 1)]

        def read(self, partition):
            n = partition.value
            for raw in rows_of(*fetch(n, min(PAGE, limit - (n - 1) * PAGE))):
                yield (raw,)

    class CallLog(DataSource):
        @classmethod
        def name(cls):
            return "call_log"

        def schema(self):
            return "value string"

        def reader(self, schema):
            return Reader()

    return CallLog


def read_call_log(spark: SparkSession, fetch: Fetch, agent_id: str, limit: int = 500) -> DataFrame:
    """(conv, reason), as read_jsonl() gives them, of up to `limit` calls. Pages past the end are empty."""
    spark.dataSource.register(source_of(fetch, limit))
    return normalised(spark.read.format("call_log").load(), agent_id)


def normalised(lines: DataFrame, agent_id: str) -> DataFrame:
    rows = lines.select(F.try_parse_json("value").alias("v"))

    def pick(of: Column, kind: str, *names: str) -> Column:
        return F.coalesce(*(F.try_variant_get(of, f"$.{n}", kind) for n in names))

    def text(of: Column, *names: str) -> Column:
        return F.coalesce(*(F.nullif(F.try_variant_get(of, f"$.{n}", "string"), F.lit("")) for n in names))

    v = F.col("v")
    tool = lambda c: F.struct(
        F.coalesce(text(c, "name", "tool"), F.lit("unknown")).alias("name"), text(c, "arguments", "args").alias("arguments"), F.coalesce(pick(c, "boolean", "ok", "success"), F.lit(True)).alias("ok"),
        pick(c, "int", "latency_ms").alias("latency_ms"), text(c, "error").alias("error"),
    )
    none = F.array().cast("array<variant>")
    turn = lambda t: F.struct(
        role(text(t, "role", "speaker")).alias("role"), strip(F.coalesce(text(t, "text", "content", "message"), F.lit(""))).alias("text"), text(t, "language", "lang").alias("language"),
        pick(t, "int", "offset_ms", "start_ms").alias("offset_ms"), pick(t, "int", "duration_ms").alias("duration_ms"), pick(t, "double", "confidence", "asr_confidence").alias("asr_confidence"),
        F.transform(F.coalesce(pick(t, "array<variant>", "tool_calls", "tools"), none), tool).alias("tool_calls"), F.coalesce(pick(t, "boolean", "interrupted", "barge_in"), F.lit(False)).alias("barge_in"),
    )
    raw = pick(v, "array<variant>", "transcript", "turns", "messages", "conversation")
    turns = F.filter(F.transform(F.coalesce(raw, none), turn), lambda t: t["role"].isNotNull() & (t["text"] != ""))
    duration = F.coalesce(pick(v, "double", "duration_seconds", "duration"), F.lit(0.0))
    disposition = F.lower(text(v, "disposition", "status", "end_reason"))
    tokens = {"tts_characters": "tts_characters", "llm_input_tokens": "llm_input_tokens", "llm_cached_input_tokens": "llm_cached_tokens", "llm_output_tokens": "llm_output_tokens"}
    usage = F.struct(duration.alias("audio_seconds"), *(F.coalesce(pick(v, "int", f"usage.{n}"), F.lit(0)).alias(k) for k, n in tokens.items()), F.coalesce(pick(v, "double", "duration_seconds"), F.lit(0.0)).alias("telephony_seconds"), F.size(turns).alias("turns"))
    measured = pick(v, "variant", "usage").isNotNull() | pick(v, "double", "duration_seconds").isNotNull()
    conv = F.struct(
        text(v, "id", "call_id", "conversation_id").alias("id"), F.coalesce(text(v, "agent_id"), F.lit(agent_id)).alias("agent_id"), F.coalesce(text(v, "agent_version", "version"), F.lit("unversioned")).alias("agent_version"),
        F.coalesce(text(v, "channel"), F.lit("telephony")).alias("channel"), F.coalesce(text(v, "language"), F.lit("hi-IN")).alias("language"), F.try_to_timestamp(text(v, "started_at", "created_at")).alias("started_at"),
        duration.alias("duration_s"), turns.alias("turns"), outcome(disposition).alias("outcome"), disposition.alias("disposition"), F.when(measured, usage.cast(USAGE)).alias("usage"), pick(v, "variant", "metadata").alias("metadata"),
    )
    rows = rows.withColumn("conv", conv)
    unknown = v.isNull() | F.col("conv.id").isNull() | (raw.isNull() & pick(v, "variant", "transcript", "turns", "messages", "conversation").isNotNull())
    reason = F.when(unknown, "unrecognised call-log shape").when(F.size("conv.turns") == 0, "empty transcript")
    return rows.select(F.when(reason.isNull(), F.col("conv")).alias("conv"), reason.alias("reason"))
