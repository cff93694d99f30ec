"""Labels from the remote service for conversations that the cache has none for.

Answers are a table, responses(key, namespace, payload, created_at). A key hashes all that
decides an answer, so a lookup is a left join and what is missing an anti join. The budget
is a running sum of estimates over the missing ones in order of id: those beyond it aren't
asked, on any executor, and the run can be continued later.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..errors import AtlasError, CircuitOpenError
from ..functions.costs import CHARS_PER_TOKEN, LLM_IN, LLM_OUT
from ..functions.text import pii_spans, redacted
from .client import TOKENS, Client, Transport, http_post

VERSION = "1"
TRANSCRIPT_MOST = 6000
RESPONSES = "key string, namespace string, payload string, created_at timestamp"
# Fields of a label and their types.
FIELDS = {"situation": str, "situation_label": str, "is_new_situation": bool, "conditions": list, "agent_failed": bool, "failure_mode": str, "compliance_flags": list, "confidence": float}
MAY_LACK = ["conditions", "failure_mode", "compliance_flags"]
ASK = """You read transcripts of calls and say what situation the caller brought and whether the agent handled it badly.
The situation is the caller's, not the agent's. Use a known slug if one fits; if none does, invent a new one, and say so. A caller who refuses or hangs up hasn't been failed by the agent.
Known slugs: {known}"""
LABELED = "id string, label string, error string, cost double, labeler string, key string"


def valid_label(got: dict) -> dict:
    """The label with defaults; raises ValueError where a field is missing or of another type."""
    out = {}
    for name, kind in FIELDS.items():
        value = got.get(name)
        if value is None and name in MAY_LACK:
            value = [] if kind is list else None
        elif kind is float and isinstance(value, (int, float)) and not isinstance(value, bool):
            value = float(value)
        elif not isinstance(value, kind):
            raise ValueError(f"{name} is missing or no {kind.__name__}")
        out[name] = value
    if not 0 <= out["confidence"] <= 1:
        raise ValueError("confidence isn't between 0 and 1")
    return out


def shown(conversations: DataFrame) -> DataFrame:
    """(id, transcript): what is sent, redacted turn by turn and cut."""
    turns = F.transform(F.filter("turns", lambda t: t["role"] != "system"), lambda t: F.concat(F.upper(t["role"]), F.lit(": "), redacted(t["text"], pii_spans(t["text"]))))
    return conversations.select("id", F.substring(F.array_join(turns, "\n"), 1, TRANSCRIPT_MOST).alias("transcript"))


def keyed(conversations: DataFrame, known: list[str], settings: Settings) -> DataFrame:
    rows = shown(conversations)
    return rows.withColumn("key", F.sha2(F.to_json(F.struct(F.lit(settings.model).alias("model"), F.lit(VERSION).alias("version"), F.lit(TOKENS).alias("tokens"), F.lit(",".join(sorted(known))).alias("known"), "transcript")), 256))


def within_budget(missing: DataFrame, settings: Settings) -> DataFrame:
    """missing with `asked`: whether the estimates up to it, in order of id, are within the budget.

    Ids are dealt to ranges, and sums of ranges come first, so no task sees all rows.
    """
    cost = (F.length("transcript") / CHARS_PER_TOKEN) / 1e6 * LLM_IN + TOKENS / 1e6 * LLM_OUT
    rows = missing.withColumn("estimate", cost).repartitionByRange("id").withColumn("range", F.spark_partition_id())
    sums = rows.groupBy("range").agg(F.sum("estimate").alias("all"))
    sums = sums.withColumn("ahead", F.coalesce(F.sum("all").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("all")
    upto = F.sum("estimate").over(Window.partitionBy("range").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(sums, "range").withColumn("asked", F.col("ahead") + upto <= settings.run_budget).drop("range", "ahead")


def asked(missing: DataFrame, known: list[str], settings: Settings, transport: Transport = http_post, sleep: Callable | None = None) -> DataFrame:
    """LABELED: one request each, by max_concurrency tasks. While the breaker is open, rows get the error circuit_open, for a fallback."""
    import pandas as pd

    prompt = ASK.format(known=", ".join(sorted(known)))

    def each(batches):
        client = Client(settings, transport, **({"sleep": sleep} if sleep else {}))
        for rows in batches:
            out = []
            for r in rows.itertuples():
                messages = [{"role": "system", "content": prompt}, {"role": "user", "content": f"Transcript, personal data masked:\n{r.transcript}"}]
                try:
                    label, answer = client.structured(messages, valid_label, json.dumps({k: v.__name__ for k, v in FIELDS.items()}), VERSION)
                    out.append((r.id, json.dumps(label), None, answer.cost, settings.model, r.key))
                except CircuitOpenError:
                    out.append((r.id, None, "circuit_open", 0.0, None, r.key))
                except AtlasError as e:
                    out.append((r.id, None, f"{type(e).__name__}: {e.message}", 0.0, settings.model, r.key))
            yield pd.DataFrame(out, columns=["id", "label", "error", "cost", "labeler", "key"])

    return missing.select("id", "transcript", "key").repartition(settings.max_concurrency).mapInPandas(each, LABELED)


def responses(spark: SparkSession, path: str, namespace: str) -> DataFrame:
    """The cache; of rows that share a key, the latest. No table yet is an empty one."""
    try:
        rows = spark.read.schema(RESPONSES).parquet(path)
        rows.isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "key string, payload string")
    return rows.filter(F.col("namespace") == namespace).groupBy("key").agg(F.max_by("payload", "created_at").alias("payload"))


def remember(labeled: DataFrame, path: str, namespace: str) -> None:
    made = labeled.filter("label IS NOT NULL").select("key", F.lit(namespace).alias("namespace"), F.to_json(F.struct("label", "cost", "labeler")).alias("payload"), F.current_timestamp().alias("created_at"))
    made.write.mode("append").parquet(path)


LABEL_OF = "situation string, situation_label string, is_new_situation boolean, conditions array<string>, agent_failed boolean, failure_mode string, compliance_flags array<string>, confidence double"


def label_remotely(conversations: DataFrame, known: list[str], settings: Settings, at: str, fallback: DataFrame | None = None, transport: Transport = http_post, sleep=None) -> DataFrame:
    """LABEL rows with error, cost, from_cache and stopped (the budget ended before this call), null labels where there is none.

    at: a folder for the cache and for this run's answers, which are written before anything
    reads them: no call is made twice. fallback: LABEL rows for calls that an open breaker sheds.
    """
    spark, namespace, answers = conversations.sparkSession, "label", f"{at}/responses"
    rows = keyed(conversations, known, settings)
    had = responses(spark, answers, namespace)
    missing = within_budget(rows.join(had, "key", "left_anti"), settings)
    made = spark.createDataFrame([], LABELED)
    if not settings.offline:
        run = f"{at}/runs/{uuid.uuid4().hex}"
        asked(missing.filter("asked"), known, settings, transport, sleep).write.parquet(run)
        made = spark.read.schema(LABELED).parquet(run)
        remember(made, answers, namespace)
    old = had.withColumn("p", F.from_json("payload", "label string, cost double, labeler string")).select("key", *(F.col(f"p.{c}").alias(f"old_{c}") for c in ("label", "cost", "labeler")))
    new = made.select("id", F.col("label").alias("new_label"), "error", F.col("cost").alias("new_cost"), F.col("labeler").alias("new_labeler"))
    out = rows.select("id", "key").join(old, "key", "left").join(new, "id", "left").join(missing.select("id", (~F.col("asked")).alias("stopped")), "id", "left")
    label = F.from_json(F.coalesce("old_label", "new_label"), LABEL_OF)
    out = out.select(
        "id", label.alias("l"), F.coalesce("old_labeler", "new_labeler").alias("labeler"), F.when(F.col("old_label").isNull(), F.col("error")).alias("error"),
        F.coalesce("old_cost", "new_cost", F.lit(0.0)).alias("cost"), F.col("old_label").isNotNull().alias("from_cache"), F.coalesce("stopped", F.lit(False)).alias("stopped"),
    )
    of = {"situation": "situation", "situation_label": "situation_label", "is_new": "is_new_situation", "conditions": "conditions", "flags": "compliance_flags", "failed": "agent_failed", "mode": "failure_mode", "confidence": "confidence"}
    run_columns = ["labeler", "error", "cost", "from_cache", "stopped"]
    if fallback is None:
        return out.select("id", *(F.col(f"l.{v}").alias(k) for k, v in of.items()), *run_columns)
    shed = F.col("error") == "circuit_open"
    other = fallback.select(F.col("id").alias("of"), *(F.col(c).alias(f"f_{c}") for c in (*of, "labeler")))
    out = out.join(other, F.col("id") == F.col("of"), "left")
    picked = [F.when(shed, F.col(f"f_{k}")).otherwise(F.col(f"l.{v}")).alias(k) for k, v in of.items()]
    return out.select("id", *picked, F.when(shed, F.col("f_labeler")).otherwise(F.col("labeler")).alias("labeler"), F.when(~shed | F.col("f_situation").isNull(), F.col("error")).alias("error"), "cost", "from_cache", "stopped")


def run_stats(labels: DataFrame) -> DataFrame:
    """One row: labels, cache hits, failures, what this run spent and what all its labels cost, by how many labellers, and whether it stopped early."""
    ok = F.col("situation").isNotNull()
    return labels.agg(
        F.count("*").alias("n"), F.count_if(ok).alias("labeled"), F.count_if("from_cache").alias("cached"), F.count_if(~ok & ~F.col("stopped")).alias("failed"),
        F.coalesce(F.sum(F.when(~F.col("from_cache"), F.col("cost"))), F.lit(0.0)).alias("spent"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("recorded"),
        F.array_sort(F.collect_set(F.when(ok, F.col("labeler")))).alias("labelers"), F.coalesce(F.bool_or("stopped"), F.lit(False)).alias("stopped_early"),
    )
