"""Made-up conversations from a pack, the same for the same seed whatever the number of tasks: every choice hashes the call's number."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from .conversations import SCHEMA, as_struct
from .packs import Pack

# The share of calls with the older version, the versions, and amounts.
OLD_SHARE, VERSIONS = 0.62, ("v2", "v3")
AMOUNTS = [2500, 3400, 4500, 6200, 8750, 11400, 15600]
LEAST, MOST = 2, 4


def conversation(pack: Pack, i: int, n: int, seed: int) -> dict:
    rng = random.Random(f"{seed}|{i}")
    situation = rng.choices([*pack.situations], [s["weight"] for s in pack.situations.values()])[0]
    spec, version = pack.situations[situation], VERSIONS[i >= int(n * OLD_SHARE)]
    planted = situation == pack.regression.get("cluster") and version == VERSIONS[1]
    failed = rng.random() < (pack.regression["fail_rate"] if planted else spec["fail"])
    filled = lambda text: text.format(name=rng.choice(pack.names), amt=f"{rng.choice(AMOUNTS):,}", date=f"{rng.randrange(1, 28)} tarikh", acct=rng.randrange(10**11, 10**12))
    language, tools = spec.get("language") or rng.choice(pack.languages), [*(spec.get("tools") or [])]
    call = lambda: [{"name": tools.pop(0), "ok": not (failed and rng.random() < 0.25), "latency_ms": rng.randrange(100, 1800)}] if tools else []
    turns = [{"role": "agent", "text": filled(pack.opening), "language": language, "offset_ms": 0, "tool_calls": call() if "verify_identity" in tools[:1] else []}]
    for k in range(rng.randrange(LEAST, MOST)):
        turns.append({"role": "caller", "text": filled(rng.choice(spec["caller"])), "language": language, "offset_ms": 14_000 * k + 6000, "asr_confidence": spec.get("asr_conf", round(rng.uniform(0.7, 0.97), 2)), "tool_calls": []})
        turns.append({"role": "agent", "text": filled(spec["agent"][min(k, len(spec["agent"]) - 1)]), "language": language, "offset_ms": 14_000 * (k + 1), "tool_calls": call()})
    ended = rng.choices(["resolved", "partial", "escalated", "caller_abandoned"], [62, 18, 10, 10])[0]
    outcome = ("compliance_breach" if spec.get("compliance") and rng.random() < 0.6 else "agent_error") if failed else "escalated" if situation == "asks_for_human" else ended
    start = datetime(2026, 1, 1, 9) + timedelta(minutes=rng.randrange(23_000))
    return {"id": f"call_{version}_{i:08d}", "agent_id": f"{pack.name}-agent", "agent_version": version, "channel": "telephony", "language": language, "started_at": start.isoformat(), "duration_s": round(20.0 + 14 * len(turns), 1), "turns": turns, "outcome": outcome, "disposition": outcome, "metadata": {"product": rng.choice(pack.products or ["none"]), "_truth_situation": situation, "_truth_failed": failed}}


def corpus(spark: SparkSession, pack: Pack, n: int, seed: int = 1) -> DataFrame:
    """Conversations in the schema of accepted()."""

    def each(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(conversation(pack, i, n, seed)) for i in b.column(0).to_pylist()], pa.string())], names=["value"])

    rows = spark.range(n).mapInArrow(each, "value string").selectExpr(f"try_variant_get(parse_json(value), '$', 'struct<{as_struct(SCHEMA)}>') AS c")
    return rows.selectExpr("c.*", "'made' AS source")


def lines(pack: Pack, n: int, seed: int = 1):
    """The same as JSON lines, for files."""
    return (json.dumps(conversation(pack, i, n, seed), ensure_ascii=False) for i in range(n))
