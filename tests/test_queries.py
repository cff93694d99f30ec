"""Registered queries against their SQL, and operators on small fixtures."""

import glob
import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from callatlas.functions import costs, stats, text
from callatlas.operators import versions
from callatlas.plans import catalog
from callatlas.sources import conversations

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", catalog.ORACLE)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {Path(f).stem} as select * from '{f}'")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expect = con.sql(f"select {', '.join(columns)} from ({catalog.ORACLE[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, expect))


def test_version_verdicts(spark):
    counts = {"a": (1, 25, 10, 21), "b": (2, 18, 5, 18), "c": (0, 5, 3, 5), "d": (20, 30, 2, 30), "e": (0, 0, 1, 9), "f": (1, 9, 0, 0)}
    rows = []
    for cluster, (fb, nb, fc, nc) in counts.items():
        rows += [(cluster, "v2", i < fb) for i in range(nb)] + [(cluster, "v3", i < fc) for i in range(nc)]
    found = versions.compare(spark.createDataFrame(rows, "cluster string, version string, failed boolean"), "v2", "v3")
    verdicts = {r.cluster: r.verdict for r in found.collect()}
    assert verdicts == {"a": "regression", "b": "unchanged", "c": "insufficient_data", "d": "improvement", "e": "new", "f": "disappeared"}


def test_wilson_without_samples(spark):
    n = F.lit(0)
    assert tuple(spark.range(1).select(stats.wilson(n, n, False), stats.wilson(n, n, True)).first()) == (0.0, 1.0)


def test_redaction(spark):
    texts = ["call 9876543210 now", "card 4111 1111 1111 1111 please", "mail a.b@example.org or xy@ybl", "Authorization: Bearer abcdef123456", "paid 4,500 today", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("s", text.pii_spans(F.coalesce("t", F.lit(""))))
    shown = [r[0] for r in df.select(text.redacted(F.col("t"), F.col("s"))).collect()]
    assert shown == ["call [PHONE] now", "card [CARD] please", "mail [EMAIL] or [UPI]", "[REDACTED_SECRET]", "paid 4,500 today", "", ""]


def test_ingest(spark, tmp_path):
    good = {"id": "c1", "agent_id": "a", "agent_version": "v2", "turns": [{"role": "agent", "text": " hello "}]}
    bad = [{**good, "id": 7}, {**good, "turns": []}, {**good, "turns": [{"role": "robot", "text": "x"}]}, {k: v for k, v in good.items() if k != "agent_id"}]
    (tmp_path / "c.jsonl").write_text("\n".join([json.dumps(good), "", "{not json", *map(json.dumps, bad)]) + "\n")
    read = conversations.read_jsonl(spark, str(tmp_path / "c.jsonl"))
    assert [(r.id, r.turns[0].text) for r in conversations.accepted(read).collect()] == [("c1", "hello")]
    assert {r.reason for r in conversations.reasons(read).collect()} == {"invalid JSON", "id: not a string", "empty transcript", "unknown role", "agent_id: missing"}
    with pytest.raises(conversations.IngestError):
        conversations.enforce_quality(read)


def test_costs(spark):
    assert spark.range(1).select(costs.platform(F.lit(60.0), F.lit(0.0))).first()[0] == pytest.approx(3.5)
    with pytest.raises(ValueError):
        costs.savings_percent(F.lit(1.0), 0)
