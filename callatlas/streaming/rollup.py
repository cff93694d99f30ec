"""The rollup of labelled calls as a stream: counts by cluster, version and window of time.

Counts and sums don't depend on order, so they can be kept up as calls arrive. Clusters do,
so keys are those of the last full run; slugs that it didn't have are clusters of their own
until the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import normalise


def rolled_up(labels: DataFrame, keys: DataFrame, window: str = "1 day", late: str = "2 hours", aliases: dict[str, str] | None = None) -> DataFrame:
    """(window, cluster, version, n, failed, cost). labels: a stream of (ts, situation, failed, version, cost); calls later than `late` are left out of closed windows."""
    rows = labels.withWatermark("ts", late).withColumn("slug", normalise(F.col("situation"), aliases)).join(keys, "slug", "left")
    by = rows.groupBy(F.window("ts", window).alias("window"), F.coalesce("cluster", "slug").alias("cluster"), "version")
    return by.agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"), F.sum("cost").alias("cost"))


def write(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed windows, appended as Parquet, once everything that is there has been read."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
