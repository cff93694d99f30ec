"""Connected components of links, as tables: large-star and small-star steps in turn."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep


def _star(links: DataFrame, small: bool) -> DataFrame:
    """links: (u, v), u > v. Each neighbour of u (the smaller ones and u itself, or the larger ones) goes to its smallest."""
    both = links if small else links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if small:
        moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        least = least.select("u", F.least("u", "m").alias("m"))
        moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): the smallest id that is reachable. Ids alone aren't in it."""
    now = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    state = None
    while True:
        last, now = now, keep(_star(_star(now, small=False), small=True))
        discard(last)
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(got) == state:
            break
        state = tuple(got)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def unite(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """parent: each one's smallest known member. With links x-y, all at once."""
    while len(x):
        a, b = parent[x], parent[y]
        apart = a != b
        if not apart.any():
            break
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return parent
