"""Connected components by alternating large-star and small-star steps over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store


def components(store: Store, edges: DataFrame, name: str = "cc") -> DataFrame:
    """node, component (the smallest node of its component) for every node of an edge table (a, b: longs).

    Each step is joins and aggregations with map-side combining, written to the shared folder; a hub's edges are a
    skewed side that adaptive execution splits. Nothing but one row of totals reaches the driver. Self-loops and
    repeated edges are harmless; no edges give no rows.
    """
    a, b = F.col("a"), F.col("b")
    now = store.write(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), f"{name}-0")
    before, step = None, 0
    while True:
        totals = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum((b % 1_000_003)).alias("s")).first()
        if totals["n"] == 0 or totals == before:
            break
        before = totals
        both = now.union(now.select(b, a).toDF("a", "b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter(b > a).select(b.alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        linked = small.select(b.alias("a"), F.col("m").alias("b")).union(small.select(a, F.col("m").alias("b")))
        step += 1
        now = store.write(linked.filter("a <> b").distinct(), f"{name}-{step}")
        if step > 1:
            store.drop(f"{name}-{step - 2}")
    return now.select(a.alias("node"), b.alias("component")).union(now.select(b, b).distinct())
