"""Connected components of an edge list, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import durable


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node it reaches) for the undirected ``edges`` a, b.

    Alternates large-star and small-star steps (each one grouped minimum and one join) until nothing changes;
    rounds grow with the logarithm of the longest path.  Self-loops and repeated edges are harmless.
    """
    e = durable(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct())
    total = None
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi")
        e = durable(small.select("hi", F.col("m").alias("lo")).union(small.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).where("hi <> lo").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == total:
            break
        total = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select("lo", "lo")).distinct()
