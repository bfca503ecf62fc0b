"""Connected components of an edge table by alternating star contraction.

Large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): each is an aggregation for the least neighbour and
a join with it, so no neighbourhood is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``edges``: long columns u, v. Returns node, root: root is the least node
    of the component; nodes without an edge to another node are absent."""
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _digest(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()  # points downwards: v < u
        small = large.join(_least(large), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, written(small.union(_least(large).select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(before)
        was, seen = seen, _digest(now)
        if seen == was:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
