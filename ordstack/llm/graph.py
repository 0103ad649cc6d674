"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is an aggregation and a join on the node, so a hub with many links is summed before the
shuffle and split by adaptive execution. Every round is stored, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordstack.session import store


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """``(u, v)`` for every node of ``links`` (columns ``a``, ``b``) but the roots: v is the smallest
    node that u is connected to. Links to itself and repeated links do no harm; no links, no rows.
    """
    a, b = F.col("a"), F.col("b")
    edges = store(
        links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links"
    )
    seen = _signature(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        nearest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.filter("v > u").join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").filter("v != m").select(F.col("v"), F.col("m"))
        edges = store(moved.union(lowest).toDF("u", "v").distinct(), "stars")
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    return edges
