"""Connected components by alternating large-star and small-star rounds.

Every round is one minimum for each node (combined before the shuffle) and one
join against those minima, which are unique by node, so a hub's neighbours can
be split over tasks. Rounds are cut through the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, freeing


def _mark(edges: DataFrame) -> tuple:
    with freeing(edges.sparkSession):
        r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges(a, b)`` that has a neighbour; the component is its
    smallest node. Loops, nulls and repeated edges are dropped; no edges give no rows."""
    e = edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e)
    seen = _mark(e)
    while seen[0]:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(tied.union(low).distinct())
        now = _mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


#: Parts into which the join with a component's smallest id is dealt.
SALTS = 32


def smallest(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, component_id) for each node of ``edges(a, b)`` that has a neighbour: the smallest id in reach
    (null only if there is none), from ``ids(node, id)``. A large component is dealt over ``SALTS`` keys."""
    comps = cut(components(edges).join(ids.select("node", "id"), "node"))
    least = comps.groupBy("component").agg(F.min("id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return comps.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(least, ["component", "salt"]).select("node", "component_id")
