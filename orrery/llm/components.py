"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


#: Parts that a node's edges are spread over.
PARTS = 8


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v) holds every neighbour v of u that the step looks at. A node's least neighbour is aggregated before it meets the edges, and those of a hub meet it in several tasks."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    part = F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int")
    met = edges.withColumn("part", part).join(least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["u", "part"])
    if large:
        return met.filter("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return met.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.filter("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b")))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge to another but the smallest of each component; component is the smallest node reached.

    edges(a, b): undirected, self loops and nulls are ignored, duplicates allowed; an empty table gives no rows.
    Links stay in tables; the driver sees only two sums per round, to tell when nothing moves any more.
    """
    now = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, large=True).distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        new = written(_star(down, large=False).distinct(), "edges")
        found = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = new
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
