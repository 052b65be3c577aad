"""Connected components without gathering links: alternating large-star and small-star steps.

A large-star step hangs each node's larger neighbours on its least neighbour, a small-star step its smaller ones; both
keep connectivity, and the links become stars around each component's least node in about log(n) rounds. A step is a
minimum by node (combined before its shuffle) joined back to the links; nodes that hold more links than a task should are
taken out of that join and looked up instead (they are few: counted first). Each round is stored in the shared folder, so
a lost executor costs a part of one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: Links that one task takes without being split.
LIGHT = 50_000


def _state(edges: DataFrame) -> tuple[int, bool]:
    """Number of links, and whether they are stars: each node has one link upwards or is a centre, not both."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    nodes = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    r = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
    return r[0], r[1] == 0


def _with_least(links: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """``links (u, v)`` with ``m`` of their ``u``. Nodes with more than half a task's share of ``n`` links are broadcast."""
    tasks = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(LIGHT, n // (2 * tasks))
    heavy = [(r.u, r.m) for r in least.where(F.col("n") > most).select("u", "m").collect()] if n > LIGHT else []
    if not heavy:
        return links.join(least.select("u", "m"), "u")
    known = F.broadcast(links.sparkSession.createDataFrame(heavy, "u bigint, m bigint"))
    return links.join(known, "u").unionByName(links.join(known, "u", "left_anti").join(least.select("u", "m"), "u"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for each node that isn't the least of its component; links to itself and nulls are ignored."""
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    n, stars = _state(edges)
    while not stars:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
        large = _with_least(both.where("v > u"), least, 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        if n > LIGHT:
            large = cut(large.distinct())  # read for its minima, their number and the links
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = _with_least(large, low, n)
        small = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").where("u != v").distinct())
        n, stars = _state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
