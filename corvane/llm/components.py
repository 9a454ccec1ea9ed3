"""Connected components of an undirected graph, by alternating large-star and small-star steps.

Every round rewrites the edges so that each vertex points to a smaller neighbour; the number of rounds is
about the logarithm of the longest path, and edges never grow in number. A round is two shuffles on
vertex ids. No list of neighbours is ever built. A vertex with more than ``HUB`` edges would meet all of
them in one task: its smallest neighbour is broadcast to its edges instead (there are at most the edges
over ``HUB`` of such vertices). Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.runtime import Workspace


HUB = 1 << 20


def _with_least(edges: DataFrame, hubs: bool) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) with the smallest v of each u, and (u, least); hubs: whether some u may have more than HUB edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n"))
    few = least.select("u", "least")
    if not hubs:
        return edges.join(few, "u"), few
    large = F.broadcast(least.where(F.col("n") > HUB).select("u", "least"))
    rest = edges.join(large.select("u"), "u", "left_anti").join(few, "u")
    return edges.join(large, "u").unionByName(rest), few


def _star(edges: DataFrame, large: bool, hubs: bool = False) -> DataFrame:
    """One star step on (u, v) edges with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined = _with_least(both, hubs)[0].where(F.col("v") > F.col("u"))
        moved = joined.select(F.col("v").alias("u"), F.least("least", "u").alias("v"))
    else:
        joined, least = _with_least(edges, hubs)
        moved = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
    return moved.where("u != v").distinct()


def connected_components(edges: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """(id, component): every vertex of edges (a, b) and the smallest vertex that it can reach.

    Null ends and loops are ignored. Vertices without edges aren't listed.
    """
    now = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    turn, now = 0, work.write(now, f"{name}-0")
    state, hubs = None, 2 * now.count() > HUB
    while True:
        turn += 1
        after = work.write(_star(_star(now, True, hubs), False, hubs), f"{name}-{turn}")
        signature = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s"), F.countDistinct("u").alias("d")).first()
        work.drop(f"{name}-{turn - 1}")
        if signature["n"] == signature["d"] and state == (signature["n"], signature["s"]):
            break
        state, now = (signature["n"], signature["s"]), after
    return after.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(after.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
