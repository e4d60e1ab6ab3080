"""Connected components by alternating star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from precinct.runtime import cut

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component) for every node of the (u, v) edges; a component is its smallest node.

    A round is two stars; each is a grouped minimum with map-side partials, written out, and a
    join of the arcs with it. As both inputs of the join are plain reads, adaptive execution
    may split the arcs of a hub over many tasks. Rounds grow with the logarithm of the
    component size. Null ends and loops link nothing; a run that does not settle is an error.
    """
    arcs, mark = _kept(edges.where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct())
    for _ in range(max_rounds):
        if not mark[0]:
            break
        arcs, after = _kept(_small_star(_large_star(arcs)))
        if after == mark:
            break
        mark = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled arcs all point at the smallest node of their component
    roots = arcs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return arcs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _kept(arcs: DataFrame) -> tuple[DataFrame, tuple]:
    """The arcs written out, with a fingerprint to see whether a round changed them."""
    seen = Observation()
    mark = [
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("total"),
        F.bit_xor(F.xxhash64("v", "u")).alias("mixed"),
    ]
    kept = cut(arcs.observe(seen, *mark))
    return kept, (seen.get["n"], seen.get["total"], seen.get["mixed"])


def _large_star(arcs: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    lowest = cut(arcs.groupBy("u").agg(F.min("v").alias("low")))
    above = arcs.selectExpr("v AS u", "u AS far").join(lowest, "u", "left")
    return above.selectExpr("far AS u", "coalesce(low, u) AS v").distinct()


def _small_star(arcs: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of those neighbours."""
    arcs = cut(arcs)
    lowest = cut(arcs.groupBy("u").agg(F.min("v").alias("low")))
    moved = arcs.join(lowest, "u").where("v <> low").selectExpr("v AS u", "low AS v")
    return moved.unionByName(lowest.selectExpr("u", "low AS v")).distinct()
