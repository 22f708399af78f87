"""Fixpoints over edge tables: reachability by a frontier, heads of chains by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import forget, written


def reachable(edges: DataFrame, seeds: DataFrame, rounds: int = 10_000) -> DataFrame:
    """Nodes that can be reached from ``seeds(node)`` along ``edges(src, dst)``, seeds included.

    Each round joins only the nodes found in the round before and drops those already
    known.  Every round is written, so the lineage stays short and a lost executor
    costs one round.
    """
    known = frontier = written(seeds.select("node").where("node is not null").distinct(), "frontier")
    parts = [known]
    for _ in range(rounds):
        found = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = written(found.join(known, "node", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        parts.append(frontier)
        known = known.union(frontier)
        if len(parts) % 16 == 0:
            known = written(known, "known")
    else:
        raise RuntimeError("reachable nodes did not settle; give more rounds")
    return known


def heads(links: DataFrame) -> DataFrame:
    """(node, head) for ``links(node, up)``: the end of the chain of ``up`` that starts at each node.

    ``up`` is null at a head; a node has one link, and links have no cycles.  The
    distance covered doubles each round, so chains of n nodes need log2(n) rounds.
    """
    now = written(links.select("node", F.coalesce("up", "node").alias("head")), "heads")
    while True:
        above = now.select(F.col("node").alias("n"), F.col("head").alias("h"))
        step = written(now.join(above, F.col("head") == F.col("n"), "left").select("node", F.coalesce("h", "head").alias("to"), "head"), "heads")
        forget(now)
        moved = not step.where("to <> head").isEmpty()
        now = step.select("node", F.col("to").alias("head"))
        if not moved:
            return now
