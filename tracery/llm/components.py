"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is two grouped minima and two joins.  The minima are combined before
they are exchanged, and every join reads two written tables, so a hub that owns
a large share of all edges is split by adaptive execution; no node's neighbours
are gathered in one row or one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def forest(near: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of row and column, of the links in a boolean matrix.

    ``same`` says that rows and columns are the same nodes; the diagonal is then ignored.
    """
    if same:
        np.fill_diagonal(near, False)
    hit = np.flatnonzero(near.any(axis=1))
    shift = 0 if same else len(near)
    label = np.arange(len(near) + (0 if same else near.shape[1]))
    out: list[tuple[int, int]] = []
    for i in hit:
        cols = np.flatnonzero(near[i]) + shift
        groups, first = np.unique(label[cols], return_index=True)
        fresh = groups != label[i]
        if fresh.any():
            out += [(int(i), int(j) - shift) for j in cols[first[fresh]]]
            label[np.isin(label, groups)] = label[i]
    return out


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step.  ``edges`` has (a, b) with a > b; so has the result."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        step = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
    else:
        least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        step = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step = step.union(least.select("a", "m"))
    out = written(step.where("a <> b").distinct(), "star")
    forget(least)
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Label every node of ``edges(a, b)`` (longs) with the least node of its component.

    Returns (node, component) for the nodes that have an edge to another node.
    Loops, repeated edges, either orientation and nulls (ignored) are fine; an
    empty table gives an empty result.  ``rounds`` only guards against a bug: the
    steps needed grow with the logarithm of the longest path.
    """
    a, b = F.col("a"), F.col("b")
    now = written(edges.where("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or tuple(seen) == mark:
            break
        mark = tuple(seen)
        wide = _star(now, True)
        forget(now)
        now = _star(wide, False)
        forget(wide)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
