"""Slices of a dependence graph.

Dependences are (trace, pos, dep_pos, type): row ``pos`` depends on the earlier row
``dep_pos`` by ``data`` or ``control``.  As every dependence points back, a bucket of
positions is walked once for what is new in it, and a slice needs a round for each
change of bucket, not for each level of the graph (``tracery.plans.walk``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracery.plans.closure import reachable
from tracery.plans.scratch import written
from tracery.plans.walk import BUCKET, walk_back


@dataclass(frozen=True)
class Options:
    """What a slice follows; ``once`` follows only rows of the criterion's source line, and of their data the last."""

    data_only: bool = False
    control_only: bool = False
    once: bool = False


def _reached(edges: DataFrame, seeds: DataFrame, size: int) -> DataFrame:
    """(trace, pos) reached from ``seeds(trace, pos)`` along ``edges(trace, pos, dep_pos)``."""
    return walk_back(edges.select("trace", "pos", "dep_pos"), seeds.select("trace", "pos"), size)


def backward_slice(deps: DataFrame, seeds: DataFrame, options: Options = Options(), lines: DataFrame | None = None, size: int = BUCKET) -> DataFrame:
    """(trace, pos, dep_pos, type): the dependences reached backwards from ``seeds(trace, pos)``.

    A seed has an edge of type data to itself.  ``lines(trace, pos, line)`` is needed
    for ``options.once``.  Traces are walked in buckets of ``size`` positions, side by
    side.  Rows without a trace or position are in no slice.
    """
    if options.data_only:
        deps = deps.where("type = 'data'")
    if options.control_only:
        deps = deps.where("type = 'control'")
    if options.once:
        at = lines.join(seeds, ["trace", "pos"], "left_semi").select("trace", F.col("line").alias("l")).distinct()
        same = lines.join(at, ["trace"]).where(F.col("line") == F.col("l")).select("trace", "pos").distinct()
        deps = deps.join(same, ["trace", "pos"], "left_semi")
        deps = deps.groupBy("trace", "pos", "type").agg(F.max("dep_pos").alias("dep_pos"))
    seeds = seeds.where("trace is not null and pos is not null").select("trace", "pos").distinct()
    rows = written(deps.select("trace", "pos", "dep_pos", "type"), "deps")
    needed = _reached(rows, seeds, size)
    first = seeds.select("trace", "pos", F.col("pos").alias("dep_pos"), F.lit("data").alias("type"))
    return rows.join(needed, ["trace", "pos"], "left_semi").union(first)


def reached_again(deps: DataFrame, seeds: DataFrame, reached: DataFrame | None = None, size: int = BUCKET) -> DataFrame:
    """(trace, pos): all rows reached backwards from ``seeds(trace, pos)``, and those of ``reached``, an earlier result over the same dependences.

    Only rows that are new are followed.  Without ``reached`` this is a first run; its
    result should be written to be given to the next.
    """
    known = None if reached is None else reached.select("trace", F.col("pos").cast("bigint").alias("pos"))
    return walk_back(deps.select("trace", "pos", "dep_pos"), seeds.select("trace", "pos"), size, known)


def slice_nodes(edges: DataFrame) -> DataFrame:
    """(trace, pos) of all rows of a slice."""
    return edges.select("trace", "pos").union(edges.select("trace", "dep_pos")).distinct()


def slice_by_frontier(deps: DataFrame, seeds: DataFrame) -> DataFrame:
    """The nodes of a backward slice for dependences of any direction, round by round; for shallow graphs."""
    edges = deps.select(F.struct("trace", "pos").alias("src"), F.struct("trace", F.col("dep_pos").alias("pos")).alias("dst"))
    return reachable(edges, seeds.select(F.struct("trace", "pos").alias("node"))).select("node.trace", "node.pos")


def chop(edges: DataFrame, sources: DataFrame, callers: DataFrame | None = None, size: int = BUCKET) -> DataFrame:
    """(trace, dep_pos, pos): edges of a slice on the ways from ``sources(trace, pos)`` to its criterion.

    ``edges`` is a backward slice.  With ``callers(trace, pos, caller_pos)``, the first
    edge of each caller of a row on the way is added.
    """
    real = written(edges.where("dep_pos <> pos").select("trace", "dep_pos", "pos").distinct(), "ways")
    # the way forward is the way back of the order turned round
    turned = real.select("trace", (-F.col("dep_pos")).alias("pos"), (-F.col("pos")).alias("dep_pos"))
    reached = _reached(turned, sources.select("trace", (-F.col("pos")).alias("pos")), size)
    out = real.join(reached.select("trace", (-F.col("pos")).alias("dep_pos")), ["trace", "dep_pos"], "left_semi").select("trace", "dep_pos", "pos")
    if callers is None:
        return out
    on_way = out.select("trace", F.col("dep_pos").alias("pos")).distinct().join(callers, ["trace", "pos"])
    of = real.groupBy("trace", "dep_pos").agg(F.max("pos").alias("pos"))
    more = on_way.select("trace", F.col("caller_pos").alias("dep_pos")).distinct().join(of, ["trace", "dep_pos"])
    return out.unionByName(more.select("trace", "dep_pos", "pos")).distinct()


def union_slices(a: DataFrame, b: DataFrame) -> DataFrame:
    """All edges of two slices, once each; their types are merged."""
    return a.unionByName(b).distinct()


def edge_kinds(edges: DataFrame) -> DataFrame:
    """(trace, dep_pos, pos, kinds): the types of each edge, ``datacontrol`` if both."""
    # flags are aggregated in place, sets of texts are not
    has = {n: F.max((F.col("type") == n).cast("int")).alias(f"_{n}") for n in ("data", "control")}
    each = edges.groupBy("trace", "dep_pos", "pos").agg(*has.values())
    return each.select("trace", "dep_pos", "pos", F.concat(*[F.when(F.col(f"_{n}") == 1, n).otherwise("") for n in has]).alias("kinds"))


def keep_last(items: DataFrame, seq: str, by: list[str]) -> DataFrame:
    """The last item of each key."""
    row = F.struct(*items.columns)
    return items.groupBy(*by).agg(F.max_by(row, seq).alias("_r")).select("_r.*")


def ordered_slice(edges: DataFrame, descending: bool = True) -> DataFrame:
    """The slice in a total order: by position, then by dependence and type."""
    pos = F.desc("dep_pos") if descending else F.asc("dep_pos")
    return edges.orderBy("trace", pos, "pos", "type")
