"""Closures over a long order, bucket by bucket.

Edges of a slice lead from a position to an earlier one.  The order is cut into buckets
of positions; a bucket is walked once from its end for what is new in it and hands the
items that lie elsewhere to the next round.  All buckets with something new are walked
at the same time, so one trace runs in many tasks.  A round's last bucket lies before
that of the round before, so there are at most as many rounds as buckets, and only as
many as a chain of dependences changes its bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import forget, written

#: Positions of a bucket, and edges of a trace in a longer one; a task holds the items of a bucket that are needed and not yet passed.
BUCKET = 1 << 20
#: Rows of an Arrow batch that the walk of shared edges gives, at least.
GIVEN = 1 << 15
#: Buckets with something new up to which only their edges are exchanged.
FEW = 1 << 14
ITEM = ["trace", "pos", "path"]
_B = "_bucket"


def _walker(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Buckets one after the other, last position first; at a position known items (2), then new ones (1), then edges (0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, here, needed, known, live = None, None, {}, set(), None
        for batch in batches:
            out = ([], [], [], [])

            def give(*item: object, out: tuple = out) -> None:
                for column, value in zip(out, item, strict=True):
                    column.append(value)

            for trace, bucket, pos, path, dep, dep_path, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (trace, bucket) != at:
                    at, here, needed = (trace, bucket), None, {}
                if pos != here:
                    here, known, live = pos, set(), None
                if kind == 2:
                    known.add(path)
                elif kind == 1:
                    needed.setdefault(pos, set()).add(path)
                    give(trace, pos, path, True)
                else:
                    if live is None:
                        live = needed.pop(pos, set()) - known
                    if not (path in live if path is not None else live):
                        continue
                    if dep >= pos or dep // size != bucket:
                        give(trace, dep, dep_path, False)
                    elif dep_path not in needed.setdefault(dep, set()):
                        needed[dep].add(dep_path)
                        give(trace, dep, dep_path, True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (batch.schema.field("trace").type, pa.int64(), pa.string(), pa.bool_()), strict=True)], names=[*ITEM, "done"])

    return run


def _plain_walker(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """As ``_walker``, for edges without paths: an item is a position."""

    def values(column: pa.Array) -> list:
        return column.to_numpy().tolist() if pa.types.is_integer(column.type) and not column.null_count else column.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_trace, in_bucket, here, needed, known, live = None, None, None, set(), False, None
        for batch in batches:
            traces, positions, done = [], [], []
            for trace, bucket, pos, dep, kind in zip(*(values(c) for c in batch.columns), strict=True):
                if bucket != in_bucket or trace != in_trace:
                    in_trace, in_bucket, here, needed = trace, bucket, None, set()
                if pos != here:
                    here, known, live = pos, False, None
                if kind == 2:
                    known = True
                elif kind == 1:
                    needed.add(pos)
                    traces.append(trace), positions.append(pos), done.append(True)
                else:
                    if live is None:
                        live = pos in needed and not known
                        needed.discard(pos)
                    if not live:
                        continue
                    away = dep >= pos or dep // size != bucket
                    if not away:
                        if dep in needed:
                            continue
                        needed.add(dep)
                    traces.append(trace), positions.append(dep), done.append(not away)
            yield pa.RecordBatch.from_arrays([pa.array(traces, batch.schema.field("trace").type), pa.array(positions, pa.int64()), pa.array(done, pa.bool_())], names=["trace", "pos", "done"])

    return run


def _shared_walker(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """As ``_walker``, for edges of all traces: a bucket is read once, and each item carries the traces that have come to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, here, needed, known, live, every = None, None, {}, {}, None, None
        out, kind_of = ([], [], [], []), None

        def give(traces: set, pos: int, path: str | None, done: bool) -> None:
            out[0].extend(traces)
            for column, value in zip(out[1:], (pos, path, done), strict=True):
                column.extend([value] * len(traces))

        def table() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (kind_of, pa.int64(), pa.string(), pa.bool_()), strict=True)], names=[*ITEM, "done"])
            for column in out:
                column.clear()
            return made

        for batch in batches:
            kind_of = batch.schema.field("trace").type
            for trace, bucket, pos, path, dep, dep_path, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at:
                    at, here, needed = bucket, None, {}
                if pos != here:
                    # what is needed at rows without edges has been given already
                    here, known, live = pos, {}, None
                if kind == 2:
                    known.setdefault(path, set()).add(trace)
                    continue
                if kind == 1:
                    needed.setdefault(pos, {}).setdefault(path, set()).add(trace)
                    give({trace}, pos, path, True)
                else:
                    if live is None:
                        live = {p: left for p, ts in needed.pop(pos, {}).items() if (left := ts - known.get(p, set()))}
                        every = None
                    if not live:
                        continue
                    if path is not None:
                        come = live.get(path)
                    else:
                        every = set().union(*live.values()) if every is None else every
                        come = every
                    if not come:
                        continue
                    if dep >= pos or dep // size != bucket:
                        give(come, dep, dep_path, False)
                    else:
                        there = needed.setdefault(dep, {}).setdefault(dep_path, set())
                        come = come - there
                        there |= come
                        give(come, dep, dep_path, True)
                if len(out[0]) >= GIVEN:
                    yield table()
        if kind_of is not None:
            yield table()

    return run


def _widened(edges: DataFrame, size: int) -> int:
    """``size`` doubled as long as no trace can have more than ``size`` edges in a bucket; where none has more in all, one bucket for all positions."""
    counts = edges.groupBy("trace", F.floor(F.col("pos") / size)).count()
    most, whole = counts.groupBy("trace").agg(F.max("count").alias("most"), F.sum("count").alias("whole")).agg(F.max("most"), F.max("whole")).first()
    if not whole or whole <= size:
        return max(size, 1 << 62)
    return size << max(0, (size // most).bit_length() - 1)


def walk_back(edges: DataFrame, seeds: DataFrame, size: int = BUCKET, known: DataFrame | None = None) -> DataFrame:
    """Items (trace, pos, path) that can be reached from ``seeds(trace, pos, path)``, seeds included, once each.

    ``edges`` (pos, path, dep_pos, dep_path) lead to earlier positions; an edge without
    a path holds for all items of its row.  Edges with a column ``trace`` hold for that
    trace, others for all: a bucket that any trace has come to is then read once, for all
    of them.  Where edges with traces have no columns ``path``, items are (trace, pos).
    Edges that lead forward are followed too, in rounds of their own.  Nulls in trace or
    positions are in no slice.  ``edges`` should be a written table: each round reads its
    buckets.  Buckets of traces with few edges have more than ``size`` positions, so the
    rounds grow in number with the edges of one trace, not with all positions.

    ``known`` is what an earlier walk over the same edges gave: it is part of the result,
    and nothing is walked again from it, so only what is new is read.
    """
    spark = edges.sparkSession
    own = [c for c in ("trace",) if c in edges.columns]
    pathed = "path" in edges.columns
    item = ITEM if pathed else ITEM[:2]
    edges = edges.where("pos is not null and dep_pos is not null")
    if own:
        size = _widened(edges, size)
    walker = (_walker if pathed else _plain_walker) if own else _shared_walker
    bucket = F.floor(F.col("pos") / size).alias(_B)
    edges = edges.select(*own, bucket, "pos", F.col("dep_pos").cast("bigint").alias("dep_pos"), *(["path", "dep_path"] if pathed else []))
    start = seeds.where("trace is not null and pos is not null").select("trace", F.col("pos").cast("bigint").alias("pos"), *item[2:]).distinct()
    if known is not None:
        known = known.select(*item)
        start = start.join(known, item, "left_anti")
    frontier = written(start, "frontier")
    parts, left = 0, [frontier]
    schema = f"trace {start.schema['trace'].dataType.simpleString()}, pos bigint, {'path string, ' if pathed else ''}done boolean"
    columns = ["trace", _B, "pos", "path", "dep_pos", "dep_path", "kind"] if pathed else ["trace", _B, "pos", "dep_pos", "kind"]
    nothing = {"dep_pos": F.lit(None).cast("bigint"), "dep_path": F.lit(None).cast("string")} if pathed else {"dep_pos": F.col("pos")}
    by = [*own, _B]
    while True:
        new = frontier.select("trace", bucket, *item[1:])
        active = new.select(*by).distinct()
        first, last, many = active.agg(F.min(_B), F.max(_B), F.count("*")).first()
        if first is None:
            break
        near = F.col(_B).between(first, last)
        ways = edges.where(near)
        if many <= FEW:
            # beyond, buckets that nothing has come to are passed over by the walk, which sorts the edges only once
            ways = ways.join(active, by)
        if not own:
            ways = ways.withColumn("trace", F.lit(None).cast(start.schema["trace"].dataType))
        rows = ways.withColumn("kind", F.lit(0)).select(*columns).union(new.withColumns({**nothing, "kind": F.lit(1)}).select(*columns))
        if known is not None:
            old = known.select("trace", bucket, *item[1:]).where(near).join(new.select("trace", _B).distinct(), ["trace", _B], "left_semi")
            rows = rows.union(old.withColumns({**nothing, "kind": F.lit(2)}).select(*columns))
        ordered = rows.repartition(*by).sortWithinPartitions(*by, F.desc("pos"), F.desc("kind"))
        found = ordered.mapInArrow(walker(size), schema).groupBy(*item).agg(F.max("done").alias("done"))
        if known is not None:
            found = found.join(known, item, "left_anti")
        found = written(found, "walked")
        left.append(found)
        frontier, inside = found.where("not done").select(*item), found.where("done").select(*item)
        known, parts = inside if known is None else known.union(inside), parts + 1
        if parts % 16 == 0:
            # the rounds so far become one table; only the last round's own is still read
            known = written(known, "known")
            for done in left[:-1]:
                forget(done)
            left = [known, found]
    return known if known is not None else spark.createDataFrame([], start.schema)
