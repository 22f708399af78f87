"""Taint along frames: which paths are tainted after each library call of a frame.

A path goes its own way through a frame: only the calls whose rules name its base can
clear it or carry it on.  The calls of a frame are numbered and cut into buckets; a
bucket is read once for the paths that come to it, and what is tainted at its end goes
to the next bucket whose calls name its base.  All buckets that something new has come to
are read at the same time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracery.functions import accesspath as ap
from tracery.operators.framework import _flows
from tracery.plans.ordered import last_before, running_total
from tracery.plans.scratch import forget, written

SIZE = 1 << 17


def _norm(element: str) -> str:
    return element.removeprefix("$")


def _begins(path: tuple[str, ...], base: tuple[str, ...]) -> bool:
    return not path if not base else len(base) <= len(path) and all(_norm(a) == _norm(b) for a, b in zip(path, base, strict=False))


def _after_call(path: tuple[str, ...], flows: list[dict]) -> set[tuple[str, ...]]:
    """What is tainted after a call if ``path`` is before it."""
    out, real = {path}, [f for f in flows if f["left"] is not None]
    for f in real:
        right, left = tuple(f["right"]), tuple(f["left"])
        if right and f["left_ok"] and _begins(path, right):
            bare = f["right_type"] == "INSTANCE" and f["left_type"] != "RETURN"
            out.add(left if bare else (left + path[len(right) :])[: ap.MAX_LENGTH])
    return out - {tuple(f["left"]) for f in real if f["right_type"] == "CLEAR"}


def _bucket_walk(schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Buckets from first to last position; at a position its call comes before the paths that are tainted from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, live, kinds = None, {}, None
        out: list[tuple] = []

        def close() -> None:
            out.extend((*at, None, list(p)) for paths in live.values() for p in sorted(paths))
            live.clear()

        def table() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["frame", "b", "pos", "path"])
            out.clear()
            return done

        for batch in batches:
            kinds = [batch.schema.field("frame").type, pa.int64(), pa.int64(), pa.list_(pa.string())]
            for frame, b, pos, path, flows in zip(*(batch.column(c).to_pylist() for c in ("frame", "b", "pos", "path", "flows")), strict=True):
                if (frame, b) != at:
                    if at is not None:
                        close()
                    at = (frame, b)
                if flows is None:
                    live.setdefault(_norm(path[0]), set()).add(tuple(path))
                    continue
                bases = {_norm(side[0]) for f in flows for side in (f["left"], f["right"]) if side}
                before = [p for base in bases for p in live.pop(base, ())]
                after = set().union(*(_after_call(p, flows) for p in before)) if before else set()
                for p in sorted(after):
                    live.setdefault(_norm(p[0]), set()).add(p)
                    out.append((frame, b, pos, list(p)))
            yield table()
        if at is not None:
            close()
            yield table()

    return run


def taint_along(calls: DataFrame, rules: DataFrame, taint: DataFrame, size: int = SIZE) -> DataFrame:
    """(frame, pos, path): for each call of a frame, the tainted paths after it that come from paths whose base its rules name.

    ``calls`` and ``rules`` are those of ``tracery.operators.framework``, with a column
    ``frame``; positions are whole numbers, one call each.  ``taint(frame, pos, path)``
    says from which position on a path is tainted in its frame; its own call does not
    see it yet.  Rows without a frame, position or path, and empty paths, are left out.
    """
    spark = calls.sparkSession
    own = calls.where("frame is not null and pos is not null")
    # frames whose calls lie far apart, as many frames run at once, have as few buckets as any
    own = running_total(own.withColumn("pos", F.col("pos").cast("bigint")), "pos", {"n": F.lit(1).cast("bigint")}, ["frame"], size).withColumn("b", F.floor((F.col("n") - 1) / size))
    acts = written(_flows(own, rules, ["frame", "b"]).select("frame", "b", "pos", "flows"), "flows")
    sides = F.flatten(F.transform("flows", lambda f: F.array(F.get(f["left"], F.lit(0)), F.get(f["right"], F.lit(0)))))
    named = acts.select("frame", "b", "pos", F.explode(F.array_distinct(F.filter(sides, lambda x: x.isNotNull()))).alias("base")).withColumn("base", ap.norm(F.col("base"))).distinct()
    named = written(named, "named")
    held = named.groupBy("frame", "base", "b").agg(F.min("pos").alias("first"))
    after = Window.partitionBy("frame", "base").orderBy("b")
    onward = written(held.select("frame", "base", "b", F.lead("b").over(after).alias("to"), F.lead("first").over(after).alias("first")).where("to is not null"), "onward")
    seeds = taint.where("frame is not null and pos is not null and size(path) > 0").select("frame", F.col("pos").cast("bigint").alias("pos"), "path", ap.norm(F.get("path", F.lit(0))).alias("base")).distinct()
    # a path enters where the next call names its base
    asks = seeds.select("frame", "base", "pos").distinct().withColumn("next", F.lit(None).cast("struct<pos:bigint,b:bigint>"))
    both = asks.unionByName(named.select("frame", "base", "pos", F.struct("pos", "b").alias("next"))).withColumn("o", F.col("pos") * 2 + F.col("next").isNull().cast("int"))
    met = last_before(both, "o", {"first": F.col("next")}, ["frame", "base"], size * 2, forward=True).where("next is null and first is not null")
    start = seeds.join(met.select("frame", "base", "pos", "first"), ["frame", "base", "pos"]).select("frame", F.col("first.b").alias("b"), (F.col("first.pos") - 1).alias("pos"), "path")
    frontier = written(start.distinct(), "entering")
    schema = f"frame {own.schema['frame'].dataType.simpleString()}, b bigint, pos bigint, path array<string>"
    known, found = frontier.select("frame", "b", "pos", "path"), None
    while not frontier.isEmpty():
        active = frontier.select("frame", "b").distinct()
        rows = acts.join(active, ["frame", "b"], "left_semi").select("frame", "b", "pos", F.lit(None).cast("array<string>").alias("path"), "flows")
        rows = rows.unionByName(frontier, allowMissingColumns=True).withColumn("o", F.col("flows").isNull())
        walked = rows.repartition("frame", "b").sortWithinPartitions("frame", "b", "pos", "o").mapInArrow(_bucket_walk(schema), schema)
        walked = written(walked, "walked")
        seen = walked.where("pos is not null").select("frame", "pos", "path")
        found = seen if found is None else found.union(seen)
        left = walked.where("pos is null").select("frame", "b", "path", ap.norm(F.get("path", F.lit(0))).alias("base"))
        more = left.join(onward, ["frame", "base", "b"]).select("frame", F.col("to").alias("b"), (F.col("first") - 1).alias("pos"), "path").distinct()
        frontier = written(more.join(known, ["frame", "b", "pos", "path"], "left_anti"), "entering")
        known = written(known.unionByName(frontier), "entered")
    forget(named)
    return spark.createDataFrame([], "frame " + own.schema["frame"].dataType.simpleString() + ", pos bigint, path array<string>") if found is None else found.distinct()
