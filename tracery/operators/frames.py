"""Activation frames: the maximal chains of FLOW edges, their callers and what they return."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracery.operators.dcfg import CALL, FLOW
from tracery.plans.closure import heads
from tracery.plans.ordered import SIZE, last_before, previous
from tracery.plans.scratch import written


def frame_ids(stmts: DataFrame, edges: DataFrame, size: int = SIZE) -> DataFrame:
    """(pos, frame_id): the first row of the chain of FLOW edges that each row is on.

    Most FLOW edges join neighbours, and their runs are found in one ordered window;
    only the heads of runs that go on from an earlier row are chased up their chain.
    """
    up = edges.where(F.col("type") == FLOW).select(F.col("dst").alias("pos"), F.col("src").alias("up"))
    rows = previous(stmts.select("pos").join(up, "pos", "left"), "pos", {"_p": "pos"}, size=size)
    is_head = F.col("up").isNull() | ~F.col("up").eqNullSafe(F.col("_p"))
    seen = last_before(rows.withColumn("_h", F.when(is_head, F.col("pos"))), "pos", {"_l": F.col("_h")}, size=size)
    runs = written(seen.select("pos", F.coalesce("_h", "_l").alias("run"), F.when(F.col("_h").isNotNull(), F.col("up")).alias("up")), "runs")
    open_ = runs.where("up is not null")
    if open_.isEmpty():
        return runs.select("pos", F.col("run").alias("frame_id"))
    onto = runs.select(F.col("pos").alias("up"), F.col("run").alias("to"))
    links = open_.select(F.col("pos").alias("node"), "up").join(onto, "up").select("node", F.col("to").alias("up"))
    tops = links.select(F.col("up").alias("node")).distinct().join(links.select("node"), "node", "left_anti").select("node", F.lit(None).cast("bigint").alias("up"))
    found = heads(links.unionByName(tops)).select(F.col("node").alias("run"), "head")
    return runs.join(found, "run", "left").select("pos", F.coalesce("head", "run").alias("frame_id"))


def frame_table(stmts: DataFrame, ids: DataFrame, edges: DataFrame) -> DataFrame:
    """A row per frame: frame_id, method, thread_id, first_pos, last_pos, n_rows, caller_pos (its own head if nothing calls it)."""
    rows = stmts.select("pos", "method", "thread_id").join(ids, "pos")
    frames = rows.groupBy("frame_id").agg(
        F.min_by("method", "pos").alias("method"), F.min_by("thread_id", "pos").alias("thread_id"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n_rows")
    )
    calls = edges.where(F.col("type") == CALL).groupBy(F.col("dst").alias("frame_id")).agg(F.min("src").alias("src"))
    return frames.join(calls, "frame_id", "left").withColumn("caller_pos", F.coalesce("src", "first_pos")).drop("src")


def callers(ids: DataFrame, frames: DataFrame) -> DataFrame:
    """(pos, caller_pos) of every row."""
    return ids.join(frames.select("frame_id", "caller_pos"), "frame_id").select("pos", "caller_pos")


def callees(edges: DataFrame) -> DataFrame:
    """(pos, callee_pos): the first statement that each calling row calls."""
    return edges.where(F.col("type") == CALL).groupBy(F.col("src").alias("pos")).agg(F.min("dst").alias("callee_pos"))


def neighbours(stmts: DataFrame, edges: DataFrame, forward: bool = True) -> DataFrame:
    """(pos, near_pos, type) of the rows after (or before) each row in the graph."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    return stmts.select("pos").join(edges.select(F.col(a).alias("pos"), F.col(b).alias("near_pos"), "type"), "pos")


def called_frames(stmts: DataFrame, edges: DataFrame, frames: DataFrame) -> DataFrame:
    """(call_pos, frame_id, ret_pos, ret_var, ret_type) of each traced call whose name is that of the method called.

    Without a returned variable, a frame of a method that is not static returns its
    receiver ``r0``.  ``stmts`` needs called_name, ret_var, ret_type, name, class and
    is_static.
    """
    target = callees(edges).join(frames.select(F.col("frame_id").alias("callee_pos"), "last_pos"), "callee_pos")
    last = stmts.select(F.col("pos").alias("last_pos"), "ret_var", "ret_type", "name", "class", "is_static")
    calls = stmts.where("called_sig is not null").select("pos", "called_name")
    found = calls.join(target, "pos").join(last, "last_pos").where("called_name = name")
    receiver = ~F.col("is_static")
    return found.select(
        F.col("pos").alias("call_pos"), F.col("callee_pos").alias("frame_id"), F.col("last_pos").alias("ret_pos"),
        F.coalesce("ret_var", F.when(receiver, "r0")).alias("ret_var"), F.coalesce("ret_type", F.when(receiver, F.col("class"))).alias("ret_type"),
    )


def library_calls(stmts: DataFrame, edges: DataFrame) -> DataFrame:
    """Calling rows without a traced callee."""
    return stmts.where("called_sig is not null").join(edges.where(F.col("type") == CALL).select(F.col("src").alias("pos")), "pos", "left_anti")


def chunk(ids: DataFrame, forward: bool = False) -> DataFrame:
    """(pos, member_pos): the rows of its frame up to each row (``forward``: from it on).

    Frames are joined with themselves: for looking at single frames, not for whole traces.
    """
    pairs = ids.select("pos", "frame_id").join(ids.select(F.col("pos").alias("member_pos"), "frame_id"), "frame_id")
    return pairs.where("member_pos >= pos" if forward else "member_pos <= pos").select("pos", "member_pos")


def islands(stmts: DataFrame, edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(pos, frame_id, step): frames with the number of each row within its frame."""
    ids = written(frame_ids(stmts, edges), "frames") if ids is None else ids
    return ids.withColumn("step", F.row_number().over(Window.partitionBy("frame_id").orderBy("pos")) - 1)
