"""Renaming access paths across calls: arguments to parameters and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracery.functions import accesspath as ap


def _renamed(paths: DataFrame, names: DataFrame) -> DataFrame:
    """``paths(key, path, is_static)`` with the beginning (key, old) replaced by ``new``; static paths pass unchanged.

    A path that begins with several names has a row for each.  ``changed`` is false
    for paths that no name fits: they do not cross the call.
    """
    moved = paths.join(names, "key", "left").withColumn("to", ap.replace_prefix(F.col("path"), F.array("old"), F.array("new")))
    hit = moved.where("not is_static and to is not null").select("key", F.col("to").alias("path"), "is_static", F.lit(True).alias("changed"))
    still = paths.where("is_static").select("key", "path", "is_static", F.lit(False).alias("changed"))
    return hit.union(still).distinct()


def to_callee(paths: DataFrame, call_args: DataFrame, params: DataFrame) -> DataFrame:
    """Paths at calls in the callee's names: (key, path, is_static, changed).

    ``paths`` has (key, path, is_static), ``call_args`` (key, callee, idx, arg) with the
    receiver as argument 0 of calls that have one, ``params`` (method, idx, local).
    """
    p = params.select(F.col("method").alias("callee"), "idx", F.col("local").alias("new"))
    return _renamed(paths, call_args.join(p, ["callee", "idx"]).select("key", F.col("arg").alias("old"), "new"))


def to_caller(paths: DataFrame, call_args: DataFrame, params: DataFrame) -> DataFrame:
    """The mirror of :func:`to_callee`: paths of a callee in the names of the call ``key``."""
    p = params.select(F.col("method").alias("callee"), "idx", F.col("local").alias("old"))
    return _renamed(paths, call_args.join(p, ["callee", "idx"]).select("key", "old", F.col("arg").alias("new")))


def not_translated(paths: DataFrame, call_args: DataFrame, params: DataFrame, to: str = "callee") -> DataFrame:
    """The paths that do not cross the call: those no parameter or argument fits."""
    p = params.select(F.col("method").alias("callee"), "idx", "local")
    names = call_args.join(p, ["callee", "idx"]).select("key", F.col("arg" if to == "callee" else "local").alias("old"))
    same = (F.col("l.key") == F.col("r.key")) & ap.starts_with(F.col("l.path"), F.array("r.old"))
    return paths.where("not is_static").alias("l").join(names.alias("r"), same, "left_anti")


def change_scope(paths: DataFrame, call_args: DataFrame, params: DataFrame) -> DataFrame:
    """Each path by its ``direction``: "callee", "caller", or anything else for the same method."""
    plain = paths.select("key", "path", "is_static")
    into = to_callee(plain.where(paths["direction"] == "callee"), call_args, params)
    out = to_caller(plain.where(paths["direction"] == "caller"), call_args, params)
    same = plain.where(~paths["direction"].isin("callee", "caller")).withColumn("changed", F.lit(False))
    return into.union(out).union(same)


def caller_context(frames: DataFrame, paths: DataFrame, params: DataFrame) -> DataFrame:
    """(frame_id, caller_pos, path): the paths of a frame that its caller can see, those of parameters and static ones."""
    named = params.select("method", F.col("local").alias("base"))
    seen = frames.join(paths, "frame_id").join(named, "method").where(F.col("is_static") | (F.get("path", F.lit(0)) == F.col("base")))
    return seen.select("frame_id", "caller_pos", "path").distinct()
