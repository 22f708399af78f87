"""Data flow through library calls, from the rules of ``tracery.sources.rules``.

``calls`` has a row per call: pos, method_sig, base (receiver, null if static), ret
(assigned variable, null if none), args (array of struct<name, type, is_constant>).
``paths`` has (pos, path): what is asked for at a call.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracery.functions import accesspath as ap

#: Tainted paths of a partition, about.
ASKED = 1 << 18


def _field(path: Column) -> Column:
    """The field that a rule's path names: the third word of ``class type field``."""
    return F.when(path != "", F.array(F.get(F.split(path, r"\s+"), F.lit(2)))).otherwise(F.array().cast("array<string>"))


def _fits(arg: Column) -> Column:
    """Whether an argument can carry a flow: neither constant nor primitive."""
    return arg.isNotNull() & ~F.coalesce(arg["is_constant"], F.lit(False)) & ~ap.is_primitive(arg["type"])


def _flows(calls: DataFrame, rules: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """(pos, more, flows): all rules at each call, with the call's names in them.

    The rules of a signature are one row (a few for each parameter), so a signature that
    a third of all calls have is joined like any other, and no call is multiplied.
    """
    packed = rules.groupBy("method_sig").agg(F.collect_list(F.struct("left_type", "left_idx", "left_path", "right_type", "right_idx", "right_path")).alias("rules"))
    nothing = F.array().cast("array<string>")

    def named(name: Column, path: Column) -> Column:
        return F.when(name.isNotNull(), F.concat(F.array(name), _field(path)))

    def one(r: Column) -> Column:
        la, ra = F.get("args", r["left_idx"]), F.get("args", r["right_idx"])
        left = F.when(r["left_type"] == "PARAM", named(la["name"], r["left_path"])).when(r["left_type"] == "RETURN", named(F.col("ret"), r["left_path"])).otherwise(named(F.col("base"), r["left_path"]))
        right = F.when((r["right_type"] == "PARAM") & _fits(ra), named(ra["name"], r["right_path"])).when(r["right_type"] == "INSTANCE", F.when(F.col("base").isNotNull(), F.array("base")))
        ok = F.when(r["left_type"] == "PARAM", _fits(la)).otherwise(F.lit(True))
        return F.struct(r["left_type"].alias("left_type"), left.alias("left"), ok.alias("left_ok"), r["right_type"].alias("right_type"), F.coalesce(right, nothing).alias("right"))

    return calls.join(packed, "method_sig").select("pos", *more, F.transform("rules", one).alias("flows"))


def applied(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules at calls: (pos, left_type, left, left_ok, right_type, right); ``right`` is empty where nothing flows, ``left`` null if the call has none."""
    return _flows(calls, rules).select("pos", F.inline("flows"))


def local_definitions(calls: DataFrame, rules: DataFrame, paths: DataFrame) -> DataFrame:
    """(pos, path, used): the calls that define the base of a path, with each right-hand path; clearing rules define too, with an empty ``used``."""
    flows = applied(calls, rules).where("left is not null")
    hit = flows.join(paths, "pos").where(ap.same_base(F.col("path"), ap.base_of(F.col("left"))))
    return hit.select("pos", "path", F.col("right").alias("used")).distinct()


def forward_taint(calls: DataFrame, rules: DataFrame, taint: DataFrame) -> DataFrame:
    """(pos, path): the tainted paths after each call, given those before it.

    A tainted path that begins with a rule's right side taints its left side, with
    what follows; a flow from the receiver into a parameter or itself brings no rest.
    Paths that a clearing rule names are dropped.
    """
    # rules with names are wide rows: partitions grow in number with what is asked, not in size
    asked = taint.select("pos", "path")
    n = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-asked.count() // ASKED))
    rows = asked.repartition(n, "pos").join(_flows(calls, rules).repartition(n, "pos"), "pos", "left")

    def gained(f: Column) -> Column:
        bare = (f["right_type"] == "INSTANCE") & (f["left_type"] != "RETURN")
        return F.when(bare, f["left"]).otherwise(ap.append(f["left"], ap.after(F.col("path"), f["right"])))

    real = F.filter("flows", lambda f: f["left"].isNotNull())
    sources = F.filter(real, lambda f: (F.size(f["right"]) > 0) & f["left_ok"] & ap.starts_with(F.col("path"), f["right"]))
    cleared = F.transform(F.filter(real, lambda f: f["right_type"] == "CLEAR"), lambda f: f["left"])
    nothing = F.array().cast("array<array<string>>")
    every = F.concat(F.array("path"), F.coalesce(F.transform(sources, gained), nothing))
    left = F.array_except(every, F.coalesce(cleared, nothing))
    return rows.select("pos", F.explode(left).alias("path")).distinct()


def backward_taint(calls: DataFrame, rules: DataFrame, taint: DataFrame) -> DataFrame:
    """(pos, path): paths that the tainted ones after a call come from: the left side replaced by the right."""
    flows = applied(calls, rules).where("left is not null and size(right) > 0")
    hit = flows.join(taint, "pos").where(ap.starts_with(F.col("path"), F.col("left")))
    return hit.select("pos", ap.append(F.col("right"), ap.after(F.col("path"), F.col("left"))).alias("path")).distinct()


def defines_receiver(calls: DataFrame, rules: DataFrame, paths: DataFrame) -> DataFrame:
    """(pos, path) where the call changes its receiver, the path's base, from anything but the receiver."""
    flows = applied(calls, rules).where("left is not null and left_type = 'INSTANCE' and right_type <> 'INSTANCE'")
    hit = flows.join(paths, "pos").where(ap.same_base(F.col("path"), ap.base_of(F.col("left"))))
    return hit.select("pos", "path").distinct()
