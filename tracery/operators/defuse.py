"""Data dependence: reaching definitions as windows over a trace's order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracery.functions import accesspath as ap
from tracery.plans.ordered import SIZE, last_before, previous, running_total

STATIC_REACH = 5000


def reaching_definition(rows: DataFrame, by: Sequence[str], is_def: Column, pos: str = "pos", size: int = SIZE) -> DataFrame:
    """Rows with ``def_pos``: the last row before that defines, within the same keys (frame or thread, and base)."""
    return last_before(rows, pos, {"def_pos": F.when(is_def, F.col(pos))}, by, size)


def reaching_definitions(rows: DataFrame, by: Sequence[str], kills: Column, adds: Column, uses: Column, pos: str = "pos", size: int = SIZE) -> DataFrame:
    """(use_pos, def_pos): every row since the last killing definition, that one included, that defines or adds to the base.

    The killing rows cut the rows of a base into segments: uses and definitions of a
    segment are joined by equality, and nothing is compared across segments.
    """
    marked = rows.withColumns({"_k": kills, "_a": adds, "_u": uses})
    parts = running_total(marked, pos, {"_seg": F.col("_k").cast("int")}, by, size)
    # a row that kills begins a segment as a definition, but its own uses still see the one before
    use = parts.where("_u").select(*by, F.col(pos).alias("use_pos"), (F.col("_seg") - F.col("_k").cast("int")).alias("_seg"))
    defs = parts.where("_k or _a").select(*by, F.col(pos).alias("def_pos"), "_seg")
    return use.join(defs, [*by, "_seg"]).where("def_pos < use_pos").select("use_pos", "def_pos")


def static_definition(rows: DataFrame, key: str, writes: Column, in_initialiser: Column, pos: str = "pos", reach: int = STATIC_REACH, size: int = SIZE) -> DataFrame:
    """Rows with ``def_pos``: the nearest write of the static field before, else the first within ``reach`` positions after that a static initialiser makes."""
    back = last_before(rows, pos, {"_b": F.when(writes, F.col(pos))}, [key], size)
    both = last_before(back, pos, {"_f": F.when(writes & in_initialiser, F.col(pos))}, [key], size, forward=True)
    ahead = F.when(F.col("_f") - F.col(pos) <= reach, F.col("_f"))
    return both.withColumn("def_pos", F.coalesce("_b", ahead)).drop("_b", "_f")


def closest_before(rows: DataFrame, by: Sequence[str] = (), pos: str = "pos", size: int = SIZE) -> DataFrame:
    """Rows with ``before_pos``: the position of the row before within the keys."""
    return previous(rows, pos, {"before_pos": pos}, by, size)


def use_paths(units: DataFrame) -> DataFrame:
    """(unit_id, ord, path, is_static): what a statement uses.

    ``units`` has unit_id, kind, right (``static_field``, ``field``, ``invoke``, ``local``
    or other), right_class, right_base, right_field and locals (array of the locals of
    the right-hand side, or of the whole statement if it assigns nothing).  Reading a
    field uses that field; a call, a copy or anything else uses the locals; a
    statement that uses nothing has one empty path.
    """
    assign, right = F.col("kind") == "assign", F.col("right")
    static = F.array(F.struct(F.array("right_class", "right_field").alias("path"), F.lit(True).alias("is_static")))
    field = F.array(F.struct(F.array("right_base", "right_field").alias("path"), F.lit(False).alias("is_static")))
    plain = F.transform(F.coalesce("locals", F.array().cast("array<string>")), lambda x: F.struct(F.array(x).alias("path"), F.lit(False).alias("is_static")))
    empty = F.array(F.struct(F.array().cast("array<string>").alias("path"), F.lit(False).alias("is_static")))
    uses = F.when(assign & (right == "static_field"), static).when(assign & (right == "field"), field).otherwise(plain)
    uses = F.when(F.size(uses) > 0, uses).otherwise(empty)
    return units.select("unit_id", F.posexplode(uses).alias("ord", "u")).select("unit_id", "ord", "u.path", "u.is_static")


def static_field_definition(asks: DataFrame, writes: DataFrame, reach: int = STATIC_REACH, size: int = SIZE) -> DataFrame:
    """(pos, path, def_pos, source): where the static path asked for at a row was written, and what was written there.

    ``asks`` are (pos, path), ``writes`` (pos, path, right, in_initialiser); paths are
    arrays that begin with a class.  A write defines all paths that begin with its own.
    The nearest one before the row counts; without one the first within ``reach``
    positions after it that a static initialiser makes.  ``source`` is the written
    variable with what the asked path has behind the write's, cut to the longest length.
    Every beginning of an asked path is a key of an as-of join, so nothing but equal
    keys meet.  Rows without a position or with an empty path are left out.
    """
    key = lambda c: F.concat_ws("\x01", F.transform(c, ap.norm))
    known = asks.where("pos is not null and size(path) > 0").select(F.col("pos").cast("bigint").alias("pos"), "path").distinct()
    begun = known.select("pos", "path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("n"))
    begun = begun.select("pos", "path", "n", key(F.slice("path", F.lit(1), F.col("n"))).alias("key"))
    made = writes.where("pos is not null and size(path) > 0").select(F.col("pos").cast("bigint").alias("pos"), key(F.col("path")).alias("key"), F.coalesce("in_initialiser", F.lit(False)).alias("init"), F.size("path").alias("n"), "right")
    ask = begun.select("pos", "key").distinct().withColumn("at", F.lit(None).cast("bigint"))
    act = made.select("pos", "key", "init", F.col("pos").alias("at")).distinct()

    def nearest(acts: DataFrame, forward: bool) -> DataFrame:
        # a row's own write is neither before nor after it
        both = ask.unionByName(acts.drop("init")).withColumn("o", F.col("pos") * 2 + (F.col("at").isNotNull() != F.lit(forward)).cast("int"))
        found = last_before(both, "o", {"def_pos": F.col("at")}, ["key"], size * 2, forward=forward)
        return found.where("at is null and def_pos is not null").select("pos", "key", "def_pos")

    back = begun.join(nearest(act, False), ["pos", "key"]).groupBy("pos", "path").agg(F.max("def_pos").alias("back"))
    ahead = begun.join(nearest(act.where("init"), True).where(F.col("def_pos") - F.col("pos") <= reach), ["pos", "key"]).groupBy("pos", "path").agg(F.min("def_pos").alias("ahead"))
    hits = known.join(back, ["pos", "path"], "left").join(ahead, ["pos", "path"], "left").select("pos", "path", F.coalesce("back", "ahead").alias("def_pos"))
    wrote = made.select(F.col("pos").alias("def_pos"), "n", "right")
    rest = F.slice("path", F.col("n") + 1, F.greatest(F.size("path") - F.col("n"), F.lit(0)))
    return hits.join(wrote, "def_pos", "left").select("pos", "path", "def_pos", F.when(F.col("def_pos").isNotNull(), ap.append(F.array("right"), rest)).alias("source"))
