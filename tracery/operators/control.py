"""Control dependence: the row that decided that a row was executed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracery.plans.ordered import SIZE, last_before
from tracery.plans.scratch import forget, written


def dominators(stmts: DataFrame, regions: DataFrame, cfg: DataFrame, size: int = SIZE) -> DataFrame:
    """(pos, dom_pos) of the rows that have one.

    ``stmts`` has pos, unit_id, frame_id and kind; ``regions`` (method, region_id,
    unit_id, ord, is_first, is_exception); ``cfg`` (src_unit, dst_unit, ord).  Of the
    regions with a row's unit the last counts.  In a normal one, the predecessors of
    its first unit are taken in order; the first that occurs in the frame, not after
    the row, gives the dominator, its last such occurrence.  In an exception region it
    is the last row, no jump, before the units that the region has before the row's.
    """
    own = regions.groupBy("unit_id").agg(F.max_by(F.struct("region_id", "is_exception", "ord"), "region_id").alias("r"))
    rows = written(stmts.join(own, "unit_id").select("pos", "frame_id", F.col("r.region_id").alias("region_id"), F.col("r.is_exception").alias("is_exception"), F.col("r.ord").alias("ord")), "regioned")

    first = regions.where("is_first").select("region_id", F.col("unit_id").alias("dst_unit"))
    preds = cfg.join(first, "dst_unit").select("region_id", F.col("src_unit").alias("unit"), F.col("ord").alias("rank"))
    asked = rows.where("not is_exception").join(preds, "region_id").select("frame_id", "unit", "pos", "rank", F.lit(None).cast("bigint").alias("seen"))
    there = stmts.join(preds.select(F.col("unit").alias("unit_id")).distinct(), "unit_id", "left_semi").select("frame_id", F.col("unit_id").alias("unit"), "pos", F.lit(None).cast("int").alias("rank"), F.col("pos").cast("bigint").alias("seen"))
    # at one position occurrences come first, as a row can be its own dominator
    both = asked.union(there).withColumn("o", F.col("pos") * 2 + F.when(F.col("seen").isNull(), 1).otherwise(0))
    found = last_before(both.dropDuplicates(["frame_id", "unit", "o"]), "o", {"dom": F.col("seen")}, ["frame_id", "unit"], size)
    normal = asked.drop("seen").join(found.where("seen is null").select("frame_id", "unit", "pos", "dom"), ["frame_id", "unit", "pos"]).where("dom is not null")
    normal = normal.groupBy("pos").agg(F.min_by("dom", "rank").alias("dom_pos"))

    # the place before the earliest of the last occurrences of the units to be passed
    need = rows.where("is_exception").alias("l").join(
        regions.where("is_exception and not coalesce(is_catch, false)").alias("r"), (F.col("l.region_id") == F.col("r.region_id")) & (F.col("r.ord") < F.col("l.ord")), "left"
    ).select("l.pos", F.col("r.unit_id").alias("unit"))
    hits = stmts.join(regions.where("is_exception").select("unit_id").distinct(), "unit_id", "left_semi").select(F.col("unit_id").alias("unit"), "pos", F.col("pos").cast("bigint").alias("seen"))
    both = need.where("unit is not null").select("unit", "pos", F.lit(None).cast("bigint").alias("seen")).union(hits)
    both = both.withColumn("o", F.col("pos") * 2 + F.when(F.col("seen").isNull(), 0).otherwise(1))
    passed = last_before(both, "o", {"at": F.col("seen")}, ["unit"], size).where("seen is null").groupBy("pos").agg(F.min("at").alias("at"))
    froms = need.select("pos").distinct().join(passed, "pos", "left").select("pos", F.coalesce("at", "pos").alias("at"))
    steps = stmts.where("kind <> 'goto'").select(F.lit(None).cast("bigint").alias("of"), F.col("pos").cast("bigint").alias("at"))
    asks = froms.select(F.col("pos").cast("bigint").alias("of"), F.col("at").cast("bigint").alias("at"))
    both = steps.union(asks).withColumn("o", F.col("at") * 2 + F.when(F.col("of").isNull(), 1).otherwise(0))
    both = both.groupBy("o", "at").agg(F.collect_list("of").alias("ofs"))
    before = last_before(both, "o", {"dom": F.when(F.size("ofs") == 0, F.col("at"))}, size=size)
    special = before.select(F.explode("ofs").alias("pos"), F.col("dom").alias("dom_pos")).where("dom_pos is not null")
    return normal.select(F.col("pos").cast("bigint").alias("pos"), "dom_pos").union(special)


def post_dominators(units: DataFrame, cfg: DataFrame, rounds: int = 100_000) -> DataFrame:
    """(unit_id, after): the units that every way from a unit to an end of its method comes by, itself included, in order.

    ``units`` has unit_id, ``cfg`` (src_unit, dst_unit); units are known across methods,
    so all methods settle together.  A unit's set is what its followers have in common,
    and itself; sets start as everything and shrink until none changes, which takes as
    many rounds as the longest way that still changes one.  From a unit that no way leads
    out of to an end only the unit itself is known.
    """
    edges = cfg.select("src_unit", "dst_unit").distinct()
    n = written(edges.groupBy(F.col("src_unit").alias("unit_id")).agg(F.count("*").alias("n")), "followers")
    ends = units.select("unit_id").distinct().join(n, "unit_id", "left_anti").select("unit_id", F.array("unit_id").alias("after"))
    edges, now = written(edges, "edges"), written(ends, "after")
    for _ in range(rounds):
        # a follower without a set yet is everything and takes nothing away
        known = edges.join(now.select(F.col("unit_id").alias("dst_unit"), "after"), "dst_unit")
        common = known.groupBy(F.col("src_unit").alias("unit_id")).agg(F.collect_list("after").alias("sets"))
        least = F.aggregate(F.slice("sets", F.lit(2), F.size("sets")), F.get("sets", F.lit(0)), lambda a, b: F.array_intersect(a, b))
        new = common.select("unit_id", F.array_sort(F.array_union(F.array("unit_id"), least)).alias("after")).unionByName(ends)
        new = written(new, "after")
        moved = new.join(now.withColumnRenamed("after", "was"), "unit_id", "left").where("was is null or was <> after")
        done = moved.isEmpty()
        forget(now)
        now = new
        if done:
            break
    else:
        raise RuntimeError("the post-dominators did not settle; give more rounds")
    rest = units.select("unit_id").distinct().join(now, "unit_id", "left_anti").select("unit_id", F.array("unit_id").alias("after"))
    return now.unionByName(rest)


def control_dependences(after: DataFrame, cfg: DataFrame) -> DataFrame:
    """(unit_id, on_unit, to_unit): the branch ``on_unit`` to ``to_unit`` that decides whether a unit is run: it surely comes after ``to_unit``, but not after ``on_unit``."""
    edges = cfg.select("src_unit", "dst_unit").distinct()
    branches = edges.join(edges.groupBy("src_unit").agg(F.count("*").alias("n")).where("n > 1").select("src_unit"), "src_unit")
    both = branches.join(after.select(F.col("unit_id").alias("src_unit"), F.col("after").alias("here")), "src_unit").join(after.select(F.col("unit_id").alias("dst_unit"), F.col("after").alias("there")), "dst_unit")
    own = F.array_remove("here", F.col("src_unit"))
    return both.select(F.explode(F.array_except("there", own)).alias("unit_id"), F.col("src_unit").alias("on_unit"), F.col("dst_unit").alias("to_unit"))


def regions_of(units: DataFrame, cfg: DataFrame) -> DataFrame:
    """(method, region_id, unit_id, ord, is_first, is_exception): the units of a method that the same branches decide, in the order of ``ord``.

    ``units`` has method, unit_id and ord.  A region is known by its first unit.
    """
    decided = control_dependences(post_dominators(units, cfg), cfg)
    by = decided.groupBy("unit_id").agg(F.array_sort(F.collect_set(F.struct("on_unit", "to_unit"))).alias("by"))
    nothing = F.array().cast(by.schema["by"].dataType)
    named = units.select("method", "unit_id", "ord").join(by, "unit_id", "left").withColumn("by", F.coalesce("by", nothing))
    order = Window.partitionBy("method", "by").orderBy("ord", "unit_id")
    ranked = named.withColumn("place", F.row_number().over(order) - 1).withColumn("region_id", F.first("unit_id").over(order))
    return ranked.select("method", "region_id", "unit_id", F.col("place").alias("ord"), (F.col("place") == 0).alias("is_first"), F.lit(False).alias("is_exception"))
