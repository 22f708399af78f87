"""Resolving trace rows to program statements: by equal text, else by the nearest text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracery.plans.scratch import written

_MOST = 2**31 - 1


def statement_index(units: DataFrame) -> DataFrame:
    """Units (unit_id, method, ord, unit_str, src_line) that trace rows can stand for: all but identity statements."""
    return units.where("kind is null or kind <> 'identity'").select("unit_id", "method", "ord", "unit_str", "src_line")


def exact_matches(trace: DataFrame, index: DataFrame, key: str = "pos") -> DataFrame:
    """(key, unit_id) of trace rows (key, method, instr, src_line) with a unit of equal text in their method.

    Of several the one nearest by source line is taken, the first of those.
    """
    u = index.select(F.col("method").alias("um"), "unit_str", "unit_id", "ord", F.col("src_line").alias("ul"))
    pairs = trace.join(u, (F.col("method") == F.col("um")) & (F.col("instr") == F.col("unit_str")))
    return pairs.groupBy(key).agg(F.min_by("unit_id", F.struct(F.abs(F.col("src_line") - F.col("ul")), "ord")).alias("unit_id"))


def _cut(text: Column) -> Column:
    """An ``if`` without what follows ``goto``."""
    return F.when(text.contains("if") & text.contains("goto"), F.split_part(text, F.lit("goto"), F.lit(1))).otherwise(text)


def nearest_matches(trace: DataFrame, index: DataFrame, key: str = "pos") -> DataFrame:
    """(key, unit_id) by text distance, for trace rows that no unit equals.

    The texts of the method's units are taken in the order of their first unit, of
    those with one text the unit nearest by line.  A text must begin with the same
    character; its distance counts up to half the shorter length (beyond, as that).
    A unit replaces the one found before only if its text is no farther and its line
    is nearer.
    """
    units = index.select(F.col("method").alias("um"), "unit_str", _cut(F.col("unit_str")).alias("a"), "ord", F.col("src_line").alias("ul"), "unit_id")
    # of the units with one text on one line only the first can be taken
    lines = units.where("a <> ''").groupBy("um", "a", "unit_str", "ul").agg(F.min(F.struct("ord", "unit_id")).alias("u"))
    # a method has as many texts and lines as its code
    texts = lines.groupBy("um", "a", "unit_str").agg(F.min("u.ord").alias("first"), F.collect_list(F.struct("ul", "u.ord", "u.unit_id")).alias("units"))
    rows = trace.withColumn("b", _cut(F.col("instr"))).where("b <> ''")
    asked = rows.select("method", "b").distinct()
    # distances are measured once for two texts, however many rows have them
    near = (F.col("method") == F.col("um")) & (F.left("a", F.lit(1)) == F.left("b", F.lit(1)))
    limit = F.floor(F.least(F.length("a"), F.length("b")) / 2).cast("int")
    distance = F.expr("levenshtein(a, b, limit)")
    pairs = asked.join(texts, near).withColumn("limit", limit).withColumn("d", F.when(distance == -1, F.col("limit")).otherwise(distance))
    tried = pairs.groupBy("method", "b").agg(F.array_sort(F.collect_list(F.struct("first", "d", "units"))).alias("tried"))
    best = F.expr(f"""aggregate(
        transform(tried, x -> struct(x.d as d, array_min(transform(x.units, y -> struct(cast(abs(src_line - y.ul) as bigint) as gap, y.ord as ord, cast(y.unit_id as bigint) as unit_id))) as u)),
        named_struct('d', {_MOST}, 'gap', cast({_MOST} as bigint), 'unit_id', cast(null as bigint)),
        (s, x) -> if(x.d <= s.d and x.u.gap < s.gap, named_struct('d', x.d, 'gap', x.u.gap, 'unit_id', x.u.unit_id), s), s -> s.unit_id)""")
    # a unit is looked for once for a text and line, however many rows have them
    spots = rows.where("src_line is not null").select("method", "b", "src_line").distinct()
    taken = spots.join(tried, ["method", "b"]).select("method", "b", "src_line", best.alias("unit_id")).where("unit_id is not null")
    return rows.join(taken, ["method", "b", "src_line"]).select(key, "unit_id")


def resolve(trace: DataFrame, units: DataFrame, key: str = "pos") -> DataFrame:
    """(key, unit_id): exact matches, and the nearest text for the rows that have none."""
    index = statement_index(units)
    exact = written(exact_matches(trace, index, key), "exact")
    rest = trace.join(exact, key, "left_anti")
    return exact.select(key, F.col("unit_id").cast("bigint").alias("unit_id")).union(nearest_matches(rest, index, key))
