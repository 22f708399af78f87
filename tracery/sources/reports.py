"""Slices as text: lines, dependences, CSV, graph.

``rows`` has a row per dependence of a slice, in the order ``seq``: dep_pos, dep_file,
dep_line, dep_unit, dep_thread, dep_method, dep_class (the statement), pos, src_file,
src_line (what depends on it), path (dotted), kinds (``data``, ``control``,
``datacontrol``).  Each report is (n, line), ``n`` being the order of first mention.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the key of the lines that come last.
LAST = 2**31 - 2


def _first_seen(rows: DataFrame, line: Column, order: Column | None = None) -> DataFrame:
    return rows.select((F.struct("seq") if order is None else order).alias("n"), line.alias("line")).groupBy("line").agg(F.min("n").alias("n")).select("n", "line")


def _place(file: str, line: str) -> Column:
    return F.concat_ws(":", F.coalesce(file, F.lit("null")), F.col(line).cast("string"))


def _trimmed(unit: str) -> Column:
    return F.split_part(F.replace(F.col(unit), F.lit("\\"), F.lit("")), F.lit("goto"), F.lit(1))


def slice_lines(rows: DataFrame) -> DataFrame:
    """``file:line`` of each statement, once."""
    return _first_seen(rows, _place("dep_file", "dep_line"))


def source_lines(rows: DataFrame) -> DataFrame:
    """The set of ``file:line`` with a known line."""
    return rows.where("dep_line <> -1").select(_place("dep_file", "dep_line").alias("line")).distinct()


def dependence_lines(rows: DataFrame, criteria: DataFrame | None = None) -> DataFrame:
    """``(file:line)  instruction <--kind[:path]-- file:line``, by position; the criteria's own edges come last."""
    path = F.when(F.col("kinds") == "data", F.concat(F.lit(":"), "path")).otherwise("")
    line = F.concat(F.lit("("), _place("dep_file", "dep_line"), F.lit(")  "), _trimmed("dep_unit"), F.lit(" <--"), "kinds", path, F.lit("-- "), _place("src_file", "src_line"))
    own = F.col("dep_pos") == F.col("pos")
    if criteria is not None:
        rows = rows.join(criteria.select(F.col("pos").alias("_c")).distinct(), F.col("pos") == F.col("_c"), "left")
        own = own & F.col("_c").isNotNull()
    key = F.when(own, F.lit(LAST)).otherwise(F.col("dep_pos"))
    # the flag comes first, as a trace may have later positions than the key of the last lines
    return _first_seen(rows, line, F.struct(own.alias("last"), key.cast("bigint").alias("key"), F.col("seq")))


def raw_lines(rows: DataFrame) -> DataFrame:
    """``file:line    thread    pos:instruction``."""
    gap = F.lit("    ")
    line = F.concat(_place("dep_file", "dep_line"), gap, F.col("dep_thread").cast("string"), gap, F.col("dep_pos").cast("string"), F.lit(":"), "dep_unit")
    return _first_seen(rows, line)


def line_or_ordinal(line: Column, ordinal: Column) -> Column:
    """The source line, or the ordinal of the unit in its method if it is -1."""
    return F.coalesce(F.nullif(line, F.lit(-1)), ordinal)


def csv_lines(rows: DataFrame) -> DataFrame:
    """``ID, Method, Class, Line, Source, Var``: one line per statement text of a method, commas as semicolons, ids -1."""
    text = F.concat_ws(", ", *[F.translate(F.col(c), ",", ";") for c in ("dep_method", "dep_class", "dep_unit")])
    whole = F.concat_ws(", ", F.lit("-1"), text, F.col("dep_line").cast("string"), F.lit("-1"), F.col("path"))
    return rows.groupBy(text.alias("_t")).agg(F.min("seq").alias("n"), F.min_by(whole, "seq").alias("line")).select("n", "line")


def dependence_map(rows: DataFrame) -> DataFrame:
    """(dep_pos, text): how each statement came into the slice, the last mention counting."""
    kind = F.when(F.col("kinds") == "data", F.concat(F.lit("data, varaible:"), "path")).otherwise(F.lit("control, no variable"))
    text = F.when(F.col("path") == "", "start").otherwise(F.concat(kind, F.lit(", source:"), F.col("pos").cast("string")))
    return rows.groupBy("dep_pos").agg(F.max_by(text, "seq").alias("text"))


def dot_lines(rows: DataFrame) -> DataFrame:
    """The slice as a graph in DOT: control edges dashed, data edges with their path."""
    name = F.concat(_place("dep_file", "dep_line"), F.lit(": "), _trimmed("dep_unit"))
    source = F.concat(_place("src_file", "src_line"), F.lit(": "), _trimmed("src_unit"))

    def quoted(c: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))

    style = F.when(F.col("kinds") == "control", "dashed").otherwise("solid")
    label = F.when(F.col("kinds") == "data", F.col("path")).otherwise("")
    edge = F.concat(quoted(source), F.lit(" -> "), quoted(name), F.lit(" [style="), style, F.lit(", label="), quoted(label), F.lit("];"))
    return _first_seen(rows, F.when(F.col("dep_pos") == F.col("pos"), F.concat(quoted(source), F.lit(";"))).otherwise(edge))


def write_report(lines: DataFrame, path: str, head: list[str] = [], tail: list[str] = []) -> None:
    """Write (n, line) as one text file's worth of lines in order, between ``head`` and ``tail``."""
    spark = lines.sparkSession
    parts = lines.orderBy("n").select(F.col("line").alias("value"))
    frame = [spark.createDataFrame([(x,) for x in part], "value string").coalesce(1) for part in (head, tail)]
    parts = frame[0].union(parts) if head else parts
    parts = parts.union(frame[1]) if tail else parts
    parts.write.mode("overwrite").text(path)
