"""Predicates and projections of executed statements, as Column expressions over their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A field at which data flow stops.
STOP_FIELD = "mContext"
LIBRARY = "android.support."


def is_return(kind: Column) -> Column:
    return kind.isin("return", "return_void")


def is_assign(kind: Column) -> Column:
    return kind == "assign"


def has_invoke(called_sig: Column) -> Column:
    return called_sig.isNotNull()


def kept_field(kind: Column, has_field_ref: Column, field_id: Column) -> Column:
    """The traced field id, for assignments that touch a field only."""
    return F.when((kind == "assign") & has_field_ref, field_id)


def statement_key(pos: Column, subsig: Column, class_: Column, unit: Column, field_id: Column, thread_id: Column, line: Column, file: Column) -> Column:
    """The text that names a statement instance; unset parts are left out."""
    parts = [pos.cast("string"), subsig, class_, unit]
    for mark, part in ((":FIELD:", field_id), (":THREAD:", thread_id), (":LINENO:", line), (":FILE:", file)):
        parts.append(F.concat(F.lit(mark), part.cast("string")))
    return F.concat_ws(", ", *parts)


def is_after(pos: Column, other_pos: Column, other_name: Column) -> Column:
    """Whether a row comes after another, which static initialisers always precede."""
    return (pos > other_pos) | (other_name == "<clinit>")


def may_set(called_name: Column) -> Column:
    return F.coalesce(called_name.startswith("set"), F.lit(False))


def is_android(class_: Column, field: Column) -> Column:
    """Library code, and the field at which slices stop."""
    return class_.startswith(LIBRARY) | F.coalesce(field == STOP_FIELD, F.lit(False))


def matching_type(types: Column, class_: Column) -> Column:
    """Whether any of several paths (array of arrays of types) mentions a class."""
    return F.exists(types, lambda t: F.array_contains(t, class_))


def call_of(units: DataFrame, jumps: DataFrame) -> DataFrame:
    """(unit_id, called_sig): what a statement calls; an ``if`` calls what its target calls."""
    own = units.select("unit_id", "kind", "called_sig")
    target = jumps.join(units.select(F.col("unit_id").alias("target"), F.col("called_sig").alias("t")), "target").select("unit_id", "t")
    both = own.join(target, "unit_id", "left")
    return both.select("unit_id", F.when(F.col("kind") == "if", F.col("t")).otherwise(F.col("called_sig")).alias("called_sig"))


def parameter_locals(paths: DataFrame, params: DataFrame) -> DataFrame:
    """Paths (method, path) whose base is a parameter, or the receiver, of the method."""
    return paths.join(params.select("method", F.col("local").alias("_l")).distinct(), ["method"]).where(F.get("path", F.lit(0)) == F.col("_l")).drop("_l")
