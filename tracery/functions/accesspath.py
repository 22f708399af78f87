"""Access paths as Column expressions: a variable and the fields followed from it.

A path is a struct of ``path`` and ``types`` (arrays of strings), ``is_static`` and
``clipped`` (booleans), ``used_at`` and ``defined_at`` (positions, null if unset).  All
functions take and return columns and stay in the JVM.  Elements are compared without
one leading ``$``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest path.
MAX_LENGTH = 10
#: Names of primitive types.
PRIMITIVES = ("boolean", "byte", "char", "double", "float", "int", "long", "short")


def norm(element: Column) -> Column:
    """An element without one leading ``$``."""
    return F.regexp_replace(element, r"^\$", "")


def _norms(path: Column) -> Column:
    return F.transform(path, norm)


def make(path: Column, types: Column, is_static: Column | None = None, used_at: Column | None = None, defined_at: Column | None = None) -> Column:
    """A path, cut to :data:`MAX_LENGTH` elements."""
    nothing = F.lit(None).cast("int")
    return F.struct(
        F.slice(path, 1, MAX_LENGTH).alias("path"), F.slice(types, 1, MAX_LENGTH).alias("types"),
        (F.lit(False) if is_static is None else is_static).alias("is_static"), (F.size(path) > MAX_LENGTH).alias("clipped"),
        (nothing if used_at is None else used_at).alias("used_at"), (nothing if defined_at is None else defined_at).alias("defined_at"),
    )


def single(base: Column, type_: Column) -> Column:
    """The path of one variable; a null type is an error."""
    checked = F.when(type_.isNull(), F.raise_error(F.lit("null type"))).otherwise(type_)
    return make(F.array(norm(base)), F.array(checked.cast("string")))


def clip(path: Column) -> Column:
    return F.slice(path, 1, MAX_LENGTH)


def is_clipped(path: Column) -> Column:
    return F.size(path) > MAX_LENGTH


def path_string(path: Column, clipped: Column | None = None) -> Column:
    """Dotted form, with ``.*`` if the path was cut."""
    tail = F.lit("") if clipped is None else F.when(clipped, ".*").otherwise("")
    return F.concat(F.concat_ws(".", path), tail)


def starts_with(path: Column, base: Column) -> Column:
    """Whether ``path`` begins with ``base``; an empty base is the beginning of an empty path only."""
    fits = (F.size(base) <= F.size(path)) & (_norms(F.slice(path, F.lit(1), F.size(base))) == _norms(base))
    return F.when(F.size(base) == 0, F.size(path) == 0).otherwise(fits)


def is_prefix_of(path: Column, other: Column) -> Column:
    """Whether ``path`` is a strict beginning of ``other``."""
    return (F.size(path) < F.size(other)) & starts_with(other, path)


def has_common_prefix(a: Column, b: Column) -> Column:
    return (_norms(a) == _norms(b)) | is_prefix_of(a, b) | is_prefix_of(b, a)


def no_common(path: Column, types: Column, more: Column, more_types: Column) -> Column:
    """Whether no element of ``more`` is already in ``path`` with the same type."""
    return ~F.arrays_overlap(F.arrays_zip(path.alias("p"), types.alias("t")), F.arrays_zip(more.alias("p"), more_types.alias("t")))


def append(path: Column, more: Column) -> Column:
    """``path`` extended and cut to the longest length."""
    return clip(F.concat(path, more))


def base_of(path: Column) -> Column:
    return F.get(path, F.lit(0))


def fields_of(path: Column) -> Column:
    return F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0)))


def last_field(path: Column) -> Column:
    """The last field; empty for a path without fields."""
    return F.when(F.size(path) > 1, F.element_at(path, -1)).otherwise(F.lit(""))


def after(path: Column, base: Column) -> Column:
    """What follows ``base`` in ``path``; empty if it does not begin so."""
    rest = F.slice(path, F.size(base) + 1, F.greatest(F.size(path) - F.size(base), F.lit(0)))
    return F.when(starts_with(path, base), rest).otherwise(F.slice(path, F.lit(1), F.lit(0)))


def has_after(path: Column, base: Column) -> Column:
    return F.size(after(path, base)) > 0


def same_path(a: Column, b: Column) -> Column:
    return _norms(a) == _norms(b)


def same_base(path: Column, name: Column) -> Column:
    return norm(base_of(path)) == norm(name)


def class_index(types: Column, class_: Column) -> Column:
    """Place of a class among a path's types, -1 if absent."""
    return F.array_position(types, class_) - 1


def clip_from(path: Column, index: Column) -> Column:
    return F.slice(path, index.cast("int") + 1, F.greatest(F.size(path) - index.cast("int"), F.lit(0)))


def replace_base(path: Column, base: Column) -> Column:
    return F.transform(path, lambda x, i: F.when(i == 0, base).otherwise(x))


def replace_prefix(path: Column, old: Column, new: Column) -> Column:
    """``path`` with its beginning ``old`` replaced, cut to the longest length; null if it does not begin so."""
    return F.when(starts_with(path, old), append(new, after(path, old)))


def is_parameter(path: Column, n_params: Column, is_static: Column) -> Column:
    """Whether the first number in the base is below the number of parameters (and the receiver, if there is one)."""
    index = F.regexp_extract(base_of(path), r"(\d+)", 1).try_cast("int")
    return F.coalesce(index < n_params + F.when(is_static, 0).otherwise(1), F.lit(False))


def is_used_in(used_at: Column, defined_at: Column, pos: Column) -> Column:
    return F.coalesce(used_at == pos, F.lit(False)) | F.coalesce(defined_at == pos, F.lit(False))


def is_empty(path: Column) -> Column:
    """Empty paths, and those of one empty element, are not kept in sets."""
    return (F.size(path) == 0) | ((F.size(path) == 1) & (base_of(path) == ""))


def set_add(paths: Column, path: Column) -> Column:
    """A set of paths (array of arrays) with one more, unless that is empty."""
    return F.when(is_empty(path), paths).otherwise(F.array_union(paths, F.array(path)))


def set_subtract(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def is_primitive(type_: Column) -> Column:
    """Whether a type, or the element type of an array, is primitive."""
    return F.regexp_replace(type_, r"(\[\])+$", "").isin(*PRIMITIVES)


def is_integer(text: Column) -> Column:
    return text.rlike(r"^[+-]?[0-9]+$") & text.try_cast("int").isNotNull()


def first_int(text: Column) -> Column:
    """The first number in a text, null if none."""
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("int")
