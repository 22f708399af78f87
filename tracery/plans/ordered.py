"""Windows over one long order, without sorting it in one task.

A trace is ordered by position.  A plain window over all of it would run in one task,
so the order is cut into buckets of positions: each bucket has its own window, and
what a bucket hands on to the next is one row per bucket.  The table of those rows is
the only thing that is scanned as a whole, and it is ``size`` times shorter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE = 1 << 17
_B = "_bucket"


def _joined(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be null."""
    right = carry.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in carry.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return df.join(right, on, "left").drop(*[f"_r_{k}" for k in keys])


def fits(df: DataFrame, by: Sequence[str], rows: int = SIZE) -> bool:
    """Whether no key has more than ``rows`` rows."""
    return df.groupBy(*by).count().where(F.col("count") > rows).isEmpty()


def last_before(df: DataFrame, order: str, values: dict[str, Column], by: Sequence[str] = (), size: int | None = SIZE, forward: bool = False) -> DataFrame:
    """Add, for each name, the last non-null value of its column in the rows before (``forward``: the first in the rows after).

    ``order`` is a whole-number column without repeats within ``by``; null keys form a
    group.  Rows without such a row get null.  ``size`` is None where each key fits one
    window (:func:`fits`), so that nothing is handed on.
    """
    if size is None:
        seq = F.col(order).desc() if forward else F.col(order).asc()
        whole = Window.partitionBy(*by).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({k: F.last(v, True).over(whole) for k, v in values.items()})
    df = df.withColumns({_B: F.floor(F.col(order) / size), **{f"_v_{k}": v for k, v in values.items()}})
    seq = F.col(order).desc() if forward else F.col(order).asc()
    bucket_seq = F.col(_B).desc() if forward else F.col(_B).asc()
    inner = Window.partitionBy(*by, _B).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    pick = F.min_by if forward else F.max_by
    tails = df.groupBy(*by, _B).agg(*[pick(f"_v_{k}", F.when(F.col(f"_v_{k}").isNotNull(), F.col(order))).alias(f"_t_{k}") for k in values])
    outer = Window.partitionBy(*by).orderBy(bucket_seq).rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*by, _B, *[F.last(f"_t_{k}", True).over(outer).alias(f"_c_{k}") for k in values])
    near = df.withColumns({f"_n_{k}": F.last(f"_v_{k}", True).over(inner) for k in values})
    out = _joined(near, carry, [*by, _B])
    out = out.withColumns({k: F.coalesce(f"_n_{k}", f"_c_{k}") for k in values})
    return out.drop(_B, *[f"_{x}_{k}" for k in values for x in "vnc"])


def previous(df: DataFrame, order: str, columns: dict[str, str], by: Sequence[str] = (), size: int = SIZE, forward: bool = False) -> DataFrame:
    """Add the columns of the row before (``forward``: after), under the given new names; null where there is none."""
    names = list(columns)
    out = last_before(df, order, {"_prev": F.struct(*[F.col(columns[n]).alias(n) for n in names])}, by, size, forward)
    return out.withColumns({n: F.col(f"_prev.{n}") for n in names}).drop("_prev")


def _running(df: DataFrame, order: str, values: dict[str, Column], by: Sequence[str], size: int, over: Callable[[str], Column], both: Callable[[Column, Column], Column]) -> DataFrame:
    df = df.withColumns({_B: F.floor(F.col(order) / size), **{f"_v_{k}": v for k, v in values.items()}})
    inner = Window.partitionBy(*by, _B).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    each = df.groupBy(*by, _B).agg(*[over(f"_v_{k}").alias(f"_t_{k}") for k in values])
    outer = Window.partitionBy(*by).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carry = each.select(*by, _B, *[over(f"_t_{k}").over(outer).alias(f"_c_{k}") for k in values])
    near = df.withColumns({f"_n_{k}": over(f"_v_{k}").over(inner) for k in values})
    out = _joined(near, carry, [*by, _B])
    return out.withColumns({k: both(F.col(f"_n_{k}"), F.col(f"_c_{k}")) for k in values}).drop(_B, *[f"_{x}_{k}" for k in values for x in "vnc"])


def running_total(df: DataFrame, order: str, values: dict[str, Column], by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """Add running sums, each including its own row, along the order."""
    return _running(df, order, values, by, size, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def running_max(df: DataFrame, order: str, values: dict[str, Column], by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """Add running maxima, each including its own row, along the order; null before the first value."""
    return _running(df, order, values, by, size, F.max, F.greatest)


def numbered(df: DataFrame, name: str, order: Sequence[str], size: int = SIZE) -> DataFrame:
    """Number the rows from 0 along the order given by several columns, the first a whole number."""
    lead = order[0]
    df = df.withColumn(_B, F.floor(F.col(lead) / size))
    counts = df.groupBy(_B).agg(F.count("*").alias("_n"))
    before = Window.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_B, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c"))
    own = F.row_number().over(Window.partitionBy(_B).orderBy(*order)) - 1
    return df.withColumn("_own", own).join(offsets, _B).withColumn(name, F.col("_own") + F.col("_c")).drop("_own", "_c", _B)
