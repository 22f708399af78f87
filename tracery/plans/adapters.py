"""The driver's tables as traces: events are executed statements, parts are statement texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METHODS = ("click", "error", "purchase", "signup", "view")
KINDS = ("invoke", "if", "goto", "return", "throw", "assign")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def method_index(method: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in METHODS]), method) - 1


def events_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: pos, user_id, thread_id, method, k and what follows from them."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pos"), "user_id", (F.col("user_id") % 8).alias("thread_id"), F.col("event_type").alias("method"), k.alias("k"), "value"
    )
    kind = F.get(F.array(*[F.lit(x) for x in KINDS]), F.least(F.col("k") % 7, F.lit(5)))
    called = F.get(F.array(*[F.lit(m) for m in METHODS]), F.col("k") % 5)
    return rows.select(
        "*", kind.alias("kind"), F.concat("method", F.lit("#"), "k").alias("instr"), F.concat(F.lit("v"), F.col("k") % 10).alias("base"),
        F.col("method").isin("signup", "purchase").alias("is_def"), F.when(kind == "invoke", called).alias("called_sig"), (F.col("value") >= 30).alias("has_static"),
        (method_index(F.col("method")) * 100 + F.col("k")).cast("bigint").alias("unit_id"),
    )


#: The same rows in DuckDB, as the head of a WITH clause.
EVENTS_SQL = """
e0 AS (SELECT event_id AS pos, user_id, user_id % 8 AS thread_id, event_type AS method, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k, value FROM events),
t AS (SELECT *, ['invoke','if','goto','return','throw','assign'][least(k % 7, 5) + 1] AS kind, method || '#' || k AS instr, 'v' || (k % 10) AS base,
  method IN ('signup','purchase') AS is_def, CASE WHEN k % 7 = 0 THEN ['click','error','purchase','signup','view'][k % 5 + 1] END AS called_sig, value >= 30 AS has_static,
  CAST((list_position(['click','error','purchase','signup','view'], method) - 1) * 100 + k AS BIGINT) AS unit_id FROM e0)
"""
