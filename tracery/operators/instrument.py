"""Where probes go, so that a trace of blocks can be expanded again; and implicit thread calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sub-signature of a call, what it implicitly runs, how, and whether the receiver is the first argument.
CALL_PATTERNS = [
    ("void start()", "void run()", "THREAD", False),
    ("void execute(java.lang.Runnable)", "void run()", "EXECUTOR", True),
    ("boolean post(java.lang.Runnable)", "void run()", "EXECUTOR", True),
    ("boolean postAtFrontOfQueue(java.lang.Runnable)", "void run()", "EXECUTOR", True),
    ("boolean postAtTime(java.lang.Runnable,long)", "void run()", "EXECUTOR", True),
    ("boolean postAtTime(java.lang.Runnable,java.lang.Object,long)", "void run()", "EXECUTOR", True),
    ("boolean postDelayed(java.lang.Runnable,long)", "void run()", "EXECUTOR", True),
    ("void runOnUiThread(java.lang.Runnable)", "void run()", "EXECUTOR", True),
    ("boolean sendEmptyMessage(int)", "void handleMessage(android.os.Message)", "HANDLER", False),
    ("boolean sendEmptyMessageAtTime(int,long)", "void handleMessage(android.os.Message)", "HANDLER", False),
    ("boolean sendEmptyMessageDelayed(int,long)", "void handleMessage(android.os.Message)", "HANDLER", False),
    ("boolean sendMessage(android.os.Message)", "void handleMessage(android.os.Message)", "HANDLER", False),
    ("boolean sendMessageAtFrontOfQueue(android.os.Message)", "void handleMessage(android.os.Message)", "HANDLER", False),
    ("boolean sendMessageAtTime(android.os.Message,long)", "void handleMessage(android.os.Message)", "HANDLER", False),
    ("boolean sendMessageDelayed(android.os.Message,long)", "void handleMessage(android.os.Message)", "HANDLER", False),
    ("android.os.AsyncTask execute(java.lang.Object[])", "java.lang.Object doInBackground(java.lang.Object[])", "ASYNCTASK", False),
]
#: Argument types of the privileged static call, which runs its first argument.
PRIVILEGED = [
    "java.security.PrivilegedAction",
    "java.security.PrivilegedExceptionAction",
    "java.security.PrivilegedAction,java.security.AccessControlContext",
    "java.security.PrivilegedExceptionAction,java.security.AccessControlContext",
]


def probes(units: DataFrame, jumps: DataFrame, field_tracking: bool = False) -> DataFrame:
    """(method, unit_id): the units that get a probe.

    ``units`` has method, unit_id, ord, kind, has_invoke, in_library (of the callee's
    class) and has_field_ref; ``jumps`` (unit_id, target).  Probes go to a method's
    first unit that is no identity; to both ways of an ``if``; to the target of a
    ``goto`` and to what stands after it (an identity there is skipped); to a call of
    no library and the unit after it; to returns and throws; and, with
    ``field_tracking``, to assignments that touch a field.
    """
    order = Window.partitionBy("method").orderBy("ord")
    u = units.withColumns({"next": F.lead("unit_id").over(order), "next_kind": F.lead("kind").over(order), "next2": F.lead("unit_id", 2).over(order)})

    def put(rows: DataFrame, column: str) -> DataFrame:
        return rows.select("method", F.col(column).alias("unit_id"))

    first = units.where("kind <> 'identity'").groupBy("method").agg(F.min_by("unit_id", "ord").alias("unit_id"))
    branches = u.where("kind = 'if'")
    gotos = u.where("kind = 'goto'").withColumn("next", F.when(F.col("next_kind") == "identity", F.col("next2")).otherwise(F.col("next")))
    targets = units.where("kind in ('if', 'goto')").join(jumps, "unit_id")
    calls = u.where("has_invoke and not in_library and kind in ('invoke', 'assign')")
    ends = units.where("kind in ('return', 'return_void', 'throw')")
    parts = [put(branches, "next"), put(gotos, "next"), put(targets, "target"), put(calls, "unit_id"), put(calls, "next"), put(ends, "unit_id")]
    if field_tracking:
        parts.append(put(units.where("kind = 'assign' and has_field_ref"), "unit_id"))
    out = first.select("method", "unit_id")
    for part in parts:
        out = out.union(part)
    return out.where("unit_id is not null").distinct()


def flush_points(units: DataFrame, last_methods: list[str]) -> DataFrame:
    """(method, unit_id): the first unit, no identity, of the methods that end the program; the buffer is flushed there."""
    rows = units.where(F.col("method_name").isin(*last_methods) & (F.col("kind") != "identity"))
    return rows.groupBy("method").agg(F.min_by("unit_id", "ord").alias("unit_id"))


def probe_ids(placed: DataFrame) -> DataFrame:
    """Probes with their number within the method; (method, number) names a probe."""
    return placed.withColumn("probe", F.row_number().over(Window.partitionBy("method").orderBy("unit_id")) - 1)


def payload(probe: Column, thread: Column, field: Column | None = None) -> Column:
    """What a probe writes."""
    return F.concat_ws(":", probe.cast("string"), thread.cast("string"), *([] if field is None else [F.when(field != 0, field.cast("string"))]))


def package_filter(text: Column) -> Column:
    """Packages of a filter list."""
    return F.split(text, "-")


def implicit_calls(sites: DataFrame) -> DataFrame:
    """(unit_id, method, receiver, target_subsig, kind) of calls that start a method elsewhere.

    ``sites`` has unit_id, method, called_subsig, base (null if static), called_class,
    first_arg (the local given first, null if none).
    """
    spark = sites.sparkSession
    rows = [(*p, None) for p in CALL_PATTERNS]
    rows += [(f"java.lang.Object doPrivileged({a})", "java.lang.Object run()", "PRIVILEGED", True, "java.security.AccessController") for a in PRIVILEGED]
    table = spark.createDataFrame(rows, "called_subsig string, target_subsig string, kind string, by_arg boolean, only_class string")
    hit = sites.join(F.broadcast(table), "called_subsig")  # the patterns above, 20 rows
    static = F.col("only_class").isNotNull()
    hit = hit.where((static & F.col("base").isNull() & (F.col("called_class") == F.col("only_class"))) | (~static & F.col("base").isNotNull()))
    receiver = F.when(F.col("by_arg"), F.col("first_arg")).otherwise(F.col("base"))
    return hit.select("unit_id", "method", receiver.alias("receiver"), "target_subsig", "kind").where("receiver is not null")


def call_samples(calls: DataFrame, location: str = "location") -> DataFrame:
    """(location, n): how often each location was logged."""
    return calls.groupBy(location).agg(F.count("*").alias("n"))
