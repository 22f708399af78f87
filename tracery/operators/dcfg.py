"""The dynamic control-flow graph of a trace: one predecessor at most for each row.

``stmts`` has (pos, method, thread_id) and, as needed, kind, subsig, class, name,
is_app, falls_through, called_sig, called_subsig, called_class.  Edges are (src, dst,
type) with type FLOW_EDGE or CALL_EDGE.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracery.plans.ordered import SIZE, last_before, numbered, previous, running_max, running_total
from tracery.plans.scratch import written

FLOW, CALL = "FLOW_EDGE", "CALL_EDGE"
LOOK_BACK = 101
#: The prefix of the support library's classes, the signatures of the text of an object and of the calls that run it.
LIBRARY = "android.support."
TO_STRING = "java.lang.String toString()"
PRINTERS = (
    "<java.io.PrintStream: void println(java.lang.Object)>",
    "<java.lang.StringBuilder: java.lang.StringBuilder append(java.lang.Object)>",
)


def is_library(class_: Column) -> Column:
    return class_.startswith(LIBRARY)


def first_in_method(stmts: DataFrame, size: int = SIZE) -> DataFrame:
    """Rows with ``is_first``: whether the row before belongs to another method."""
    return previous(stmts, "pos", {"_m": "method"}, size=size).withColumn("is_first", ~F.col("_m").eqNullSafe(F.col("method"))).drop("_m")


def flow_edges(stmts: DataFrame, size: int = SIZE) -> DataFrame:
    """FLOW edges between consecutive rows of one method, unless the first calls that method itself."""
    p = previous(stmts.select("pos", "method", "called_sig"), "pos", {"src": "pos", "_m": "method", "_c": "called_sig"}, size=size)
    kept = p.where((F.col("_m") == F.col("method")) & ~F.col("_c").eqNullSafe(F.col("method")))
    return kept.select("src", F.col("pos").alias("dst"), F.lit(FLOW).alias("type"))


def upsert_edges(edges: DataFrame, seq: str = "seq") -> DataFrame:
    """Edges (src, dst, type, seq) with one predecessor per row: the first source wins (of equal ``seq`` the earliest), with the type written last to it."""
    first = edges.groupBy("dst").agg(F.min_by("src", F.struct(seq, "src")).alias("src"))
    return edges.join(first, ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.max_by("type", F.struct(seq, "type")).alias("type"))


def clean_edges(edges: DataFrame, stmts: DataFrame, keep_thread_edges: bool = False) -> DataFrame:
    """Edges without CALL edges across threads, and without FLOW edges out of rows that neither fall through nor jump."""
    s = stmts.select(F.col("pos").alias("src"), F.col("thread_id").alias("st"), F.col("falls_through").alias("f"), F.col("kind").alias("k"))
    d = stmts.select(F.col("pos").alias("dst"), F.col("thread_id").alias("dt"))
    wrong_flow = (F.col("type") == FLOW) & ~F.col("f") & (F.col("k") != "goto")
    wrong_call = (F.col("type") == CALL) & (F.col("st") != F.col("dt"))
    wrong = wrong_flow if keep_thread_edges else wrong_flow | wrong_call
    return edges.join(s, "src").join(d, "dst").where(~wrong).select("src", "dst", "type")


def orphans(stmts: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows without a predecessor: entry points and possible callbacks."""
    return stmts.join(edges.select(F.col("dst").alias("pos")), "pos", "left_anti")


def static_links(stmts: DataFrame, size: int = SIZE) -> DataFrame:
    """(pos, previous, next) among the rows with ``has_static``; -1 where there is none."""
    rows = stmts.where("has_static").select("pos")
    both = previous(previous(rows, "pos", {"_p": "pos"}, size=size), "pos", {"_n": "pos"}, size=size, forward=True)
    return both.select("pos", F.coalesce("_p", F.lit(-1)).alias("previous"), F.coalesce("_n", F.lit(-1)).alias("next"))


def callback_edges(stmts: DataFrame, callbacks: DataFrame, setters: DataFrame, size: int = SIZE) -> DataFrame:
    """CALL edges to entries of callback methods from the last row before that registered the class.

    ``callbacks`` has (class, method), ``setters`` (unit_id, class).
    """
    entries = first_in_method(stmts, size).where("is_first").join(callbacks.select(F.col("class").alias("cb"), "method"), "method")
    set_rows = stmts.join(setters.select("unit_id", F.col("class").alias("cb")), "unit_id").select("pos", "cb", F.lit(True).alias("sets"))
    both = entries.select("pos", "cb", F.lit(False).alias("sets")).union(set_rows)
    # a row may both register and be an entry, so the order has two places per position
    both = both.withColumn("o", F.col("pos") * 2 + F.when(F.col("sets"), 0).otherwise(1))
    found = last_before(both, "o", {"src": F.when(F.col("sets"), F.col("pos"))}, ["cb"], size)
    found = found.where("not sets and src is not null")
    return found.groupBy(F.col("pos").alias("dst")).agg(F.max("src").alias("src")).select("src", "dst", F.lit(CALL).alias("type"))


def thread_edges(stmts: DataFrame, starters: DataFrame, thread_methods: DataFrame, size: int = SIZE) -> DataFrame:
    """CALL edges to entries of thread methods, from the last row up to the entry of every starting statement that has run by then.

    ``starters`` has (unit_id), ``thread_methods`` (method).  A statement that starts
    a thread only later has no edge to the entry.  There is an edge for each starting
    statement and entry behind its first row, and no other pair is made.
    """
    entries = first_in_method(stmts, size).where("is_first").join(thread_methods, "method", "left_semi").select("pos")
    starts = stmts.join(starters, "unit_id", "left_semi").select("pos", "unit_id")
    # at an entry, the statements that have run by then are those of the buckets before and of the rows before in its own
    bucket = F.floor(F.col("pos") / size).alias("b")
    begun = starts.groupBy("unit_id").agg(F.min("pos").alias("since"))
    met = begun.select("unit_id", "since", F.floor(F.col("since") / size).alias("f"))
    held = entries.select("pos", bucket)
    buckets = held.select("b").distinct()
    open_ = buckets.join(met, F.col("f") <= F.col("b")).select("b", "unit_id", "since")
    asks = held.join(open_, "b").where("since <= pos").select("pos", "unit_id", F.lit(False).alias("starts"))
    both = asks.union(starts.select("pos", "unit_id", F.lit(True).alias("starts")))
    both = both.withColumn("o", F.col("pos") * 2 + F.when(F.col("starts"), 0).otherwise(1))
    found = last_before(both, "o", {"src": F.when(F.col("starts"), F.col("pos"))}, ["unit_id"], size)
    return found.where("not starts").select("src", F.col("pos").alias("dst"), F.lit(CALL).alias("type"))


def look_back_edges(stmts: DataFrame, edges: DataFrame, size: int = SIZE, rows: int = LOOK_BACK) -> DataFrame:
    """CALL edges to orphan ``toString()`` heads from the last printing call within ``rows`` rows before."""
    free = orphans(stmts, edges).where((F.col("subsig") == TO_STRING) & ~is_library(F.col("class"))).select("pos")
    n = numbered(stmts.select("pos", "called_sig"), "rn", ["pos"], size)
    seen = last_before(n, "rn", {"p": F.when(F.col("called_sig").isin(*PRINTERS), F.struct("pos", "rn"))}, size=size)
    near = seen.where(F.col("rn") - F.col("p.rn") <= rows).select(F.col("p.pos").alias("src"), F.col("pos").alias("dst"))
    return near.join(free.withColumnRenamed("pos", "dst"), "dst", "left_semi").select("src", "dst", F.lit(CALL).alias("type"))


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a thread, last to first: orphans wait until a row comes that they can follow or be called from."""
    thread, waiting, by_method, by_subsig, by_class = None, {}, {}, {}, {}

    def drop(i: int) -> None:
        w = waiting.pop(i)
        for index, key in ((by_method, w["method"]), (by_subsig, w["subsig"]), (by_class, w["class"])):
            index.get(key, {}).pop(i, None)

    for batch in batches:
        src, dst, kind = [], [], []
        for r in batch.to_pylist():
            if r["thread_id"] != thread:
                thread, waiting, by_method, by_subsig, by_class = r["thread_id"], {}, {}, {}, {}
            j = r["pos"]
            same = by_method.get(r["method"])
            if same and not r["is_return"] and not r["has_flow"]:
                i = next(iter(same))  # the last row waits longest and chooses first
                src.append(j), dst.append(i), kind.append(FLOW)
                drop(i)
            if r["called_subsig"] is not None and not r["library"]:
                called = [i for i in by_subsig.get(r["called_subsig"], {}) if waiting[i]["is_app"]]
                called += [i for i in by_class.get(r["called_class"], {}) if waiting[i]["name"] == "<clinit>" and waiting[i]["subsig"] != r["called_subsig"]]
                for i in called:
                    src.append(j), dst.append(i), kind.append(CALL)
                    drop(i)
            if r["orphan"]:
                waiting[j] = r
                for index, key in ((by_method, r["method"]), (by_subsig, r["subsig"]), (by_class, r["class"])):
                    index.setdefault(key, {})[j] = None
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(kind, pa.string())], names=["src", "dst", "type"])


#: Fixed value: the name of static initialisers.
INIT = "<clinit>"


def _last_call(events: DataFrame, calls: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Events with ``call``, the later of what they have and the last call with their keys before them."""
    both = events.withColumn("made", F.lit(None).cast("bigint")).unionByName(calls.withColumnRenamed("pos", "made").withColumn("at", F.col("made") * 3 + 1), allowMissingColumns=True)
    seen = last_before(both, "at", {"seen": F.col("made")}, ["thread_id", *keys], size * 3).where("made is null")
    return seen.withColumn("call", F.greatest("call", "seen")).drop("made", "seen")


def _waiting(rows: DataFrame, inits: bool, size: int) -> DataFrame:
    """Edges to the orphans of methods whose rows agree on class, sub-signature, name and is_app; ``inits``: some are static initialisers.

    Seen from the end, the orphans of a method form a queue: a row that can be followed
    takes the one that has waited longest, a call of the method empties it.  So calls
    cut the rows of a method into segments; in each, the k-th row that finds somebody
    waiting takes the k-th orphan, and what is left belongs to the call.  A taker finds
    nobody whenever takers minus orphans so far reach a new maximum.
    """
    calls = rows.where("called_subsig is not null and not library")
    # one position holds, from its beginning: its orphan, its call, its taker
    roles = F.array(F.when(F.col("orphan"), F.lit(0)), F.when(~(F.col("is_return") | F.col("has_flow")), F.lit(2)))
    events = rows.withColumn("role", F.explode(F.filter(roles, lambda x: x.isNotNull())))
    events = events.select(
        "thread_id", "method", "subsig", "class", F.col("name").eqNullSafe(INIT).alias("init"), F.coalesce("is_app", F.lit(False)).alias("is_app"), "pos",
        (F.col("role") == 0).alias("waits"), (F.col("pos") * 3 + F.col("role")).alias("at"), F.lit(None).cast("bigint").alias("call"),
    )
    cut = _last_call(events, calls.select("thread_id", F.col("called_subsig").alias("subsig"), "pos"), ["subsig"], size)
    cut = cut.withColumn("call", F.when(F.col("is_app"), F.col("call")))
    if inits:
        own = rows.where(F.col("name") == INIT).select("class", "subsig").distinct()
        of_class = calls.select("thread_id", F.col("called_class").alias("class"), "called_subsig", "pos").join(own, "class").where("called_subsig <> subsig")
        first = _last_call(cut.where("init"), of_class.select("thread_id", "class", "subsig", "pos"), ["class", "subsig"], size)
        cut = cut.where("not init").unionByName(first)
    group = ["thread_id", "method", "call"]
    # each running value reads its input twice, so what it starts from is written
    cut = written(cut.select("thread_id", "method", F.coalesce("call", F.lit(-1)).alias("call"), "pos", "waits", (-F.col("at")).alias("back")), "segments")
    counted = running_total(cut, "back", {"waiters": F.col("waits").cast("long"), "takers": (~F.col("waits")).cast("long")}, group, size * 3)
    counted = running_max(counted, "back", {"idle": F.col("takers") - F.col("waiters")}, group, size * 3)
    counted = written(counted.select(*group, "pos", "waits", "waiters", (F.col("takers") - F.greatest("idle", F.lit(0))).alias("taken")), "waiting")
    takers = counted.where("not waits and taken > 0").groupBy(*group, F.col("taken").alias("waiters")).agg(F.max("pos").alias("src"))
    out = counted.where("waits").select(*group, "waiters", F.col("pos").alias("dst")).join(takers, [*group, "waiters"], "left")
    called = F.when(F.col("call") >= 0, F.col("call"))
    kind = F.when(F.col("src").isNotNull(), FLOW).otherwise(CALL).alias("type")
    return out.select(F.coalesce("src", called).alias("src"), "dst", kind).where("src is not null")


def link_orphans(stmts: DataFrame, edges: DataFrame, size: int = SIZE) -> DataFrame:
    """Edges that give orphans of each thread their predecessor.

    From the last row to the first, an orphan is linked to the nearest row before it
    that is of its method, no return, and has no FLOW successor yet (FLOW), or that
    calls its sub-signature (CALL), or, for a static initialiser, a method of its class
    (CALL).  Positions are not negative; rows without a thread or method are linked to
    nothing.  Long threads are cut into buckets of ``size`` positions.  Only methods
    whose rows disagree on class, sub-signature, name or is_app, which no program has,
    are streamed, thread by thread.
    """
    has_flow = edges.where(F.col("type") == FLOW).select(F.col("src").alias("pos")).distinct().withColumn("has_flow", F.lit(True))
    linked = edges.select(F.col("dst").alias("pos")).distinct().withColumn("linked", F.lit(True))
    rows = stmts.where("thread_id is not null and method is not null").join(has_flow, "pos", "left").join(linked, "pos", "left").select(
        "thread_id", F.col("pos").cast("bigint").alias("pos"), "method", "subsig", "class", "name", "is_app", "called_subsig", "called_class",
        is_library(F.col("class")).alias("library"), F.coalesce(F.col("kind").isin("return", "return_void"), F.lit(False)).alias("is_return"),
        F.coalesce("has_flow", F.lit(False)).alias("has_flow"), F.col("linked").isNull().alias("orphan"),
    )
    rows = written(rows.where("orphan or called_subsig is not null or not (is_return or has_flow)"), "linkable")
    shape = F.struct("subsig", "class", "name", "is_app")
    methods = rows.where("orphan or not (is_return or has_flow)").groupBy("method").agg(F.min(shape).alias("a"), F.max(shape).alias("b"))
    odd = methods.where("a <> b").select("method", F.lit(True).alias("odd"))
    some_odd, inits = methods.agg(F.max(F.expr("a <> b")), F.max((F.col("a.name") == INIT) | (F.col("b.name") == INIT))).first()
    if not some_odd:
        return _waiting(rows, bool(inits), size)
    marked = rows.join(odd, "method", "left").withColumn("odd", F.coalesce("odd", F.lit(False)))
    plain = marked.withColumns({"orphan": F.col("orphan") & ~F.col("odd"), "is_return": F.col("is_return") | F.col("odd")}).drop("odd")
    rest = marked.where("odd or called_subsig is not null").withColumns({"orphan": F.col("orphan") & F.col("odd"), "is_return": F.col("is_return") | ~F.col("odd")})
    ordered = rest.drop("odd").repartition("thread_id").sortWithinPartitions("thread_id", F.desc("pos"))
    return _waiting(plain, True, size).unionByName(ordered.mapInArrow(_link, "src long, dst long, type string"))


def build(stmts: DataFrame, registrations: DataFrame | None = None, keep_thread_edges: bool = False, size: int = SIZE) -> DataFrame:
    """The graph of a trace: flow, registration edges (src, dst, type), false edges removed, orphans linked, printing calls."""
    edges = flow_edges(stmts, size).withColumn("seq", F.lit(0))
    if registrations is not None:
        edges = edges.unionByName(registrations.select("src", "dst", "type", F.lit(1).alias("seq")))
    clean = written(clean_edges(upsert_edges(edges), stmts, keep_thread_edges), "clean")
    linked = written(clean.unionByName(link_orphans(stmts, clean, size)), "linked")
    return linked.unionByName(look_back_edges(stmts, linked, size))
