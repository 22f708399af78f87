"""The trace-lineage queries over the driver's tables, with their SQL oracles."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracery.functions import accesspath as ap
from tracery.functions import statements as st
from tracery.operators import control, dcfg, defuse, frames, framework, instrument, program_slice, resolve, scope, slicer
from tracery.plans.adapters import EVENTS_SQL, METHODS, events_trace, method_index, table
from tracery.plans.ordered import SIZE, fits, last_before, numbered, previous
from tracery.plans.scratch import scratch_dir, written
from tracery.sources import reports, rules, traces

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with the SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.replace("WITH_EVENTS", "WITH " + EVENTS_SQL)
        return f

    return keep


# ---------------------------------------------------------------- sources


@query("""WITH_EVENTS SELECT pos // 1024 AS line_no, CAST(pos % 1024 AS INT) AS rec_idx, CAST(k AS BIGINT) AS bb_id, thread_id,
  CASE WHEN kind = 'assign' THEN k + 1 ELSE -1 END AS field_id FROM t""")
def q_wire_roundtrip(spark, d):
    """Events written as compressed trace lines and read back."""
    rows = events_trace(spark, d).select("pos", F.col("k").alias("bb_id"), "thread_id", F.when(F.col("kind") == "assign", F.col("k") + 1).otherwise(0).alias("field_id"))
    return traces.records(traces.encode(rows))


@query("""WITH_EVENTS SELECT pos AS line_no, ' ' || method AS payload FROM (SELECT *, lag(method) OVER (ORDER BY pos) AS before FROM t) WHERE before IS DISTINCT FROM method""")
def q_consecutive_dedupe(spark, d):
    lines = events_trace(spark, d).select(F.col("pos").alias("line_no"), F.concat(F.lit("log SLICING: "), "method").alias("value"))
    return traces.marked_payloads(lines)


@query("""WITH_EVENTS, b AS (SELECT pos // 2 AS w, string_agg(method, ',' ORDER BY pos) AS s, count(*) AS n FROM t GROUP BY 1),
  kept AS (SELECT w FROM (SELECT *, lag(s) OVER (ORDER BY w) AS p FROM b) WHERE s IS DISTINCT FROM p OR n < 2)
  SELECT pos, method FROM t WHERE pos // 2 IN (SELECT w FROM kept)""")
def q_block_window_dedupe(spark, d):
    return traces.without_repeated_windows(events_trace(spark, d).select("pos", "method"), "pos", ["method"], 2)


@query("""WITH_EVENTS SELECT 2 * pos + s AS pos, unit_id AS bb_id, CAST(s AS INT) AS stmt_idx, method, instr || CASE WHEN s = 1 THEN '+' ELSE '' END AS instr, CAST(k + 1 AS BIGINT) AS src_line, thread_id
  FROM t, (SELECT unnest([0, 1]) AS s)""")
def q_static_dict_join(spark, d):
    """Events expanded by a dictionary of blocks of two statements each."""
    t = events_trace(spark, d)
    blocks = t.select("method", "unit_id", "k", "instr").distinct()
    parts = F.array("instr", (F.col("k") + 1).cast("string"), F.concat("instr", F.lit("+")), F.lit("0"))
    inner = F.map_from_entries(F.collect_list(F.struct(F.col("unit_id").cast("string"), parts)))
    # a method has as many blocks as its code
    docs = blocks.groupBy("method").agg(inner.alias("m")).select(F.to_json(F.create_map("method", "m")).alias("value"))
    recs = t.select(F.col("pos").alias("line_no"), F.lit(0).alias("rec_idx"), F.col("unit_id").alias("bb_id"), "thread_id", F.lit(-1).alias("field_id"))
    out = traces.expand(recs, written(traces.block_dictionary(docs), "blocks"))
    return out.select("pos", "bb_id", "stmt_idx", "method", "instr", F.col("bb_src_line").alias("src_line"), "thread_id")


# ---------------------------------------------------------------- resolution


@query("""WITH_EVENTS, u AS (SELECT DISTINCT unit_id, method, k, method || '#' || (k % 20) AS s FROM t),
  m AS (SELECT t.pos, u.unit_id, row_number() OVER (PARTITION BY t.pos ORDER BY abs(t.user_id % 100 - u.k), u.k) AS r FROM t JOIN u ON u.method = t.method AND u.s = t.method || '#' || (t.k % 20))
  SELECT pos, unit_id FROM m WHERE r = 1""")
def q_exact_match_closest(spark, d):
    t = events_trace(spark, d)
    text = F.concat("method", F.lit("#"), F.col("k") % 20)
    units = t.select("unit_id", "method", F.col("k").alias("ord"), text.alias("unit_str"), F.col("k").alias("src_line"), F.lit("assign").alias("kind")).distinct()
    rows = t.select("pos", "method", text.alias("instr"), (F.col("user_id") % 100).alias("src_line"))
    return resolve.exact_matches(rows, resolve.statement_index(units))


@query("""WITH p AS (SELECT p_partkey AS pos, p_brand AS method, p_name || 's' AS b, p_size AS l FROM part),
  u AS (SELECT p_partkey AS id, p_brand AS method, p_name AS a, p_size AS l FROM part),
  pairs AS (SELECT pos, a, b, least(length(a), length(b)) // 2 AS lim, id, abs(p.l - u.l) AS gap FROM p JOIN u USING (method) WHERE left(a, 1) = left(b, 1)),
  texts AS (SELECT pos, a, b, lim, min(id) AS first, arg_min(id, CAST(gap AS BIGINT) * 1000000000 + id) AS unit, min(gap) AS gap FROM pairs GROUP BY pos, a, b, lim),
  dist AS (SELECT pos, first, CASE WHEN levenshtein(a, b) > lim THEN lim ELSE levenshtein(a, b) END AS d, gap, unit FROM texts)
  SELECT pos, list_reduce(list({'d': d, 'gap': gap, 'unit': unit} ORDER BY first), lambda s, x: CASE WHEN x.d <= s.d AND x.gap < s.gap THEN x ELSE s END).unit AS unit_id FROM dist GROUP BY pos""")
def q_fuzzy_levenshtein(spark, d):
    """Every part's name, changed, against the names of its brand's parts."""
    p = table(spark, d, "part")
    units = p.select(F.col("p_partkey").alias("unit_id"), F.col("p_brand").alias("method"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("unit_str"), F.col("p_size").alias("src_line"), F.lit("assign").alias("kind"))
    rows = p.select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("method"), F.concat("p_name", F.lit("s")).alias("instr"), F.col("p_size").alias("src_line"))
    return resolve.nearest_matches(rows, resolve.statement_index(units))


# ---------------------------------------------------------------- graph


def _stmts(spark, d) -> DataFrame:
    t = events_trace(spark, d)
    return t.select("*", (~F.col("kind").isin("goto", "return", "throw")).alias("falls_through"))


FLOW_SQL = """f AS (SELECT p AS src, pos AS dst, 'FLOW_EDGE' AS type FROM (SELECT pos, method, lag(pos) OVER w AS p, lag(method) OVER w AS pm, lag(called_sig) OVER w AS pc FROM t WINDOW w AS (ORDER BY pos))
  WHERE pm = method AND pc IS DISTINCT FROM method)"""


@query("WITH_EVENTS SELECT pos, method, lag(method) OVER (ORDER BY pos) IS DISTINCT FROM method AS is_first FROM t")
def q_first_in_method(spark, d):
    return dcfg.first_in_method(events_trace(spark, d).select("pos", "method"))


@query(f"WITH_EVENTS, {FLOW_SQL} SELECT src, dst, type FROM f")
def q_flow_edges(spark, d):
    return dcfg.flow_edges(events_trace(spark, d))


CALLS_SQL = """c AS (SELECT p AS src, pos AS dst, 'CALL_EDGE' AS type FROM (SELECT pos, method, lag(pos) OVER w AS p, lag(called_sig) OVER w AS pc FROM t WINDOW w AS (ORDER BY pos)) WHERE pc = method)"""


def _direct_calls(t: DataFrame) -> DataFrame:
    p = previous(t.select("pos", "method", "called_sig"), "pos", {"src": "pos", "_c": "called_sig"})
    return p.where(F.col("_c") == F.col("method")).select("src", F.col("pos").alias("dst"), F.lit(dcfg.CALL).alias("type"))


@query(f"""WITH_EVENTS, {FLOW_SQL}, {CALLS_SQL}, e AS (SELECT * FROM f UNION ALL SELECT * FROM c)
  SELECT e.src, e.dst, e.type FROM e JOIN t s ON s.pos = e.src JOIN t d ON d.pos = e.dst
  WHERE NOT (e.type = 'FLOW_EDGE' AND s.kind IN ('return', 'throw')) AND NOT (e.type = 'CALL_EDGE' AND s.thread_id <> d.thread_id)""")
def q_false_edge_clean(spark, d):
    t = _stmts(spark, d)
    return dcfg.clean_edges(dcfg.flow_edges(t).union(_direct_calls(t)), t)


@query(f"WITH_EVENTS, {FLOW_SQL} SELECT pos, method FROM t WHERE pos NOT IN (SELECT dst FROM f)")
def q_orphans(spark, d):
    t = events_trace(spark, d)
    return dcfg.orphans(t.select("pos", "method"), dcfg.flow_edges(t))


@query(f"""WITH_EVENTS, {FLOW_SQL}, {CALLS_SQL}, e AS (SELECT *, 0 AS seq FROM f UNION ALL SELECT *, 1 FROM c), one AS (SELECT dst, arg_min(src, seq) AS src FROM e GROUP BY dst)
  SELECT e.src, e.dst, arg_max(e.type, e.seq) AS type FROM e JOIN one USING (src, dst) GROUP BY e.src, e.dst""")
def q_edge_upsert(spark, d):
    t = events_trace(spark, d)
    edges = dcfg.flow_edges(t).withColumn("seq", F.lit(0)).union(_direct_calls(t).withColumn("seq", F.lit(1)))
    return dcfg.upsert_edges(edges)


def _linkable(spark, d) -> DataFrame:
    t = _stmts(spark, d)
    return t.select(
        "pos", "thread_id", "method", F.col("method").alias("subsig"), F.col("method").alias("class"), F.col("method").alias("name"), F.lit(True).alias("is_app"),
        F.col("called_sig").alias("called_subsig"), F.col("called_sig").alias("called_class"), "called_sig", "kind", "falls_through",
    )


CLEAN_SQL = ", e AS (SELECT f.* FROM f JOIN t s ON s.pos = f.src WHERE s.kind NOT IN ('return', 'throw'))"
LINKS_SQL = """,
  ev AS (SELECT thread_id, method, pos, 3 * pos AS o, 1 AS a, 0 AS b FROM t WHERE pos NOT IN (SELECT dst FROM e) UNION ALL SELECT thread_id, method, pos, 3 * pos + 2, 0, 1 FROM t WHERE kind <> 'return' AND pos NOT IN (SELECT src FROM e WHERE type = 'FLOW_EDGE')),
  cl AS (SELECT thread_id, called_sig AS method, pos, 3 * pos + 1 AS o FROM t WHERE called_sig IS NOT NULL),
  cut AS (SELECT ev.*, coalesce(cl.pos, -1) AS call FROM ev ASOF LEFT JOIN cl ON ev.thread_id = cl.thread_id AND ev.method = cl.method AND ev.o >= cl.o),
  su AS (SELECT *, sum(a) OVER w AS adds, sum(b) OVER w AS takes FROM cut WINDOW w AS (PARTITION BY thread_id, method, call ORDER BY o DESC)),
  q AS (SELECT *, takes - greatest(0, max(takes - adds) OVER (PARTITION BY thread_id, method, call ORDER BY o DESC)) AS taken FROM su),
  g AS (SELECT thread_id, method, call, taken AS adds, max(pos) AS src FROM q WHERE b = 1 AND taken > 0 GROUP BY ALL),
  l AS (SELECT coalesce(g.src, q.call) AS src, q.pos AS dst, CASE WHEN g.src IS NULL THEN 'CALL_EDGE' ELSE 'FLOW_EDGE' END AS type FROM q LEFT JOIN g USING (thread_id, method, call, adds) WHERE q.a = 1 AND (g.src IS NOT NULL OR q.call >= 0))"""


@query(f"WITH_EVENTS, {FLOW_SQL}{CLEAN_SQL}{LINKS_SQL} SELECT src, dst, type FROM l")
def q_stack_reconstruct(spark, d):
    """Predecessors of the rows that no flow edge leads to, thread by thread."""
    t = _linkable(spark, d)
    return dcfg.link_orphans(t, written(dcfg.clean_edges(dcfg.flow_edges(t), t), "flow"))


@query(f"WITH_EVENTS, {FLOW_SQL}{CLEAN_SQL}{LINKS_SQL} SELECT src, dst, type FROM e UNION ALL SELECT src, dst, type FROM l")
def q_dynamic_graph(spark, d):
    """The whole graph of the event trace."""
    return dcfg.build(_linkable(spark, d))


@query(f"""WITH_EVENTS, {FLOW_SQL}, en AS (SELECT pos, method FROM (SELECT pos, method, lag(method) OVER (ORDER BY pos) AS pm FROM t) WHERE pm IS DISTINCT FROM method),
  th AS (SELECT max(s.pos) AS src, en.pos AS dst FROM en JOIN t s ON s.instr IN ('click#1', 'view#2') AND s.pos <= en.pos WHERE en.method = 'signup' GROUP BY s.unit_id, en.pos),
  cb AS (SELECT max(s.pos) AS src, en.pos AS dst FROM en JOIN t s ON s.kind = 'if' AND s.base IN ('v1', 'v2') AND s.pos <= en.pos WHERE en.method = 'purchase' GROUP BY en.pos),
  al AS (SELECT src, dst, type, 0 AS seq FROM f UNION ALL SELECT src, dst, 'CALL_EDGE', 1 FROM cb UNION ALL SELECT src, dst, 'CALL_EDGE', 1 FROM th),
  o AS (SELECT dst, src, type FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY seq, src) AS place FROM al) WHERE place = 1),
  e AS (SELECT o.src, o.dst, o.type FROM o JOIN t s ON s.pos = o.src WHERE o.type <> 'FLOW_EDGE' OR s.kind NOT IN ('return', 'throw')){LINKS_SQL} SELECT src, dst, type FROM e UNION ALL SELECT src, dst, type FROM l""")
def q_registered_graph(spark, d):
    """The whole graph with calls from registrations: of purchase as a callback, of signup as a method of threads."""
    t = events_trace(spark, d)
    callbacks = spark.createDataFrame([("v1", "purchase"), ("v2", "purchase")], "class string, method string")
    calls = dcfg.callback_edges(t, callbacks, t.where("kind = 'if'").select("unit_id", F.col("base").alias("class")).distinct())
    starters = t.where(F.col("instr").isin("click#1", "view#2")).select("unit_id").distinct()
    threads = dcfg.thread_edges(t, starters, spark.createDataFrame([("signup",)], "method string"))
    return dcfg.build(_linkable(spark, d), written(calls.unionByName(threads), "registrations"), keep_thread_edges=True)


@query(f"WITH_EVENTS, {FLOW_SQL} SELECT pos, max(CASE WHEN pos NOT IN (SELECT dst FROM f) THEN pos END) OVER (ORDER BY pos) AS frame_id FROM t")
def q_frames(spark, d):
    t = events_trace(spark, d)
    return frames.frame_ids(t, dcfg.flow_edges(t))


@query(f"""WITH_EVENTS, {FLOW_SQL}, i AS (SELECT pos, method, thread_id, max(CASE WHEN pos NOT IN (SELECT dst FROM f) THEN pos END) OVER (ORDER BY pos) AS frame_id FROM t),
  b AS (SELECT frame_id, arg_min(method, pos) AS method, arg_min(thread_id, pos) AS thread_id, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_rows FROM i GROUP BY frame_id),
  calls AS (SELECT pos AS cpos, thread_id, called_sig FROM t WHERE called_sig IS NOT NULL)
  SELECT b.frame_id, b.method, b.thread_id, b.first_pos, b.last_pos, b.n_rows, coalesce(calls.cpos, b.first_pos) AS caller_pos
  FROM b ASOF LEFT JOIN calls ON b.thread_id = calls.thread_id AND b.method = calls.called_sig AND b.first_pos > calls.cpos""")
def q_frame_bounds(spark, d):
    """Frames with the last call of their method before them, in their thread."""
    t = events_trace(spark, d)
    flow = written(dcfg.flow_edges(t), "flow")
    heads = dcfg.orphans(t.select("pos", "thread_id", "method"), flow).select(F.col("pos"), "thread_id", F.col("method").alias("key"), F.lit(None).cast("bigint").alias("call"))
    calls = t.where("called_sig is not null").select("pos", "thread_id", F.col("called_sig").alias("key"), F.col("pos").alias("call"))
    both = heads.union(calls).withColumn("o", F.col("pos") * 2 + F.col("call").isNotNull().cast("int"))
    asof = last_before(both, "o", {"src": F.col("call")}, ["thread_id", "key"]).where("call is null and src is not null")
    edges = flow.union(asof.select("src", F.col("pos").alias("dst"), F.lit(dcfg.CALL)))
    return frames.frame_table(t, frames.frame_ids(t, flow), edges)


@query("""WITH_EVENTS SELECT pos, coalesce(lag(pos) OVER (ORDER BY pos), -1) AS previous, coalesce(lead(pos) OVER (ORDER BY pos), -1) AS next FROM t WHERE has_static""")
def q_static_field_links(spark, d):
    return dcfg.static_links(events_trace(spark, d))


@query("""WITH_EVENTS, s AS (SELECT pos, method, max(CASE WHEN method = 'error' THEN pos END) OVER (ORDER BY pos ROWS BETWEEN 101 PRECEDING AND 1 PRECEDING) AS src FROM t)
  SELECT src, pos AS dst, 'CALL_EDGE' AS type FROM s WHERE method = 'signup' AND src IS NOT NULL""")
def q_lookback_101(spark, d):
    """Signups that follow an error within 101 rows, as calls out of a printing library."""
    t = events_trace(spark, d).select(
        "pos", F.when(F.col("method") == "signup", dcfg.TO_STRING).otherwise(F.col("method")).alias("subsig"), F.lit("app.Main").alias("class"),
        F.when(F.col("method") == "error", dcfg.PRINTERS[0]).alias("called_sig"),
    )
    none = spark.createDataFrame([], "src bigint, dst bigint, type string")
    return dcfg.look_back_edges(t, none)


@query("""WITH_EVENTS, f AS (SELECT pos, method, lag(method) OVER (ORDER BY pos) AS pm FROM t),
  s AS (SELECT pos, base FROM t WHERE kind = 'if'), cb AS (SELECT 'purchase' AS method, 'v' || unnest([1, 2]) AS base)
  SELECT max(s.pos) AS src, f.pos AS dst, 'CALL_EDGE' AS type FROM f JOIN cb USING (method) JOIN s ON s.base = cb.base AND s.pos <= f.pos
  WHERE f.pm IS DISTINCT FROM f.method GROUP BY f.pos""")
def q_callback_edges(spark, d):
    """Entries of purchase as callbacks of two classes, registered by the branches on their variable."""
    t = events_trace(spark, d)
    callbacks = spark.createDataFrame([("v1", "purchase"), ("v2", "purchase")], "class string, method string")
    setters = t.where("kind = 'if'").select("unit_id", F.col("base").alias("class")).distinct()
    return dcfg.callback_edges(t, callbacks, setters)


@query("""WITH_EVENTS, f AS (SELECT pos, method, lag(method) OVER (ORDER BY pos) AS pm FROM t)
  SELECT max(s.pos) AS src, f.pos AS dst, 'CALL_EDGE' AS type FROM f JOIN t s ON s.instr IN ('click#1', 'view#2') AND s.pos <= f.pos WHERE f.method = 'signup' AND f.pm IS DISTINCT FROM f.method GROUP BY s.unit_id, f.pos""")
def q_thread_edges(spark, d):
    t = events_trace(spark, d)
    starters = t.where(F.col("instr").isin("click#1", "view#2")).select("unit_id").distinct()
    return dcfg.thread_edges(t, starters, spark.createDataFrame([("signup",)], "method string"))


# ---------------------------------------------------------------- data dependence


@query("""WITH_EVENTS SELECT pos, thread_id, base, max(CASE WHEN is_def THEN pos END) OVER (PARTITION BY thread_id, base ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS def_pos FROM t""")
def q_reaching_def(spark, d):
    t = events_trace(spark, d).select("pos", "thread_id", "base", "is_def")
    return defuse.reaching_definition(t, ["thread_id", "base"], F.col("is_def")).select("pos", "thread_id", "base", "def_pos")


@query("""WITH_EVENTS, s AS (SELECT *, sum(CASE WHEN is_def THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id, base ORDER BY pos) AS seg FROM t)
  SELECT u.pos AS use_pos, d.pos AS def_pos FROM s u JOIN s d ON u.thread_id = d.thread_id AND u.base = d.base AND u.seg = d.seg AND d.pos < u.pos WHERE NOT u.is_def AND (d.is_def OR d.method = 'view')""")
def q_reaching_def_all(spark, d):
    t = events_trace(spark, d).select("pos", "thread_id", "base", "is_def", "method")
    return defuse.reaching_definitions(t, ["thread_id", "base"], F.col("is_def"), F.col("method") == "view", ~F.col("is_def"))


@query("""WITH_EVENTS SELECT pos, coalesce(b, CASE WHEN f - pos <= 5000 THEN f END) AS def_pos FROM (SELECT pos,
  max(CASE WHEN is_def AND kind = 'goto' THEN pos END) OVER (PARTITION BY base ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  min(CASE WHEN is_def AND kind = 'goto' AND method = 'signup' THEN pos END) OVER (PARTITION BY base ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f FROM t)""")
def q_asof_static_def(spark, d):
    t = events_trace(spark, d)
    writes = F.col("is_def") & (F.col("kind") == "goto")
    return defuse.static_definition(t, "base", writes, F.col("method") == "signup").select("pos", "def_pos")


@query("WITH_EVENTS SELECT pos, user_id, lag(pos) OVER (PARTITION BY user_id ORDER BY pos) AS before_pos FROM t")
def q_closest_predecessor(spark, d):
    return defuse.closest_before(events_trace(spark, d).select("pos", "user_id"), ["user_id"])


@query("""WITH_EVENTS, u AS (SELECT DISTINCT unit_id, kind, k, base FROM t)
  SELECT unit_id, CAST(o - 1 AS INT) AS ord, p AS path, st AS is_static FROM (SELECT unit_id, unnest(CASE WHEN kind = 'assign' AND k % 3 = 0 THEN ['C.f' || k] WHEN kind = 'assign' AND k % 3 = 1 THEN [base || '.f'] WHEN kind = 'goto' THEN [''] ELSE [base, 'w' || (k % 4)] END) AS p,
   generate_subscripts(CASE WHEN kind = 'assign' AND k % 3 = 0 THEN ['C.f' || k] WHEN kind = 'assign' AND k % 3 = 1 THEN [base || '.f'] WHEN kind = 'goto' THEN [''] ELSE [base, 'w' || (k % 4)] END, 1) AS o, kind = 'assign' AND k % 3 = 0 AS st FROM u)""")
def q_use_explode(spark, d):
    u = events_trace(spark, d).select("unit_id", "kind", "k", "base").distinct()
    right = F.when(F.col("k") % 3 == 0, "static_field").when(F.col("k") % 3 == 1, "field").otherwise("local")
    local = F.when(F.col("kind") == "goto", F.array().cast("array<string>")).otherwise(F.array("base", F.concat(F.lit("w"), F.col("k") % 4)))
    units = u.select("unit_id", "kind", right.alias("right"), F.lit("C").alias("right_class"), F.col("base").alias("right_base"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("f"), "k")).otherwise("f").alias("right_field"), local.alias("locals"))
    return defuse.use_paths(units).select("unit_id", "ord", ap.path_string(F.col("path")).alias("path"), "is_static")


# ---------------------------------------------------------------- access paths


def _paths(spark, d) -> DataFrame:
    text = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return table(spark, d, "part").select("p_partkey", F.split(text, " ").alias("path"), F.split("p_name", " ").alias("base"), F.split(F.concat_ws(" ", "p_type", "p_name"), " ").alias("other"))


PARTS_SQL = "p AS (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ') AS path, string_split(p_name, ' ') AS base, string_split(p_type || ' ' || p_name, ' ') AS other FROM part)"


@query(f"WITH {PARTS_SQL} SELECT p_partkey, path[1:len(base)] = base AS starts, len(base) < len(path) AND path[1:len(base)] = base AS prefix, other[1:len(base)] = base AS other_starts FROM p")
def q_ap_prefix(spark, d):
    path, base, other = F.col("path"), F.col("base"), F.col("other")
    return _paths(spark, d).select("p_partkey", ap.starts_with(path, base).alias("starts"), ap.is_prefix_of(base, path).alias("prefix"), ap.starts_with(other, base).alias("other_starts"))


@query(f"WITH {PARTS_SQL} SELECT p_partkey, array_to_string(path[len(base) + 1:], '.') AS rest, len(path) > len(base) AS has_rest, array_to_string(list_concat(['z'], path[2:]), '.') AS rebased, path[len(path)] AS last_field FROM p")
def q_ap_after(spark, d):
    path, base = F.col("path"), F.col("base")
    return _paths(spark, d).select("p_partkey", ap.path_string(ap.after(path, base)).alias("rest"), ap.has_after(path, base).alias("has_rest"), ap.path_string(ap.replace_base(path, F.lit("z"))).alias("rebased"), ap.last_field(path).alias("last_field"))


@query(f"WITH {PARTS_SQL} SELECT p_partkey, array_to_string(list_concat(path, path, path)[1:10], '.') AS cut, 3 * len(path) > 10 AS clipped FROM p")
def q_ap_clip(spark, d):
    long = F.concat("path", "path", "path")
    return _paths(spark, d).select("p_partkey", ap.path_string(ap.clip(long)).alias("cut"), ap.is_clipped(long).alias("clipped"))


@query(f"WITH {PARTS_SQL} SELECT p_partkey, array_to_string(list_concat(path, path, path)[1:10], '.') || CASE WHEN 3 * len(path) > 10 THEN '.*' ELSE '' END AS text FROM p")
def q_ap_pathstring(spark, d):
    made = _paths(spark, d).select("p_partkey", ap.make(F.concat("path", "path", "path"), F.concat("path", "path", "path")).alias("a"))
    return made.select("p_partkey", ap.path_string(F.col("a.path"), F.col("a.clipped")).alias("text"))


@query(f"WITH {PARTS_SQL} SELECT p_partkey, array_to_string(list_filter(list_distinct(path), lambda x: NOT list_contains(base, x)).list_sort(), '.') AS rest FROM p")
def q_alias_subtract(spark, d):
    single = lambda c: F.transform(c, lambda x: F.array(x))
    rest = ap.set_subtract(single(F.col("path")), single(F.col("base")))
    return _paths(spark, d).select("p_partkey", F.array_join(F.array_sort(F.flatten(rest)), ".").alias("rest"))


# ---------------------------------------------------------------- library rules


def _signatures(t: DataFrame) -> DataFrame:
    """A library method for each event type and number of arguments."""
    n = F.col("k") % 4
    args = F.array_join(F.slice(F.array(*[F.lit("java.lang.Object")] * 3), F.lit(1), n), ",")
    returns = F.when(F.col("method") == "view", "void").otherwise("java.lang.Object")
    return t.withColumn("method_sig", F.concat(F.lit("<lib.C: "), returns, F.lit(" "), "method", F.lit("("), args, F.lit(")>")))


SIG_SQL = """g AS (SELECT *, '<lib.C: ' || CASE WHEN method = 'view' THEN 'void' ELSE 'java.lang.Object' END || ' ' || method || '(' || ['', 'java.lang.Object', 'java.lang.Object,java.lang.Object', 'java.lang.Object,java.lang.Object,java.lang.Object'][k % 4 + 1] || ')>' AS method_sig FROM t),
  sig AS (SELECT DISTINCT method_sig, k % 4 AS n0, CASE method WHEN 'click' THEN 'Exclude' WHEN 'error' THEN 'Kill' WHEN 'signup' THEN 'Generate' ELSE 'Default' END AS kind, method = 'view' AS void FROM g),
  ar AS (SELECT *, CASE WHEN n0 = 0 AND kind <> 'Exclude' THEN 0 ELSE greatest(n0, 1) END AS n FROM sig),
  i AS (SELECT ar.*, x.i FROM ar JOIN (SELECT unnest([0, 1, 2]) AS i) x ON x.i < ar.n),
  r AS (SELECT method_sig, kind, 'INSTANCE' AS lt, NULL AS li, 'INSTANCE' AS rt, NULL AS ri FROM ar WHERE kind = 'Exclude' OR (kind = 'Default' AND void)
    UNION ALL SELECT method_sig, kind, 'RETURN', NULL, 'CLEAR', NULL FROM ar WHERE kind IN ('Exclude', 'Kill')
    UNION ALL SELECT method_sig, kind, 'INSTANCE', NULL, 'CLEAR', NULL FROM ar WHERE kind = 'Kill'
    UNION ALL SELECT method_sig, kind, 'RETURN', NULL, 'INSTANCE', NULL FROM ar WHERE kind IN ('Generate', 'Default')
    UNION ALL SELECT method_sig, kind, 'PARAM', i, 'PARAM', i FROM i WHERE kind <> 'Kill'
    UNION ALL SELECT method_sig, kind, 'PARAM', i, 'CLEAR', NULL FROM i WHERE kind = 'Kill'
    UNION ALL SELECT method_sig, kind, 'RETURN', NULL, 'PARAM', i FROM i WHERE kind IN ('Generate', 'Default')
    UNION ALL SELECT method_sig, kind, 'INSTANCE', NULL, 'PARAM', i FROM i WHERE kind = 'Generate' OR (kind = 'Default' AND void))"""


def _rules(spark, d) -> DataFrame:
    kind = F.when(F.col("method") == "click", "Exclude").when(F.col("method") == "error", "Kill").when(F.col("method") == "signup", "Generate").otherwise("Default")
    sigs = _signatures(events_trace(spark, d)).select("method_sig", kind.alias("kind")).distinct()
    listed = sigs.where("kind <> 'Default'")
    return rules.rules_for(sigs, listed=listed)


@query(f"WITH_EVENTS, {SIG_SQL} SELECT method_sig, kind, lt AS left_type, CAST(li AS INT) AS left_idx, rt AS right_type, CAST(ri AS INT) AS right_idx FROM r")
def q_fw_rules(spark, d):
    return _rules(spark, d).select("method_sig", "kind", "left_type", "left_idx", "right_type", "right_idx")


def _calls(spark, d) -> DataFrame:
    """Library calls of three arguments: a local, a constant, a primitive."""
    s = _signatures(events_trace(spark, d))
    def arg(name, type_, const):
        return F.struct(name.alias("name"), F.lit(type_).alias("type"), F.lit(const).alias("is_constant"))

    args = F.array(arg(F.concat(F.lit("v"), F.col("k") % 10), "app.A", False), arg(F.lit("7"), "int", True), arg(F.concat(F.lit("w"), F.col("k") % 3), "app.B", False))
    return s.select("pos", "method_sig", F.concat(F.lit("o"), F.col("k") % 5).alias("base"), F.when(F.col("kind") == "assign", F.concat(F.lit("r"), F.col("k") % 6)).alias("ret"), args.alias("args"))


CALLS = """cl AS (SELECT pos, method_sig, 'o' || (k % 5) AS base, CASE WHEN kind = 'assign' THEN 'r' || (k % 6) END AS ret, ['v' || (k % 10), '7', 'w' || (k % 3)] AS names FROM g),
  a AS (SELECT cl.pos, r.lt, r.rt, CASE r.lt WHEN 'PARAM' THEN names[li + 1] WHEN 'RETURN' THEN ret ELSE base END AS l, CASE WHEN r.rt = 'PARAM' AND ri <> 1 THEN names[ri + 1] WHEN r.rt = 'INSTANCE' THEN base END AS rr, r.lt <> 'PARAM' OR li <> 1 AS ok FROM cl JOIN r USING (method_sig))"""
#: What is asked for at each call: its first argument, its receiver and its result, each with a field and without.
ASKED_SQL = "q AS (SELECT pos, unnest(['v' || (k % 10), 'v' || (k % 10) || '.f', 'o' || (k % 5) || '.f', 'r' || (k % 6) || '.f']) AS path FROM t)"


def _asked(spark, d) -> DataFrame:
    t = events_trace(spark, d)
    v, o, r = (F.concat(F.lit(x), F.col("k") % n) for x, n in (("v", 10), ("o", 5), ("r", 6)))
    f = F.lit("f")
    return t.select("pos", F.explode(F.array(F.array(v), F.array(v, f), F.array(o, f), F.array(r, f))).alias("path"))


def _dotted(df: DataFrame) -> DataFrame:
    return df.select("pos", *[ap.path_string(F.col(c)).alias(c) for c in df.columns if c != "pos"])


@query(f"WITH_EVENTS, {SIG_SQL}, {CALLS}, {ASKED_SQL} SELECT DISTINCT a.pos, q.path, coalesce(a.rr, '') AS used FROM a JOIN q ON a.pos = q.pos AND string_split(q.path, '.')[1] = a.l")
def q_fw_local_defs(spark, d):
    return _dotted(framework.local_definitions(_calls(spark, d), _rules(spark, d), _asked(spark, d)))


@query(f"""WITH_EVENTS, {SIG_SQL}, {CALLS}, {ASKED_SQL}, gain AS (SELECT q.pos, CASE WHEN rt = 'INSTANCE' AND lt <> 'RETURN' THEN l ELSE l || q.path[len(rr) + 1:] END AS path FROM a JOIN q ON a.pos = q.pos AND string_split(q.path, '.')[1] = a.rr WHERE ok AND l IS NOT NULL)
  SELECT pos, path FROM (SELECT * FROM q UNION SELECT * FROM gain) WHERE (pos, path) NOT IN (SELECT pos, l FROM a WHERE rt = 'CLEAR' AND l IS NOT NULL)""")
def q_taint_forward(spark, d):
    return _dotted(framework.forward_taint(_calls(spark, d), _rules(spark, d), _asked(spark, d)))


@query(f"""WITH_EVENTS, {SIG_SQL}, {CALLS}, {ASKED_SQL} SELECT DISTINCT q.pos, rr || q.path[len(l) + 1:] AS path FROM a JOIN q ON a.pos = q.pos AND string_split(q.path, '.')[1] = a.l WHERE rr IS NOT NULL""")
def q_taint_backward(spark, d):
    return _dotted(framework.backward_taint(_calls(spark, d), _rules(spark, d), _asked(spark, d)))


@query(f"WITH_EVENTS, {SIG_SQL}, {CALLS}, {ASKED_SQL} SELECT DISTINCT q.pos, q.path FROM a JOIN q ON a.pos = q.pos AND string_split(q.path, '.')[1] = a.l WHERE lt = 'INSTANCE' AND rt <> 'INSTANCE'")
def q_fw_defines_receiver(spark, d):
    return _dotted(framework.defines_receiver(_calls(spark, d), _rules(spark, d), _asked(spark, d)))


# ---------------------------------------------------------------- scopes


def _call_args(spark, d) -> tuple[DataFrame, DataFrame]:
    t = events_trace(spark, d).where("called_sig is not null")
    args = F.array(F.concat(F.lit("o"), F.col("k") % 5), F.concat(F.lit("v"), F.col("k") % 10))
    calls = t.select(F.col("pos").alias("key"), F.col("called_sig").alias("callee"), F.posexplode(args).alias("idx", "arg"))
    params = spark.createDataFrame([(m, i, f"{m[0]}{i}") for m in METHODS for i in range(2)], "method string, idx int, local string")
    return calls, params


@query("""WITH_EVENTS, c AS (SELECT pos AS key, k, called_sig AS m FROM t WHERE called_sig IS NOT NULL)
  SELECT key, left(m, 1) || '0.f' AS path, true AS changed FROM c UNION ALL SELECT key, left(m, 1) || '1', true FROM c UNION ALL SELECT key, 'C.s', false FROM c""")
def q_scope_to_callee(spark, d):
    calls, params = _call_args(spark, d)
    t = events_trace(spark, d).where("called_sig is not null")
    o, v = F.concat(F.lit("o"), F.col("k") % 5), F.concat(F.lit("v"), F.col("k") % 10)
    made = F.array(F.struct(F.array(o, F.lit("f")).alias("path"), F.lit(False).alias("is_static")), F.struct(F.array(v).alias("path"), F.lit(False).alias("is_static")), F.struct(F.array(F.lit("C"), F.lit("s")).alias("path"), F.lit(True).alias("is_static")), F.struct(F.array(F.lit("zz")).alias("path"), F.lit(False).alias("is_static")))
    paths = t.select(F.col("pos").alias("key"), F.explode(made).alias("x")).select("key", "x.path", "x.is_static")
    return scope.to_callee(paths, calls, params).select("key", ap.path_string(F.col("path")).alias("path"), "changed")


@query("""WITH_EVENTS, c AS (SELECT pos AS key, k, called_sig AS m FROM t WHERE called_sig IS NOT NULL)
  SELECT key, 'o' || (k % 5) || '.f' AS path, true AS changed FROM c UNION ALL SELECT key, 'v' || (k % 10), true FROM c UNION ALL SELECT key, 'C.s', false FROM c""")
def q_scope_to_caller(spark, d):
    calls, params = _call_args(spark, d)
    t = events_trace(spark, d).where("called_sig is not null")
    first = F.substring("called_sig", 1, 1)
    made = F.array(F.struct(F.array(F.concat(first, F.lit("0")), F.lit("f")).alias("path"), F.lit(False).alias("is_static")), F.struct(F.array(F.concat(first, F.lit("1"))).alias("path"), F.lit(False).alias("is_static")), F.struct(F.array(F.lit("C"), F.lit("s")).alias("path"), F.lit(True).alias("is_static")))
    paths = t.select(F.col("pos").alias("key"), F.explode(made).alias("x")).select("key", "x.path", "x.is_static")
    return scope.to_caller(paths, calls, params).select("key", ap.path_string(F.col("path")).alias("path"), "changed")


# ---------------------------------------------------------------- control dependence


@query("""WITH_EVENTS, u AS (SELECT pos, user_id, (unit_id // 100) * 10 + k // 10 AS unit FROM t)
  SELECT pos, dom_pos FROM (SELECT pos, coalesce(max(CASE WHEN unit = 10 THEN pos END) OVER w, max(CASE WHEN unit = 11 THEN pos END) OVER w, max(CASE WHEN unit = 5 THEN pos END) OVER w) AS dom_pos FROM u
  WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE dom_pos IS NOT NULL""")
def q_control_dom(spark, d):
    """The last row of a region's predecessors in each user's frame; every method is one region."""
    t = events_trace(spark, d)
    unit = (method_index(F.col("method")) * 10 + F.floor(F.col("k") / 10)).cast("bigint")
    stmts = t.select("pos", F.col("user_id").alias("frame_id"), unit.alias("unit_id"), "kind")
    units = spark.range(50).select(F.col("id").alias("unit_id"))
    regions = units.select(F.floor(F.col("unit_id") / 10).alias("region_id"), "unit_id", (F.col("unit_id") % 10).alias("ord"), (F.col("unit_id") % 10 == 0).alias("is_first"), F.lit(False).alias("is_exception"), F.lit(False).alias("is_catch"))
    cfg = spark.createDataFrame([(s, m * 10, i) for m in range(5) for i, s in enumerate((10, 11, 5))], "src_unit bigint, dst_unit bigint, ord int")
    return control.dominators(stmts, regions, cfg)


# ---------------------------------------------------------------- slices

DEPS_SQL = """dep AS (SELECT user_id AS trace, pos, d AS dep_pos, 'data' AS type FROM (SELECT *, max(CASE WHEN is_def THEN pos END) OVER (PARTITION BY user_id, base ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM t) WHERE d IS NOT NULL
  UNION ALL SELECT user_id, pos, d, 'control' FROM (SELECT *, max(CASE WHEN kind = 'if' THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM t) WHERE d IS NOT NULL),
  seed AS (SELECT user_id AS trace, max(pos) AS pos FROM t GROUP BY 1)"""


def _deps(spark, d) -> DataFrame:
    t = events_trace(spark, d).select(F.col("user_id").alias("trace"), "pos", "base", "is_def", "kind")
    # users whose events fit one window are exchanged once, for both
    whole = fits(table(spark, d, "events"), ["user_id"])
    t = last_before(t.repartition("trace") if whole else t, "pos", {"data": F.when(F.col("is_def"), F.col("pos"))}, ["trace", "base"], None if whole else SIZE)
    t = last_before(t, "pos", {"control": F.when(F.col("kind") == "if", F.col("pos"))}, ["trace"], None if whole else SIZE)
    each = F.array(*[F.struct(F.col(n).alias("dep_pos"), F.lit(n).alias("type")) for n in ("data", "control")])
    return t.select("trace", "pos", F.explode(each).alias("x")).select("trace", "pos", "x.dep_pos", "x.type").where("dep_pos is not null")


def _seeds(spark, d) -> DataFrame:
    return events_trace(spark, d).groupBy(F.col("user_id").alias("trace")).agg(F.max("pos").alias("pos"))


def _slice_sql(dep: str = "dep", seed: str = "seed") -> str:
    return f"""WITH RECURSIVE {EVENTS_SQL}, {DEPS_SQL}, n AS (SELECT trace, pos FROM {seed} UNION SELECT d.trace, d.dep_pos FROM {dep} d JOIN n ON d.trace = n.trace AND d.pos = n.pos),
  s AS (SELECT d.trace, d.pos, d.dep_pos, d.type FROM {dep} d JOIN n ON d.trace = n.trace AND d.pos = n.pos UNION ALL SELECT trace, pos, pos, 'data' FROM {seed})"""


@query(_slice_sql() + " SELECT trace, pos, dep_pos, type FROM s")
def q_slice_backward(spark, d):
    """What each user's last event depends on."""
    return slicer.backward_slice(_deps(spark, d), _seeds(spark, d))


@query(_slice_sql("(SELECT * FROM dep WHERE type = 'data')") + " SELECT trace, pos, dep_pos, type FROM s")
def q_slice_data_only(spark, d):
    return slicer.backward_slice(_deps(spark, d), _seeds(spark, d), slicer.Options(data_only=True))


@query(_slice_sql("(SELECT * FROM dep WHERE type = 'control')") + " SELECT trace, pos, dep_pos, type FROM s")
def q_slice_control_only(spark, d):
    return slicer.backward_slice(_deps(spark, d), _seeds(spark, d), slicer.Options(control_only=True))


@query(_slice_sql("(SELECT d.trace, d.pos, max(d.dep_pos) AS dep_pos, d.type FROM dep d JOIN t ON t.pos = d.pos JOIN seed ON seed.trace = d.trace JOIN t ts ON ts.pos = seed.pos AND ts.method = t.method GROUP BY d.trace, d.pos, d.type)") + " SELECT trace, pos, dep_pos, type FROM s")
def q_slice_once(spark, d):
    """Only through rows of the criterion's line; an event's line is its method."""
    lines = events_trace(spark, d).select(F.col("user_id").alias("trace"), "pos", F.col("method").alias("line"))
    return slicer.backward_slice(_deps(spark, d), _seeds(spark, d), slicer.Options(once=True), lines)


@query(_slice_sql() + """, src AS (SELECT trace, min(dep_pos) AS pos FROM s GROUP BY trace), r AS (SELECT trace, pos FROM src UNION SELECT s.trace, s.pos FROM s JOIN r ON s.trace = r.trace AND s.dep_pos = r.pos)
  SELECT DISTINCT s.trace, s.dep_pos, s.pos FROM s JOIN r ON s.trace = r.trace AND s.dep_pos = r.pos WHERE s.dep_pos <> s.pos""")
def q_chop_forward(spark, d):
    """Ways from the earliest row of each slice to its criterion."""
    edges = written(slicer.backward_slice(_deps(spark, d), _seeds(spark, d)), "slice")
    sources = edges.groupBy("trace").agg(F.min("dep_pos").alias("pos"))
    return slicer.chop(edges, sources)


@query(_slice_sql("dep", "(SELECT * FROM seed UNION SELECT user_id, max(pos) FROM t WHERE method = 'purchase' GROUP BY 1)") + " SELECT DISTINCT trace, pos, dep_pos, type FROM s")
def q_slice_union(spark, d):
    """The slices of the last event and of the last purchase."""
    deps = written(_deps(spark, d), "deps")
    last = events_trace(spark, d).where("method = 'purchase'").groupBy(F.col("user_id").alias("trace")).agg(F.max("pos").alias("pos"))
    return slicer.union_slices(slicer.backward_slice(deps, _seeds(spark, d)), slicer.backward_slice(deps, last))


@query("""WITH RECURSIVE """ + EVENTS_SQL + """, c AS (SELECT method AS trace, max(pos) AS pos FROM t GROUP BY 1),
  w AS (SELECT pos, base, method, max(CASE WHEN is_def THEN pos END) OVER (PARTITION BY user_id, base ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d,
   max(CASE WHEN kind = 'if' THEN pos END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS i, min(pos) OVER (PARTITION BY user_id) AS f FROM t),
  e AS (SELECT w.pos, w.base AS path, d AS dep_pos, t.base AS dep_path, 'data' AS type FROM w JOIN t ON t.pos = w.d WHERE w.method <> 'view'
   UNION ALL SELECT w.pos, NULL, i, t.base, 'control' FROM w JOIN t ON t.pos = w.i WHERE w.method <> 'view'
   UNION ALL SELECT w.pos, NULL, f, '', 'control' FROM w JOIN t ON t.pos = w.f WHERE w.i IS NULL AND f < w.pos AND t.called_sig = w.method AND w.method <> 'view'),
  n AS (SELECT trace, c.pos, base AS path FROM c JOIN t ON t.pos = c.pos UNION SELECT n.trace, e.dep_pos, e.dep_path FROM n JOIN e ON e.pos = n.pos AND (e.path IS NULL OR e.path = n.path))
  SELECT DISTINCT n.trace, e.pos, e.path, e.dep_pos, e.dep_path, e.type FROM n JOIN e ON e.pos = n.pos AND (e.path IS NULL OR e.path = n.path)
  UNION ALL SELECT c.trace, c.pos, base, c.pos, base, 'data' FROM c JOIN t ON t.pos = c.pos""")
def q_program_slice(spark, d):
    """Slices of the last event of each method in a program whose frames are users, branches their control, first events their callers; views are library code."""
    t = events_trace(spark, d)
    stmts = t.select(
        "pos", "unit_id", "method", "kind", "called_sig", F.col("called_sig").alias("called_name"), F.lit(None).cast("string").alias("ret_var"), F.lit(None).cast("string").alias("ret_type"),
        F.col("method").alias("name"), F.when(F.col("method") == "view", "android.support.v4.V").otherwise("app.V").alias("class"), F.lit(True).alias("is_static"),
    )
    units = t.select("unit_id", "base", "is_def").distinct()
    table_ = t.groupBy(F.col("user_id").alias("frame_id")).agg(F.min_by("method", "pos").alias("method"), F.min("pos").alias("first_pos"), F.min("pos").alias("caller_pos"), F.max("pos").alias("last_pos"))
    doms = last_before(t.select("pos", "user_id", "kind"), "pos", {"dom_pos": F.when(F.col("kind") == "if", F.col("pos"))}, ["user_id"]).where("dom_pos is not null")
    none = lambda schema: spark.createDataFrame([], schema)
    program = program_slice.Program(
        stmts, t.select("pos", F.col("user_id").alias("frame_id")), table_, none("src bigint, dst bigint, type string"), units.where("is_def").select("unit_id", F.lit("local").alias("def_kind"), "base"),
        units.select("unit_id", F.array("base").alias("path")), none("unit_id bigint, idx int, arg string"), none("method string, idx int, local string"), none("unit_id bigint, base string"), doms.select("pos", "dom_pos"),
    )
    criteria = t.groupBy(F.col("method").alias("trace")).agg(F.max("pos").alias("pos")).withColumn("path", F.lit(None).cast("string"))
    return program_slice.program_slice(program, written(criteria, "criteria"))


# ---------------------------------------------------------------- reports

ROWS_SQL = """, k AS (SELECT trace, dep_pos, pos, CASE WHEN count(DISTINCT type) = 2 THEN 'datacontrol' ELSE min(type) END AS kinds FROM s GROUP BY 1, 2, 3),
  rep AS (SELECT k.dep_pos * 10000000 + k.pos AS seq, k.dep_pos, k.pos, k.kinds, a.method || '.java' AS dep_file, a.k + 1 AS dep_line, CASE WHEN a.kind = 'if' THEN 'if ' || a.base || ' goto ' || a.instr ELSE a.instr || ' = f(a, b)' END AS dep_unit, a.thread_id AS dep_thread,
   'void ' || a.method || '(int,int)' AS dep_method, 'app.' || a.method AS dep_class, b.method || '.java' AS src_file, b.k + 1 AS src_line, CASE WHEN k.dep_pos = k.pos THEN '' ELSE b.base END AS path FROM k JOIN t a ON a.pos = k.dep_pos JOIN t b ON b.pos = k.pos)"""


def _report_rows(spark, d) -> DataFrame:
    kinds = slicer.edge_kinds(slicer.backward_slice(_deps(spark, d), _seeds(spark, d)))
    t = events_trace(spark, d)
    unit = F.when(F.col("kind") == "if", F.concat(F.lit("if "), "base", F.lit(" goto "), "instr")).otherwise(F.concat("instr", F.lit(" = f(a, b)")))
    dep = t.select(
        F.col("pos").alias("dep_pos"), F.concat("method", F.lit(".java")).alias("dep_file"), (F.col("k") + 1).alias("dep_line"), unit.alias("dep_unit"), F.col("thread_id").alias("dep_thread"),
        F.concat(F.lit("void "), "method", F.lit("(int,int)")).alias("dep_method"), F.concat(F.lit("app."), "method").alias("dep_class"),
    )
    src = t.select("pos", F.concat("method", F.lit(".java")).alias("src_file"), (F.col("k") + 1).alias("src_line"), unit.alias("src_unit"), F.col("base").alias("src_base"))
    rows = kinds.join(dep, "dep_pos").join(src, "pos")
    return rows.withColumns({"seq": F.col("dep_pos") * 10_000_000 + F.col("pos"), "path": F.when(F.col("dep_pos") == F.col("pos"), "").otherwise(F.col("src_base"))})


@query(_slice_sql() + ROWS_SQL + " SELECT min(seq) AS n, dep_file || ':' || dep_line AS line FROM rep GROUP BY 2")
def q_slice_lines(spark, d):
    return reports.slice_lines(_report_rows(spark, d)).select("n.seq", "line").withColumnRenamed("seq", "n")


@query(_slice_sql() + ROWS_SQL + " SELECT DISTINCT dep_file || ':' || dep_line AS line FROM rep WHERE dep_line <> -1")
def q_slice_source_lines(spark, d):
    return reports.source_lines(_report_rows(spark, d))


@query(_slice_sql() + ROWS_SQL + """, l AS (SELECT CASE WHEN dep_pos = pos THEN 2147483646 ELSE dep_pos END AS key, seq, '(' || dep_file || ':' || dep_line || ')  ' || string_split(dep_unit, 'goto')[1] || ' <--' || kinds || CASE WHEN kinds = 'data' THEN ':' || path ELSE '' END || '-- ' || src_file || ':' || src_line AS line FROM rep)
  SELECT CAST(min(key) AS BIGINT) AS key, line FROM l GROUP BY line""")
def q_slice_deps_text(spark, d):
    return reports.dependence_lines(_report_rows(spark, d)).select("n.key", "line")


@query(_slice_sql() + ROWS_SQL + ", l AS (SELECT seq, dep_method, dep_class, dep_unit, dep_line, path, row_number() OVER (PARTITION BY dep_method, dep_class, dep_unit ORDER BY seq) AS r FROM rep) SELECT seq AS n, '-1, ' || replace(dep_method, ',', ';') || ', ' || dep_class || ', ' || replace(dep_unit, ',', ';') || ', ' || dep_line || ', -1, ' || path AS line FROM l WHERE r = 1")
def q_slice_csv(spark, d):
    return reports.csv_lines(_report_rows(spark, d))


@query(_slice_sql() + ROWS_SQL + " SELECT min(seq) AS n, dep_file || ':' || dep_line || '    ' || dep_thread || '    ' || dep_pos || ':' || dep_unit AS line FROM rep GROUP BY 2")
def q_slice_raw(spark, d):
    return reports.raw_lines(_report_rows(spark, d)).select("n.seq", "line").withColumnRenamed("seq", "n")


@query(_slice_sql() + ROWS_SQL + " SELECT dep_pos, arg_max(CASE WHEN path = '' THEN 'start' ELSE (CASE WHEN kinds = 'data' THEN 'data, varaible:' || path ELSE 'control, no variable' END) || ', source:' || pos END, seq) AS text FROM rep GROUP BY dep_pos")
def q_slice_map(spark, d):
    return reports.dependence_map(_report_rows(spark, d))


@query(_slice_sql() + ROWS_SQL + """, e AS (SELECT rep.seq, rep.dep_pos, rep.pos, rep.kinds, rep.path, dep_file || ':' || dep_line || ': ' || string_split(dep_unit, 'goto')[1] AS na,
   src_file || ':' || src_line || ': ' || string_split(CASE WHEN b.kind = 'if' THEN 'if ' || b.base || ' goto ' || b.instr ELSE b.instr || ' = f(a, b)' END, 'goto')[1] AS so FROM rep JOIN t b ON b.pos = rep.pos),
  l AS (SELECT seq, CASE WHEN dep_pos = pos THEN '"' || so || '";' ELSE '"' || so || '" -> "' || na || '" [style=' || CASE WHEN kinds = 'control' THEN 'dashed' ELSE 'solid' END || ', label="' || CASE WHEN kinds = 'data' THEN path ELSE '' END || '"];' END AS line FROM e)
  SELECT min(seq) AS n, line FROM l GROUP BY line""")
def q_slice_dot(spark, d):
    """The slices as the lines of a graph file."""
    return reports.dot_lines(_report_rows(spark, d)).select("n.seq", "line").withColumnRenamed("seq", "n")


# ---------------------------------------------------------------- instrumentation, aggregation

UNITS_SQL = "u AS (SELECT DISTINCT method, unit_id, k, kind, CASE WHEN k % 9 = 8 THEN 'identity' ELSE kind END AS kd FROM t)"


def _units(spark, d) -> DataFrame:
    u = events_trace(spark, d).select("method", "unit_id", "k", "kind").distinct()
    kind = F.when(F.col("k") % 9 == 8, "identity").otherwise(F.col("kind"))
    return u.select("method", "unit_id", F.col("k").alias("ord"), kind.alias("kind"), ((F.col("kind") == "invoke") | (F.col("k") % 11 == 0)).alias("has_invoke"), (F.col("k") % 4 == 0).alias("in_library"), (F.col("k") % 3 == 0).alias("has_field_ref"))


@query(f"""WITH_EVENTS, {UNITS_SQL}, l AS (SELECT *, lead(unit_id) OVER w AS n1, lead(kd) OVER w AS k1, lead(unit_id, 2) OVER w AS n2 FROM u WINDOW w AS (PARTITION BY method ORDER BY k)),
  o AS (SELECT method, arg_min(unit_id, k) AS unit_id FROM u WHERE kd <> 'identity' GROUP BY method UNION SELECT method, n1 FROM l WHERE kd = 'if' UNION SELECT method, CASE WHEN k1 = 'identity' THEN n2 ELSE n1 END FROM l WHERE kd = 'goto'
   UNION SELECT method, (unit_id // 100) * 100 + (k * 7) % 100 FROM l WHERE kd IN ('if', 'goto') UNION SELECT method, unnest([unit_id, n1]) FROM l WHERE kd IN ('invoke', 'assign') AND (kind = 'invoke' OR k % 11 = 0) AND k % 4 <> 0
   UNION SELECT method, unit_id FROM u WHERE kd IN ('return', 'throw') UNION SELECT method, unit_id FROM u WHERE kd = 'assign' AND k % 3 = 0) SELECT method, unit_id FROM o WHERE unit_id IS NOT NULL""")
def q_probe_placement(spark, d):
    units = _units(spark, d)
    jumps = units.select("unit_id", (F.col("unit_id") - F.col("ord") + (F.col("ord") * 7) % 100).alias("target"))
    return instrument.probes(units, jumps, field_tracking=True)


_PATTERNS_SQL = "[" + ", ".join(f"{{'s': '{s}', 't': '{t}', 'k': '{k}', 'a': {str(a).lower()}}}" for s, t, k, a in instrument.CALL_PATTERNS) + "]"


@query(f"""WITH_EVENTS, p AS (SELECT unnest({_PATTERNS_SQL}) AS p), q AS (SELECT p.s AS s, p.t AS t, p.k AS kd, p.a AS a, row_number() OVER () - 1 AS i FROM p)
  SELECT DISTINCT unit_id, method, CASE WHEN a THEN 'w' || (k % 3) ELSE base END AS receiver, q.t AS target_subsig, kd AS kind FROM t JOIN q ON q.i = t.k % 20 WHERE NOT a OR k % 3 <> 0""")
def q_thread_callsites(spark, d):
    """Calls of known thread and message methods among the program's statements."""
    names = F.array(*[F.lit(p[0]) for p in instrument.CALL_PATTERNS])
    sites = events_trace(spark, d).select("unit_id", "method", F.get(names, F.col("k") % 20).alias("called_subsig"), "base", F.lit("app.T").alias("called_class"), F.when(F.col("k") % 3 != 0, F.concat(F.lit("w"), F.col("k") % 3)).alias("first_arg")).distinct()
    return instrument.implicit_calls(sites)


@query("WITH_EVENTS SELECT thread_id, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM t GROUP BY thread_id")
def q_group_threads(spark, d):
    return events_trace(spark, d).groupBy("thread_id").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query("WITH_EVENTS SELECT pos, method, base, k FROM (SELECT *, row_number() OVER (PARTITION BY method, base ORDER BY pos DESC) AS r FROM t) WHERE r = 1")
def q_trim_last(spark, d):
    return slicer.keep_last(events_trace(spark, d).select("pos", "method", "base", "k"), "pos", ["method", "base"])


@query("WITH_EVENTS SELECT instr AS location, count(*) AS n FROM t GROUP BY 1")
def q_call_samples(spark, d):
    return instrument.call_samples(events_trace(spark, d).select(F.col("instr").alias("location")))


# ---------------------------------------------------------------- predicates and projections


@query("""WITH_EVENTS, x AS (SELECT *, CASE WHEN kind = 'assign' AND k % 3 = 0 THEN k END AS field FROM t)
  SELECT pos, kind IN ('return', 'return_void') AS returns, kind = 'assign' AS assigns, called_sig IS NOT NULL AS invokes, field, pos > 5000 OR method = '<clinit>' AS later,
   coalesce(called_sig = 'signup', false) AS may_set, method = 'view' OR k % 9 = 0 AS stops,
   concat_ws(', ', CAST(pos AS VARCHAR), instr, method, base, ':FIELD:' || field, ':THREAD:' || thread_id, ':LINENO:' || k) AS key FROM x""")
def q_statement_predicates(spark, d):
    t = events_trace(spark, d)
    field = st.kept_field(F.col("kind"), F.col("k") % 3 == 0, F.col("k"))
    class_ = F.when(F.col("method") == "view", "android.support.v4.V").otherwise("app.V")
    return t.select(
        "pos", st.is_return(F.col("kind")).alias("returns"), st.is_assign(F.col("kind")).alias("assigns"), st.has_invoke(F.col("called_sig")).alias("invokes"), field.alias("field"),
        st.is_after(F.col("pos"), F.lit(5000), F.col("method")).alias("later"), st.may_set(F.when(F.col("called_sig") == "signup", "setUp").otherwise(F.col("called_sig"))).alias("may_set"),
        st.is_android(class_, F.when(F.col("k") % 9 == 0, st.STOP_FIELD)).alias("stops"),
        st.statement_key(F.col("pos"), F.col("instr"), F.col("method"), F.col("base"), field, F.col("thread_id"), F.col("k"), F.lit(None).cast("string")).alias("key"),
    )


@query(f"""WITH {PARTS_SQL} SELECT p.p_partkey, path = other AS same, path[1] = base[1] AS same_base, p_size % 5 < 3 + CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS parameter, p_size = 7 OR p.p_partkey = 7 AS used,
   p_size % 3 < 2 AS primitive, p_size % 4 <> 0 AS whole, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) AS first FROM p JOIN part USING (p_partkey)""")
def q_path_predicates(spark, d):
    n = F.col("p_size")
    types = F.when(n % 3 == 0, "int[][]").when(n % 3 == 1, "long").otherwise(F.col("p_type"))
    more = table(spark, d, "part").select("p_partkey", "p_size", "p_brand", "p_type")
    text = F.concat(n.cast("string"), F.when(n % 4 == 0, "x").otherwise(""))
    return _paths(spark, d).join(more, "p_partkey").select(
        "p_partkey", ap.same_path(F.col("path"), F.col("other")).alias("same"), ap.same_base(F.col("path"), ap.base_of(F.col("base"))).alias("same_base"),
        ap.is_parameter(F.array(F.concat(F.lit("@parameter"), n % 5)), F.lit(3), n % 2 == 0).alias("parameter"), ap.is_used_in(n, F.col("p_partkey"), F.lit(7)).alias("used"),
        ap.is_primitive(types).alias("primitive"), ap.is_integer(text).alias("whole"), ap.first_int(F.col("p_brand")).alias("first"),
    )


@query("""WITH_EVENTS, u AS (SELECT DISTINCT unit_id, kind, k, called_sig FROM t)
  SELECT u.unit_id, CASE WHEN u.kind = 'if' THEN v.called_sig ELSE u.called_sig END AS called_sig FROM u LEFT JOIN u v ON v.unit_id = u.unit_id - u.k + (u.k * 7) % 100""")
def q_call_of(spark, d):
    """What statements call; a branch calls what its target calls."""
    u = events_trace(spark, d).select("unit_id", "kind", "k", "called_sig").distinct()
    return st.call_of(u, u.select("unit_id", (F.col("unit_id") - F.col("k") + (F.col("k") * 7) % 100).alias("target")))


@query("WITH_EVENTS SELECT pos, left(method, 1) || (k % 4) || '.f' AS path FROM t WHERE k % 4 < 2")
def q_parameter_locals(spark, d):
    _, params = _call_args(spark, d)
    paths = events_trace(spark, d).select("pos", "method", F.array(F.concat(F.substring("method", 1, 1), F.col("k") % 4), F.lit("f")).alias("path"))
    return _dotted(st.parameter_locals(paths, params).select("pos", "path"))


@query("WITH_EVENTS SELECT pos, CASE WHEN k % 6 = 0 THEN pos % 50 ELSE k END AS line FROM t")
def q_line_or_ordinal(spark, d):
    line = F.when(F.col("k") % 6 == 0, -1).otherwise(F.col("k"))
    return events_trace(spark, d).select("pos", reports.line_or_ordinal(line, F.col("pos") % 50).alias("line"))


# ---------------------------------------------------------------- neighbours, returns, scopes


@query(f"WITH_EVENTS, {FLOW_SQL} SELECT src AS pos, dst AS near_pos, type FROM f")
def q_neighbours(spark, d):
    t = events_trace(spark, d)
    return frames.neighbours(t, dcfg.flow_edges(t))


@query(f"""WITH_EVENTS, {FLOW_SQL}, {CALLS_SQL}, i AS (SELECT pos, max(CASE WHEN pos NOT IN (SELECT dst FROM f) THEN pos END) OVER (ORDER BY pos) AS frame_id FROM t), b AS (SELECT frame_id, max(pos) AS last_pos FROM i GROUP BY 1)
  SELECT c.src AS call_pos, c.dst AS frame_id, b.last_pos AS ret_pos, coalesce(CASE WHEN l.kind = 'return' THEN l.base END, CASE WHEN l.k % 2 <> 0 THEN 'r0' END) AS ret_var,
   coalesce(CASE WHEN l.kind = 'return' THEN 'T' END, CASE WHEN l.k % 2 <> 0 THEN 'app.' || l.method END) AS ret_type FROM c JOIN b ON b.frame_id = c.dst JOIN t l ON l.pos = b.last_pos JOIN t s ON s.pos = c.src WHERE s.called_sig = l.method""")
def q_called_frames(spark, d):
    """What traced calls return."""
    t = events_trace(spark, d)
    returns = F.col("kind") == "return"
    stmts = t.select("pos", "method", "thread_id", "called_sig", F.col("called_sig").alias("called_name"), F.col("method").alias("name"), F.concat(F.lit("app."), "method").alias("class"), (F.col("k") % 2 == 0).alias("is_static"), F.when(returns, F.col("base")).alias("ret_var"), F.when(returns, "T").alias("ret_type"))
    edges = written(dcfg.flow_edges(t).union(_direct_calls(t)), "edges")
    return frames.called_frames(stmts, edges, frames.frame_table(stmts, frames.frame_ids(stmts, edges), edges))


@query(f"WITH_EVENTS, {CALLS_SQL} SELECT pos, called_sig FROM t WHERE called_sig IS NOT NULL AND pos NOT IN (SELECT src FROM c)")
def q_library_calls(spark, d):
    """Calls whose callee left no rows."""
    t = events_trace(spark, d)
    return frames.library_calls(t, _direct_calls(t)).select("pos", "called_sig")


@query("""WITH_EVENTS SELECT pos AS key, CASE k % 3 WHEN 0 THEN left(called_sig, 1) || '0.f' WHEN 1 THEN 'o' || (k % 5) || '.f' ELSE 'zz' END AS path, k % 3 <> 2 AS changed FROM t WHERE called_sig IS NOT NULL""")
def q_change_scope(spark, d):
    """A path at each call, into the callee, back to the caller, or in place."""
    calls, params = _call_args(spark, d)
    way = F.when(F.col("k") % 3 == 0, "callee").when(F.col("k") % 3 == 1, "caller").otherwise("same")
    base = F.when(F.col("k") % 3 == 0, F.concat(F.lit("o"), F.col("k") % 5)).otherwise(F.concat(F.substring("called_sig", 1, 1), F.lit("0")))
    path = F.when(F.col("k") % 3 == 2, F.array(F.lit("zz"))).otherwise(F.array(base, F.lit("f")))
    paths = events_trace(spark, d).where("called_sig is not null").select(F.col("pos").alias("key"), path.alias("path"), F.lit(False).alias("is_static"), way.alias("direction"))
    return scope.change_scope(paths, calls, params).select("key", ap.path_string(F.col("path")).alias("path"), "changed")


@query("""WITH_EVENTS SELECT pos AS frame_id, pos - 1 AS caller_pos, unnest([left(called_sig, 1) || '0.f', 'C.s']) AS path FROM t WHERE called_sig IS NOT NULL""")
def q_caller_context(spark, d):
    """The paths of a frame that its caller sees: of a parameter and a static field, not of a local."""
    _, params = _call_args(spark, d)
    t = events_trace(spark, d).where("called_sig is not null")
    made = F.array(*[F.struct(p.alias("path"), F.lit(s).alias("is_static")) for p, s in ((F.array(F.concat(F.substring("called_sig", 1, 1), F.lit("0")), F.lit("f")), False), (F.array(F.lit("zz")), False), (F.array(F.lit("C"), F.lit("s")), True))])
    paths = t.select(F.col("pos").alias("frame_id"), F.explode(made).alias("x")).select("frame_id", "x.path", "x.is_static")
    seen = scope.caller_context(t.select(F.col("pos").alias("frame_id"), F.col("called_sig").alias("method"), (F.col("pos") - 1).alias("caller_pos")), paths, params)
    return seen.select("frame_id", "caller_pos", ap.path_string(F.col("path")).alias("path"))


# ---------------------------------------------------------------- formats and numbers


@query("WITH_EVENTS SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS n FROM t WHERE k % 3 = 0")
def q_numbered(spark, d):
    return numbered(events_trace(spark, d).where("k % 3 = 0").select("pos"), "n", ["pos"])


@query("""WITH_EVENTS, u AS (SELECT DISTINCT unit_id, k FROM t), a AS (SELECT u.unit_id, u.k, CASE WHEN u.k % 10 = 4 THEN CASE WHEN n.unit_id IS NULL THEN 'goto tmpString = "' || (u.unit_id + 1) || '"' ELSE 'goto x = ' || (u.k + 1) END WHEN u.k % 10 <> 3 THEN 'x = ' || u.k END AS i
   FROM u LEFT JOIN u n ON n.unit_id = u.unit_id + 1)
  SELECT a.unit_id AS bb_id, CASE WHEN a.k % 10 = 3 THEN CASE WHEN b.i IS NULL THEN 'goto tmpString = "' || (a.unit_id + 1) || '"' ELSE 'goto ' || b.i END ELSE a.i END AS instr FROM a LEFT JOIN a b ON b.unit_id = a.unit_id + 1""")
def q_goto_chain(spark, d):
    """Placeholders of gotos, some of them to other gotos, replaced by what they lead to."""
    jump = F.concat(F.lit('goto tmpString = "'), F.col("unit_id") + 1, F.lit('"'))
    u = events_trace(spark, d).select("unit_id", "method", "k").distinct()
    blocks = u.select(F.col("unit_id").alias("bb_id"), "method", F.lit(0).alias("stmt_idx"), F.when((F.col("k") % 10).isin(3, 4), jump).otherwise(F.concat(F.lit("x = "), "k")).alias("instr"), F.col("k").cast("bigint").alias("bb_src_line"))
    return traces.resolve_gotos(written(blocks, "blocks")).select("bb_id", "instr")


@query("""SELECT '<lib.C: ' || p_name || '()>' AS method_sig, CASE p_partkey % 5 WHEN 2 THEN 'Exclude' WHEN 3 THEN 'Kill' ELSE 'Generate' END AS kind FROM part WHERE p_partkey % 5 > 1""")
def q_rule_file(spark, d):
    """A rule file with comments, excludes and kills, written and read back."""
    mark = F.get(F.array(*[F.lit(x) for x in ("% ", "^", "~", "-", "")]), F.col("p_partkey") % 5)
    path = f"{scratch_dir(spark)}/tracery-rules-{uuid.uuid4().hex}"
    table(spark, d, "part").select(F.concat(mark, F.lit("<lib.C: "), "p_name", F.lit("()>")).alias("value")).write.text(path)
    return rules.read_rule_file(spark, path)


@query(_slice_sql() + ROWS_SQL + ", l AS (SELECT dep_method, dep_class, dep_unit, dep_line, path, row_number() OVER (PARTITION BY dep_method, dep_class, dep_unit ORDER BY seq) AS r FROM rep) SELECT '-1, ' || replace(dep_method, ',', ';') || ', ' || dep_class || ', ' || replace(dep_unit, ',', ';') || ', ' || dep_line || ', -1, ' || path AS value FROM l WHERE r = 1 UNION ALL SELECT 'ID, Method, Class, Line, Source, Var'")
def q_report_file(spark, d):
    """The CSV report written as text with its head, and read back."""
    path = f"{scratch_dir(spark)}/tracery-report-{uuid.uuid4().hex}"
    reports.write_report(reports.csv_lines(_report_rows(spark, d)), path, head=["ID, Method, Class, Line, Source, Var"])
    return spark.read.text(path)


@query(f"""WITH_EVENTS, {UNITS_SQL}, n AS (SELECT method, unit_id, k, kd, row_number() OVER (PARTITION BY method ORDER BY unit_id) - 1 AS probe FROM u)
  SELECT n.method, n.unit_id, probe, concat_ws(':', CAST(probe AS VARCHAR), CAST(k % 3 AS VARCHAR), CASE WHEN k % 5 <> 0 THEN CAST(k % 5 AS VARCHAR) END) AS payload,
   f.unit_id IS NOT NULL AS flushes FROM n LEFT JOIN (SELECT method, min(unit_id) AS unit_id FROM u WHERE kd <> 'identity' AND method IN ('click', 'view') GROUP BY 1) f ON f.unit_id = n.unit_id""")
def q_probe_ids(spark, d):
    """Probes with their numbers, what they write, and whether the buffer is flushed there."""
    units = _units(spark, d)
    flush = instrument.flush_points(units.withColumn("method_name", F.col("method")), ["click", "view"]).select("unit_id", F.lit(True).alias("flushes"))
    k = F.col("ord")
    numbers = instrument.probe_ids(units.select("method", "unit_id", "ord"))
    return numbers.join(flush, "unit_id", "left").select("method", "unit_id", "probe", instrument.payload(F.col("probe"), k % 3, k % 5).alias("payload"), F.coalesce("flushes", F.lit(False)).alias("flushes"))


@query("SELECT p_partkey, unnest(string_split(replace(p_name, ' ', '-'), '-')) AS package FROM part")
def q_package_filter(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(instrument.package_filter(F.replace("p_name", F.lit(" "), F.lit("-")))).alias("package"))

# queries of whole programs register themselves
from tracery.plans import program_queries as program_queries  # noqa: E402
