"""Queries over whole programs: frames that call frames, with arguments, fields, arrays and library calls."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracery.operators import control, defuse, framework, grammar, instrument, program_slice, slicer
from tracery.operators.frametaint import taint_along
from tracery.plans.adapters import EVENTS_SQL, events_trace
from tracery.plans.ordered import last_before, previous
from tracery.plans.queries import ASKED_SQL, CALLS, DEPS_SQL, SIG_SQL, _asked, _calls, _deps, _dotted, _rules, _seeds, _signatures, query
from tracery.plans.scratch import scratch_dir, written
from tracery.sources import rules
from tracery.streaming.ingest import stream_trace

ADD = "<L: void add(O)>"

#: Ten events of a user in turn are one run of three frames: rows 0-2 and 8-9 call rows 3 and 6-7, which call rows 4-5.
PROGRAM_SQL = f"""{EVENTS_SQL},
  r0 AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1) // 10 AS blk, (row_number() OVER (PARTITION BY user_id ORDER BY pos) - 1) % 10 AS i FROM t),
  r1 AS (SELECT *, [0, 0, 0, 1, 2, 2, 1, 1, 0, 0][i + 1] AS lvl FROM r0),
  r AS (SELECT *, min(pos) OVER (PARTITION BY user_id, blk, lvl) AS frame, 'v' || ((k + 3) % 10) AS arg1, 'v' || ((k + 5) % 10) AS arg2, 'v' || ((k + 1) % 10) AS local,
    method = 'view' AND k % 5 = 0 AS loads, CASE WHEN i IN (2, 3) THEN 'invoke' ELSE kind END AS what,
    CASE WHEN i = 2 THEN 'L1' WHEN i = 3 AND blk % 2 = 1 THEN 'append' WHEN i = 3 THEN 'L2' WHEN kind = 'invoke' THEN 'add' END AS calls FROM r1),
  fr AS (SELECT user_id, blk, lvl, min(pos) AS frame, max(pos) AS last FROM r GROUP BY ALL),
  b AS (SELECT c.pos AS call_pos, c.frame, f.frame AS callee, f.last + 1 AS fin, f.last, f.lvl, c.base, c.arg1 FROM fr f JOIN r c ON c.user_id = f.user_id AND c.blk = f.blk AND c.i = f.lvl + 1 AND f.lvl > 0),
  bound AS (SELECT call_pos, frame, base, callee, ['v1', 'v3'][lvl] AS param, fin FROM b UNION SELECT call_pos, frame, arg1, callee, ['v2', 'v0'][lvl], fin FROM b),
  lib AS (SELECT pos, frame, base, arg2 FROM r WHERE calls = 'add' UNION SELECT pos, frame, arg2, arg2 FROM r WHERE calls = 'add'),
  role AS (SELECT frame, base, pos, method IN ('signup', 'purchase') AS kill, pos AS def_pos, base AS via FROM r WHERE method IN ('signup', 'purchase') OR method = 'click' AND k % 3 = 0 OR method = 'error' AND k % 4 = 0
    UNION SELECT r.frame, r.base, r.pos, false, r.pos, r.base FROM r JOIN b ON b.call_pos = r.pos UNION SELECT frame, base, pos, false, pos, base FROM lib
    UNION SELECT n.frame, n.base, n.pos, false, n.nxt, n.local FROM (SELECT *, lead(pos) OVER (PARTITION BY frame ORDER BY pos) AS nxt FROM r) n JOIN lib ON lib.pos = n.nxt AND lib.base = n.local WHERE n.loads),
  ask AS (SELECT frame, base, pos, '@' AS kind FROM r WHERE NOT loads UNION SELECT frame, base, pos, '@' FROM role WHERE NOT kill UNION SELECT frame, base, call_pos, '@' FROM bound UNION SELECT callee, param, fin, '$' FROM bound),
  a AS (SELECT ask.frame, ask.base, ask.pos, kind, max(role.pos) AS cut FROM ask LEFT JOIN role ON role.frame = ask.frame AND role.base = ask.base AND kill AND role.pos < ask.pos GROUP BY ALL),
  step AS (SELECT a.pos, kind || a.base AS path, def_pos AS to_pos, '=' || via AS to_path FROM a JOIN role ON role.frame = a.frame AND role.base = a.base AND role.pos < a.pos AND role.pos >= coalesce(cut, -1)
    UNION SELECT a.pos, kind || a.base, fin, '$' || param FROM a JOIN bound ON bound.frame = a.frame AND bound.base = a.base AND call_pos < a.pos AND call_pos >= coalesce(cut, -1)
    UNION SELECT a.pos, kind || a.base, call_pos, '@' || bound.base FROM a JOIN bound ON bound.callee = a.frame AND param = a.base WHERE kind = '@' AND cut IS NULL
    UNION SELECT a.pos, a.kind || a.base, unnest([r.pos, b.call_pos]), '=' || a.base FROM a JOIN b ON b.callee = a.frame AND b.lvl = 2 JOIN r c ON c.pos = b.call_pos AND c.calls = 'append' JOIN r ON r.frame = b.callee AND r.what = 'return' WHERE a.kind = '$'),
  d0 AS (SELECT pos, path, to_pos, to_path FROM step WHERE path LIKE '@%' UNION SELECT d0.pos, d0.path, step.to_pos, step.to_path FROM d0 JOIN step ON step.pos = d0.to_pos AND step.path = d0.to_path),
  d AS (SELECT pos, substr(path, 2) AS path, to_pos AS def_pos, substr(to_path, 2) AS via FROM d0 WHERE to_path LIKE '=%'),
  u AS (SELECT pos, CASE WHEN loads THEN base || '.f' ELSE base END AS used FROM r),
  ret AS (SELECT b.call_pos, b.last AS ret_pos, CASE WHEN r.k % 2 = 0 THEN r.base END AS ret FROM b JOIN r ON r.pos = b.last JOIN r c ON c.pos = b.call_pos WHERE c.calls <> 'append'),
  pl AS (SELECT * FROM d WHERE def_pos NOT IN (SELECT call_pos FROM ret)),
  dom AS (SELECT pos, max(CASE WHEN what = 'if' THEN pos END) OVER (PARTITION BY frame ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dom FROM r),
  e AS (SELECT d.pos, d.path, ret_pos AS dep_pos, coalesce(ret, '') AS dep_path, 'data' AS type FROM d JOIN ret ON call_pos = def_pos
    UNION SELECT pl.pos, path, def_pos, used, 'data' FROM pl JOIN u ON u.pos = def_pos
    UNION SELECT pl.pos, path, def_pos, path, 'data' FROM pl JOIN r ON r.pos = def_pos AND r.base = path AND method = 'click' AND k % 3 = 0
    UNION SELECT pl.pos, path, def_pos, arg2, 'data' FROM pl JOIN lib ON lib.pos = def_pos AND lib.base = via
    UNION SELECT dom.pos, NULL, dom, used, 'control' FROM dom JOIN u ON u.pos = dom
    UNION SELECT dom.pos, NULL, call_pos, '', 'control' FROM dom JOIN r USING (pos) JOIN b ON b.callee = r.frame JOIN r c ON c.pos = call_pos WHERE dom IS NULL AND c.calls = 'L' || r.lvl),
  ee AS (SELECT * FROM e WHERE dep_pos < pos),
  c AS (SELECT method AS trace, max(pos) AS pos FROM t GROUP BY 1 UNION SELECT 'entered ' || (user_id % 5), max(call_pos) FROM b JOIN r ON r.pos = b.call_pos GROUP BY 1),
  s AS (SELECT trace, c.pos, used AS path FROM c JOIN u ON u.pos = c.pos), en AS (SELECT s.*, ret_pos AS dep_pos, used AS dep_path FROM s JOIN ret ON call_pos = s.pos JOIN u ON u.pos = ret_pos),
  n AS (SELECT * FROM s UNION SELECT trace, dep_pos, dep_path FROM en UNION SELECT n.trace, ee.dep_pos, ee.dep_path FROM n JOIN ee ON ee.pos = n.pos AND (ee.path IS NULL OR ee.path = n.path)),
  sl AS (SELECT n.trace, ee.* FROM n JOIN ee ON ee.pos = n.pos AND (ee.path IS NULL OR ee.path = n.path) UNION SELECT trace, pos, path, pos, path, 'data' FROM s UNION SELECT trace, pos, path, dep_pos, dep_path, 'data' FROM en)"""


def _program(spark, d) -> tuple[program_slice.Program, DataFrame]:
    """The program over the events, and its rows."""
    t = events_trace(spark, d)
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("pos")) - 1
    var = lambda n: F.concat(F.lit("v"), (F.col("k") + n) % 10)
    r = t.withColumns({"blk": F.floor(turn / 10), "i": turn % 10})
    r = r.withColumn("lvl", F.get(F.array(*[F.lit(x) for x in (0, 0, 0, 1, 2, 2, 1, 1, 0, 0)]), F.col("i")))
    r = r.withColumns({
        "frame_id": F.min("pos").over(Window.partitionBy("user_id", "blk", "lvl")), "loads": (F.col("method") == "view") & (F.col("k") % 5 == 0),
        "what": F.when(F.col("i").isin(2, 3), "invoke").otherwise(F.col("kind")),
        "calls": F.when(F.col("i") == 2, "L1").when((F.col("i") == 3) & (F.col("blk") % 2 == 1), "append").when(F.col("i") == 3, "L2").when(F.col("kind") == "invoke", "add"),
    })
    r = written(r, "program")
    sig = F.when(F.col("calls") == "append", program_slice.APPEND).when(F.col("calls") == "add", ADD).otherwise(F.col("calls"))
    returned = F.when(F.col("k") % 2 == 0, F.col("base"))
    stmts = r.select("pos", "unit_id", F.col("what").alias("kind"), sig.alias("called_sig"), F.col("calls").alias("called_name"), returned.alias("ret_var"), F.lit("T").alias("ret_type"), F.concat(F.lit("L"), "lvl").alias("name"), F.lit("app.V").alias("class"), F.lit(True).alias("is_static"))
    bounds = r.groupBy("user_id", "blk", "lvl").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    callers = r.where("i in (2, 3)").select("user_id", "blk", (F.col("i") - 1).alias("lvl"), F.col("pos").alias("call"))
    table = bounds.join(callers, ["user_id", "blk", "lvl"], "left").select(F.col("first_pos").alias("frame_id"), F.concat(F.lit("m"), "lvl").alias("method"), "first_pos", "last_pos", F.coalesce("call", "first_pos").alias("caller_pos"))
    table = written(table, "frames")
    calls = table.where("caller_pos <> first_pos").select(F.col("caller_pos").alias("src"), F.col("first_pos").alias("dst"), F.lit("CALL_EDGE").alias("type"))
    flow = previous(r.select("pos", "frame_id"), "pos", {"src": "pos"}, ["frame_id"]).where("src is not null").select("src", F.col("pos").alias("dst"), F.lit("FLOW_EDGE").alias("type"))
    units = r.select("unit_id", "method", "k", "base", "loads").distinct()
    written_to = F.when(F.col("method").isin("signup", "purchase"), "local").when((F.col("method") == "click") & (F.col("k") % 3 == 0), "field").when((F.col("method") == "error") & (F.col("k") % 4 == 0), "array")
    args = units.select("unit_id", F.posexplode(F.array(F.col("base"), var(3))).alias("idx", "arg"))
    params = spark.createDataFrame([("m1", 0, "v1"), ("m1", 1, "v2"), ("m2", 0, "v3"), ("m2", 1, "v0")], "method string, idx int, local string")
    doms = last_before(r.select("pos", "frame_id", "what"), "pos", {"dom_pos": F.when(F.col("what") == "if", F.col("pos"))}, ["frame_id"]).where("dom_pos is not null")
    arg = F.array(F.struct(var(5).alias("name"), F.lit("O").alias("type"), F.lit(False).alias("is_constant")))
    library = r.where("calls = 'add'").select("pos", F.lit(ADD).alias("method_sig"), "base", F.lit(None).cast("string").alias("ret"), arg.alias("args"))
    program = program_slice.Program(
        stmts, r.select("pos", "frame_id"), table, written(calls.union(flow), "edges"), units.select("unit_id", written_to.alias("def_kind"), "base").where("def_kind is not null"),
        units.select("unit_id", F.when(F.col("loads"), F.array("base", F.lit("f"))).otherwise(F.array("base")).alias("path")), args, params, units.select("unit_id", "base"), doms.select("pos", "dom_pos"),
        library, rules.model_rules(spark.createDataFrame([(ADD, "Generate")], "method_sig string, kind string")), units.where("loads").select("unit_id", "base", var(1).alias("local")),
    )
    return program, r


def _call_slice(spark, d) -> tuple[program_slice.Program, DataFrame]:
    """Slices of the last event of each method, and of the last call of each fifth of the users."""
    program, r = _program(spark, d)
    events = r.groupBy(F.col("method").alias("trace")).agg(F.max("pos").alias("pos"))
    called = r.join(program.frames.where("caller_pos <> first_pos").select(F.col("caller_pos").alias("pos")), "pos")
    called = called.groupBy(F.concat(F.lit("entered "), F.col("user_id") % 5).alias("trace")).agg(F.max("pos").alias("pos"))
    criteria = written(events.union(called).withColumn("path", F.lit(None).cast("string")), "criteria")
    return program, program_slice.program_slice(program, criteria)


@query("WITH RECURSIVE " + PROGRAM_SQL + " SELECT DISTINCT trace, pos, path, dep_pos, dep_path, type FROM sl")
def q_program_call_slice(spark, d):
    """Slices through calls two deep, their arguments and returns, fields, arrays, receivers, loaded fields, library rules and control."""
    return _call_slice(spark, d)[1]


@query("WITH RECURSIVE " + PROGRAM_SQL + """, nodes AS (SELECT trace, pos FROM sl UNION SELECT trace, dep_pos FROM sl)
  SELECT trace, pos, call_pos AS caller_pos FROM nodes JOIN dom USING (pos) JOIN r USING (pos) JOIN b ON b.callee = r.frame JOIN r c ON c.pos = call_pos WHERE dom IS NULL AND c.calls = 'L' || r.lvl AND call_pos < pos""")
def q_slice_methods(spark, d):
    """The call that the method of each row of a slice was entered by, where no row controls it."""
    program, edges = _call_slice(spark, d)
    return program_slice.methods_of(program, written(edges, "slice"))


# ---------------------------------------------------------------- grammars


def _grammar(spark, d) -> tuple[DataFrame, DataFrame]:
    """The grammar of the statements of each thread."""
    return grammar.trace_grammar(events_trace(spark, d).select(F.col("thread_id").alias("trace"), "pos", F.col("instr").alias("symbol")))


@query()
def q_trace_grammar(spark, d):
    """The rules of the grammar as text, with their uses and lengths (tested against plain Python)."""
    rules_, sequence = _grammar(spark, d)
    return rules_.select("rule", "length").join(grammar.grammar_lines(rules_), "rule").join(grammar.rule_uses(rules_, sequence), "rule", "left").select("rule", "body", "length", F.coalesce("uses", F.lit(0)).alias("uses"))


@query("WITH " + EVENTS_SQL + " SELECT thread_id AS trace, row_number() OVER (PARTITION BY thread_id ORDER BY pos) - 1 AS at, instr AS symbol FROM t")
def q_grammar_expansion(spark, d):
    """The traces, read back from their grammar."""
    return grammar.expanded(*_grammar(spark, d))


# ---------------------------------------------------------------- taint along frames


_AFTER = """SELECT lv.frame, lv.pos, CASE WHEN x.rt = 'same' THEN path WHEN string_split(path, '.')[1] = x.rr THEN CASE WHEN x.rt = 'INSTANCE' AND x.lt <> 'RETURN' THEN x.l ELSE x.l || path[len(x.rr) + 1:] END END AS path
      FROM lv JOIN fx x ON x.frame = lv.frame AND x.pos = lv.pos"""


@query(f"""WITH RECURSIVE {EVENTS_SQL}, {SIG_SQL}, {CALLS}, f AS (SELECT a.*, user_id AS frame FROM a JOIN t USING (pos)),
  fx AS (SELECT DISTINCT frame, pos, 'same' AS rt, '' AS lt, '' AS l, '' AS rr FROM f UNION SELECT frame, pos, rt, lt, l, rr FROM f WHERE ok AND l IS NOT NULL AND rr IS NOT NULL), cx AS (SELECT DISTINCT frame, pos, l FROM f WHERE rt = 'CLEAR' AND l IS NOT NULL),
  nm AS (SELECT frame, l AS base, pos FROM f WHERE l IS NOT NULL UNION SELECT frame, rr, pos FROM f WHERE rr IS NOT NULL), ne AS (SELECT *, lead(pos) OVER (PARTITION BY frame, base ORDER BY pos) AS nxt FROM nm),
  sd AS (SELECT user_id AS frame, pos, 'v' || (k % 10) AS base FROM t WHERE k % 11 = 0),
  lv AS (SELECT sd.frame, min(nm.pos) AS pos, sd.base || '.f' AS path FROM sd JOIN nm ON nm.frame = sd.frame AND nm.base = sd.base AND nm.pos > sd.pos GROUP BY sd.frame, sd.pos, sd.base
    UNION SELECT n.frame, ne.nxt, n.path FROM ({_AFTER}) n JOIN ne ON ne.frame = n.frame AND ne.pos = n.pos AND ne.base = string_split(n.path, '.')[1] WHERE nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cx WHERE cx.frame = n.frame AND cx.pos = n.pos AND cx.l = n.path))
  SELECT DISTINCT frame, pos, path FROM ({_AFTER}) n WHERE path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cx WHERE cx.frame = n.frame AND cx.pos = n.pos AND cx.l = n.path)""")
def q_taint_along(spark, d):
    """Taint of first arguments with a field, followed through all calls of a user."""
    calls = _calls(spark, d).join(events_trace(spark, d).select("pos", F.col("user_id").alias("frame")), "pos")
    seeds = events_trace(spark, d).where(F.col("k") % 11 == 0).select(F.col("user_id").alias("frame"), "pos", F.array(F.concat(F.lit("v"), F.col("k") % 10), F.lit("f")).alias("path"))
    out = taint_along(calls, _rules(spark, d), seeds)
    return out.select("frame", "pos", F.array_join("path", ".").alias("path"))


# ---------------------------------------------------------------- static fields


@query("WITH " + EVENTS_SQL + """, a AS (SELECT pos, 'C' || (k % 3) || '.f' || (k % 7) AS two, 'C' || (k % 3) || '.f' || (k % 7) || repeat('.g' || (k % 2), k % 4) AS path FROM t WHERE has_static),
  w AS (SELECT pos, 'C' || (k % 3) || '.f' || (k % 7) AS two, 'C' || (k % 3) || '.f' || (k % 7) || CASE WHEN k % 5 = 0 THEN '.g' || (k % 2) ELSE '' END AS path, base, method = 'signup' AS init FROM t WHERE is_def),
  h AS (SELECT a.pos, a.path, coalesce(max(CASE WHEN w.pos < a.pos THEN w.pos END), min(CASE WHEN w.pos > a.pos AND w.pos - a.pos <= 5000 AND w.init THEN w.pos END)) AS def_pos FROM a LEFT JOIN w ON w.two = a.two AND starts_with(a.path || '.', w.path || '.') GROUP BY ALL)
  SELECT h.pos, h.path, def_pos, w.base || h.path[len(w.path) + 1:] AS source FROM h LEFT JOIN w ON w.pos = def_pos""")
def q_static_prefix(spark, d):
    """Static paths of two to five elements, defined by writes of their beginnings."""
    t = events_trace(spark, d)
    owner, field, inner = F.concat(F.lit("C"), F.col("k") % 3), F.concat(F.lit("f"), F.col("k") % 7), F.concat(F.lit("g"), F.col("k") % 2)
    asked = t.where("has_static").select("pos", F.concat(F.array(owner, field), F.array_repeat(inner, (F.col("k") % 4).cast("int"))).alias("path"))
    wrote = F.when(F.col("k") % 5 == 0, F.array(owner, field, inner)).otherwise(F.array(owner, field))
    writes = t.where("is_def").select("pos", wrote.alias("path"), F.col("base").alias("right"), (F.col("method") == "signup").alias("in_initialiser"))
    out = defuse.static_field_definition(asked, writes)
    return out.select("pos", F.array_join("path", ".").alias("path"), "def_pos", F.array_join("source", ".").alias("source"))


# ---------------------------------------------------------------- streams


@query("WITH " + EVENTS_SQL + """, l AS (SELECT 'f' || (thread_id % 4) AS file, pos, k, thread_id, lag(k || ':' || thread_id) OVER (PARTITION BY thread_id % 4 ORDER BY pos) AS before FROM t)
  SELECT file, row_number() OVER (PARTITION BY file ORDER BY pos, s) - 1 AS pos, CAST(k AS BIGINT) AS bb_id, CAST(s AS INT) AS stmt_idx, 'm' || (k % 5) AS method, 'i' || k || CASE s WHEN 1 THEN '+' ELSE '' END AS instr, thread_id
  FROM l, (SELECT unnest([0, 1]) AS s) WHERE before IS DISTINCT FROM (k || ':' || thread_id)""")
def q_stream_ingest(spark, d):
    """Four traces of a line for each event, read as a stream in two runs that share their state."""
    t = events_trace(spark, d)
    lines = t.select(F.concat(F.lit("f"), F.col("thread_id") % 4).alias("file"), F.col("pos").alias("line_no"), F.concat(F.lit("log SLICING:"), "k", F.lit(":"), "thread_id", F.lit("-")).alias("value"))
    block = t.select(F.col("k").cast("bigint").alias("bb_id")).distinct()
    instr = F.array(F.concat(F.lit("i"), "bb_id"), F.concat(F.lit("i"), "bb_id", F.lit("+")))
    blocks = written(block.select("bb_id", F.concat(F.lit("m"), F.col("bb_id") % 5).alias("method"), F.posexplode(instr).alias("stmt_idx", "instr"), F.col("bb_id").alias("bb_src_line")), "blocks")
    at = f"{scratch_dir(spark)}/tracery-stream-{uuid.uuid4().hex}"
    half = t.agg((F.max("pos") / 2).cast("bigint")).first()[0]
    for part in (F.col("line_no") <= half, F.col("line_no") > half):
        lines.where(part).write.mode("append").parquet(f"{at}/in")
        stream = stream_trace(spark.readStream.schema(lines.schema).parquet(f"{at}/in"), blocks)
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/marks").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").select("file", "pos", "bb_id", "stmt_idx", "method", "instr", "thread_id")


# ---------------------------------------------------------------- regions


@query("WITH RECURSIVE " + EVENTS_SQL + """, u AS (SELECT DISTINCT method, unit_id, k, kind FROM t), nx AS (SELECT *, lead(unit_id) OVER w AS one, lead(unit_id, 3) OVER w AS three, lead(unit_id, 5) OVER w AS five FROM u WINDOW w AS (PARTITION BY method ORDER BY unit_id)),
  e AS (SELECT unit_id AS src, one AS dst FROM nx WHERE kind NOT IN ('goto', 'return') AND one IS NOT NULL UNION SELECT unit_id, three FROM nx WHERE kind = 'goto' AND three IS NOT NULL UNION SELECT unit_id, five FROM nx WHERE kind = 'if' AND five IS NOT NULL),
  av AS (SELECT p.unit_id AS p, x.unit_id AS x FROM u p JOIN u x ON p.method = x.method AND p.unit_id <> x.unit_id AND x.unit_id NOT IN (SELECT src FROM e) UNION SELECT av.p, e.src FROM av JOIN e ON e.dst = av.x AND e.src <> av.p),
  af AS (SELECT x.unit_id AS x, p.unit_id AS p FROM u x JOIN u p ON p.method = x.method AND (p.unit_id = x.unit_id OR NOT EXISTS (SELECT 1 FROM av WHERE av.p = p.unit_id AND av.x = x.unit_id))),
  br AS (SELECT src, dst FROM e WHERE src IN (SELECT src FROM e GROUP BY 1 HAVING count(*) > 1)),
  cd AS (SELECT af.p AS unit_id, src, dst FROM br JOIN af ON af.x = br.dst WHERE af.p = br.src OR NOT EXISTS (SELECT 1 FROM af o WHERE o.x = br.src AND o.p = af.p)),
  g AS (SELECT u.method, u.unit_id, coalesce(string_agg(src || '>' || dst, ',' ORDER BY src, dst), '') AS decided FROM u LEFT JOIN (SELECT DISTINCT * FROM cd) c USING (unit_id) GROUP BY ALL)
  SELECT method, min(unit_id) OVER (PARTITION BY method, decided) AS region_id, unit_id, row_number() OVER (PARTITION BY method, decided ORDER BY unit_id) - 1 AS ord FROM g""")
def q_regions(spark, d):
    """Regions of the methods' statements: branches skip four, jumps two, a return ends."""
    u = events_trace(spark, d).select("method", "unit_id", "kind").distinct()
    near = lambda n: F.lead("unit_id", n).over(Window.partitionBy("method").orderBy("unit_id"))
    steps = u.select("unit_id", "kind", near(1).alias("one"), near(3).alias("three"), near(5).alias("five"))
    to = F.array(F.when(~F.col("kind").isin("goto", "return"), F.col("one")), F.when(F.col("kind") == "goto", F.col("three")), F.when(F.col("kind") == "if", F.col("five")))
    cfg = written(steps.select(F.col("unit_id").alias("src_unit"), F.explode(to).alias("dst_unit")).where("dst_unit is not null"), "cfg")
    return control.regions_of(written(u.select("method", "unit_id", F.col("unit_id").alias("ord")), "units"), cfg).select("method", "region_id", "unit_id", "ord")


# ---------------------------------------------------------------- library summaries


def _summarised(spark, d) -> DataFrame:
    """Rules of the library's methods: errors, purchases and views from XML written and read back, the rest as listed or by default.

    An error clears the field f of its receiver; a purchase gives its result the
    receiver's field g and its receiver's field h the first argument's field f; a view
    gives its first argument its receiver.
    """
    sigs = _signatures(events_trace(spark, d)).where(F.col("k") % 4 > 0).select("method", "method_sig").distinct()
    own = {
        "error": [("INSTANCE", None, "lib.C java.lang.Object f", "CLEAR", None, "")],
        "purchase": [("RETURN", None, "", "INSTANCE", None, "lib.C java.lang.Object g"), ("INSTANCE", None, "lib.C java.lang.Object h", "PARAM", 0, "app.A java.lang.Object f")],
        "view": [("PARAM", 0, "", "INSTANCE", None, "")],
    }
    model = spark.createDataFrame([(m, *r) for m, rs in own.items() for r in rs], "method string, left_type string, left_idx int, left_path string, right_type string, right_idx int, right_path string")
    at = f"{scratch_dir(spark)}/tracery-summaries-{uuid.uuid4().hex}"
    rules.write_summaries(sigs.join(F.broadcast(model), "method").drop("method"), at)
    every = _signatures(events_trace(spark, d)).select("method", "method_sig").distinct()
    kind = F.when(F.col("method") == "click", "Exclude").when(F.col("method") == "error", "Kill").when(F.col("method") == "signup", "Generate")
    return rules.rules_for(every, summaries=rules.read_summaries(spark, at), listed=every.select("method_sig", kind.alias("kind")).where("kind is not null"))


_SUMMARY_SQL = """su AS (SELECT * FROM (VALUES ('error', 'INSTANCE', NULL, '.f', 'CLEAR', NULL, ''), ('purchase', 'RETURN', NULL, '', 'INSTANCE', NULL, '.g'), ('purchase', 'INSTANCE', NULL, '.h', 'PARAM', 0, '.f'), ('view', 'PARAM', 0, '', 'INSTANCE', NULL, '')) v(method, lt, li, lp, rt, ri, rp)),
  sm AS (SELECT DISTINCT g.method_sig, su.lt, su.li, su.lp, su.rt, su.ri, su.rp FROM g JOIN su USING (method) WHERE g.k % 4 > 0),
  rr AS (SELECT * FROM sm UNION ALL SELECT method_sig, lt, li, '', rt, ri, '' FROM r WHERE method_sig NOT IN (SELECT method_sig FROM sm)),
  cl AS (SELECT pos, method_sig, 'o' || (k % 5) AS base, CASE WHEN kind = 'assign' THEN 'r' || (k % 6) END AS ret, ['v' || (k % 10), '7', 'w' || (k % 3)] AS names FROM g),
  a AS (SELECT cl.pos, rr.lt, rr.rt, CASE rr.lt WHEN 'PARAM' THEN names[li + 1] WHEN 'RETURN' THEN ret ELSE base END || lp AS l, CASE WHEN rr.rt = 'PARAM' AND ri <> 1 THEN names[ri + 1] || rp WHEN rr.rt = 'INSTANCE' THEN base END AS rr, rr.lt <> 'PARAM' OR li <> 1 AS ok FROM cl JOIN rr USING (method_sig))"""


@query(f"""WITH {EVENTS_SQL}, {SIG_SQL}, {_SUMMARY_SQL} SELECT DISTINCT method_sig, lt AS left_type, CAST(li AS INT) AS left_idx, CASE WHEN lp = '' THEN '' ELSE substr(lp, 2) END AS left_field, rt AS right_type, CAST(ri AS INT) AS right_idx, CASE WHEN rp = '' THEN '' ELSE substr(rp, 2) END AS right_field FROM rr""")
def q_fw_summaries(spark, d):
    """The rules of all methods with summaries, with the fields that they name."""
    field = lambda c: F.element_at(F.split(c, " "), -1)
    return _summarised(spark, d).select("method_sig", "left_type", "left_idx", field("left_path").alias("left_field"), "right_type", "right_idx", field("right_path").alias("right_field")).distinct()


@query(f"""WITH {EVENTS_SQL}, {SIG_SQL}, {_SUMMARY_SQL}, {ASKED_SQL}, gain AS (SELECT q.pos, CASE WHEN rt = 'INSTANCE' AND lt <> 'RETURN' THEN l ELSE l || q.path[len(rr) + 1:] END AS path FROM a JOIN q ON a.pos = q.pos AND starts_with(q.path || '.', rr || '.') WHERE ok AND l IS NOT NULL)
  SELECT pos, path FROM (SELECT * FROM q UNION SELECT * FROM gain) WHERE (pos, path) NOT IN (SELECT pos, l FROM a WHERE rt = 'CLEAR' AND l IS NOT NULL)""")
def q_taint_summaries(spark, d):
    """Tainted paths after calls of methods with summaries: fields are named on both sides."""
    return _dotted(framework.forward_taint(_calls(spark, d), _summarised(spark, d), _asked(spark, d)))


# ---------------------------------------------------------------- small ones


@query("WITH " + EVENTS_SQL + """ SELECT DISTINCT unit_id, method, 'w' || (k % 3) AS receiver, 'java.lang.Object run()' AS target_subsig, 'PRIVILEGED' AS kind FROM t WHERE k % 4 = 0 AND k % 3 <> 0 AND k % 8 = 4""")
def q_privileged_calls(spark, d):
    """Calls of static privileged actions; those of other classes, or on an object, are none."""
    args = F.array(*[F.lit(f"java.lang.Object doPrivileged({a})") for a in instrument.PRIVILEGED])
    t = events_trace(spark, d).where("k % 4 = 0")
    owner = F.when(F.col("k") % 8 == 4, "java.security.AccessController").otherwise("app.T")
    sites = t.select("unit_id", "method", F.get(args, F.col("k") % len(instrument.PRIVILEGED)).alias("called_subsig"), F.lit(None).cast("string").alias("base"), owner.alias("called_class"), F.when(F.col("k") % 3 != 0, F.concat(F.lit("w"), F.col("k") % 3)).alias("first_arg"))
    return instrument.implicit_calls(sites.distinct())


@query("WITH RECURSIVE " + EVENTS_SQL + ", " + DEPS_SQL + """, two AS (SELECT user_id AS trace, max(pos) AS pos FROM t GROUP BY 1 UNION SELECT user_id, max(pos) FROM t WHERE method = 'purchase' GROUP BY 1),
  n AS (SELECT trace, pos FROM two UNION SELECT n.trace, dep.dep_pos FROM n JOIN dep ON dep.trace = n.trace AND dep.pos = n.pos) SELECT trace, pos FROM n""")
def q_slice_again(spark, d):
    """Rows of the slices of the last purchases, then of the last events: the second run follows only what is new."""
    deps = written(_deps(spark, d), "deps")
    last = events_trace(spark, d).where("method = 'purchase'").groupBy(F.col("user_id").alias("trace")).agg(F.max("pos").alias("pos"))
    first = written(slicer.reached_again(deps, last), "reached")
    return slicer.reached_again(deps, _seeds(spark, d), first)
