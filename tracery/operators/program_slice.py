"""Slices of programs: data flow within frames, into callees, back to callers, through libraries, and control flow.

The dependences of all items (row, path) are computed as relations, then a slice is
walked back through buckets of positions.  What a callee defines of an argument, and
what a caller defines of a parameter, are nodes of a graph of their own: a node is one
name at one end of one frame.  The graph is walked back once, from every node that an
item leads to, so recursion takes rounds by the buckets it goes through, not by depth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracery.operators import framework
from tracery.operators.dcfg import FLOW, is_library
from tracery.operators.frames import called_frames, library_calls
from tracery.operators.slicer import Options
from tracery.plans.ordered import running_total
from tracery.plans.scratch import written
from tracery.plans.walk import BUCKET, walk_back

#: A slice is not followed through this field; the call that runs an object's ``toString()``; the constructor of all objects.
STOP_FIELD = "mContext"
APPEND = "<java.lang.StringBuilder: java.lang.StringBuilder append(java.lang.Object)>"
OBJECT_INIT = "<java.lang.Object: void <init>()>"


@dataclass(frozen=True)
class Program:
    """The relations of a traced program.

    stmts: pos, unit_id, method, kind, called_sig, called_name, ret_var, ret_type, name,
    class, is_static (of the method); ids: pos, frame_id; frames: frame_id, method,
    caller_pos, last_pos; edges: src, dst, type; defs: unit_id, def_kind (local, field,
    array), base; uses: unit_id, path (array), from ``defuse.use_paths``; args: unit_id,
    idx, arg, the receiver as argument 0 where there is one; params: method, idx, local;
    receivers: unit_id, base; doms: pos, dom_pos; calls and rules: see
    ``tracery.operators.framework`` (None: library calls define nothing); loads: unit_id,
    base, local of the statements that read a field of the base into the local (None: no
    library call defines what was loaded).
    """

    stmts: DataFrame
    ids: DataFrame
    frames: DataFrame
    edges: DataFrame
    defs: DataFrame
    uses: DataFrame
    args: DataFrame
    params: DataFrame
    receivers: DataFrame
    doms: DataFrame
    calls: DataFrame | None = None
    rules: DataFrame | None = None
    loads: DataFrame | None = None


def _located(p: Program) -> DataFrame:
    return p.stmts.join(p.ids, "pos")


def _bindings(p: Program) -> DataFrame:
    """(call_pos, frame_id, base, callee, param, end): arguments at traced calls with the callee's frame, its name for them and its end."""
    rows = _located(p).select(F.col("pos").alias("call_pos"), "frame_id", "unit_id")
    target = p.frames.where("caller_pos <> first_pos").select(F.col("caller_pos").alias("call_pos"), F.col("frame_id").alias("callee"), "method", (F.col("last_pos") + 1).alias("end"))
    bound = rows.join(target, "call_pos").join(p.args, "unit_id").join(p.params, ["method", "idx"])
    bound = written(bound.select("call_pos", "frame_id", F.col("arg").alias("base"), "callee", F.col("local").alias("param"), "end").distinct(), "bound")
    several = bound.groupBy("callee", "param").agg(F.countDistinct("base").alias("n")).where("n > 1").limit(1).collect()
    if several:
        raise ValueError(f"parameter {several[0]['param']} of frame {several[0]['callee']} has more than one argument at its caller")
    return bound


def _roles(p: Program, library: DataFrame | None) -> DataFrame:
    """(frame_id, base, pos, kill, def_pos, via): rows that define or add to a base, under the name ``via`` at the defining row.

    A row defines its local, and adds to the base of a field or array that it writes and
    to the receiver of a traced call.  A library call adds to what its rules' left sides
    name; if it comes right after a row that loads a field into such a name, it adds to
    the base of the field at that row.
    """
    rows = _located(p).select("frame_id", "pos", "unit_id", "kind", "called_sig")
    columns = ["frame_id", "base", "pos", "kill", "def_pos", "via"]
    adds = lambda df: df.select("frame_id", "base", "pos", F.lit(False).alias("kill"), F.col("pos").alias("def_pos"), F.col("base").alias("via"))
    own = rows.join(p.defs, "unit_id").select("frame_id", "base", "pos", (F.col("def_kind") == "local").alias("kill"), F.col("pos").alias("def_pos"), F.col("base").alias("via"))
    traced = rows.where("kind = 'invoke' and called_sig is not null").join(library_calls(p.stmts, p.edges).select("pos"), "pos", "left_anti")
    out = own.union(adds(traced.join(p.receivers, "unit_id")))
    if library is not None:
        left = library.select("pos", F.get("left", F.lit(0)).alias("base")).distinct()
        out = out.union(adds(rows.join(left, "pos")))
        if p.loads is not None:
            after = p.edges.where(F.col("type") == FLOW).select(F.col("src").alias("pos"), F.col("dst").alias("def_pos"))
            loaded = rows.join(p.loads, "unit_id").select("frame_id", "pos", "base", F.col("local").alias("via")).join(after, "pos")
            defined = left.select(F.col("pos").alias("def_pos"), F.col("base").alias("via"))
            out = out.union(loaded.join(defined, ["def_pos", "via"]).withColumn("kill", F.lit(False)).select(*columns))
    return out.distinct()


def _reaching(roles: DataFrame, asks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For ``asks(frame_id, base, pos)``: what ``roles`` have in ``role`` since the last kill, and the asks that no kill ends."""
    each = roles.groupBy("frame_id", "base", "pos").agg(F.max("kill").alias("kill"), F.collect_set("role").alias("role_list"))
    asked = asks.select("frame_id", "base", "pos").distinct().withColumn("ask", F.lit(True))
    both = each.join(asked, ["frame_id", "base", "pos"], "full")
    both = both.select("frame_id", "base", "pos", F.coalesce("kill", F.lit(False)).alias("kill"), "role_list", F.coalesce("ask", F.lit(False)).alias("ask"))
    parts = running_total(both, "pos", {"seg": F.col("kill").cast("int")}, ["frame_id", "base"])
    use = parts.where("ask").select("frame_id", "base", "pos", (F.col("seg") - F.col("kill").cast("int")).alias("seg"))
    add = parts.where("role_list is not null").select("frame_id", "base", F.col("pos").alias("at"), "seg", "role_list")
    found = use.join(add, ["frame_id", "base", "seg"]).where("at < pos").select("frame_id", "base", "pos", F.explode("role_list").alias("role"))
    return found.distinct(), use.where("seg = 0").select("frame_id", "base", "pos")


#: Items of the graph of names: a definition, a name at a row of its frame, a name at the end of a called frame.
_DEFINED, _AT, _END = "=", "@", "$"


def _definitions(p: Program, roles: DataFrame, bound: DataFrame, asks: DataFrame, size: int) -> DataFrame:
    """(pos, path, via, def_pos): the definitions of each asked name, its own frame's, its callees' and, if its frame never kills it, its callers'."""
    mark = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    own = roles.select("frame_id", "base", "pos", "kill", F.struct(F.col("def_pos").alias("to"), mark(_DEFINED, "via").alias("item")).alias("role"))
    inner = bound.select("frame_id", "base", F.col("call_pos").alias("pos"), F.lit(False).alias("kill"), F.struct(F.col("end").alias("to"), mark(_END, "param").alias("item")).alias("role"))
    at_calls = bound.select("frame_id", "base", F.col("call_pos").alias("pos"))
    ends = bound.select(F.col("callee").alias("frame_id"), F.col("param").alias("base"), F.col("end").alias("pos"), F.lit(_END).alias("at")).distinct()
    here = asks.select("frame_id", "base", "pos").union(at_calls).distinct().withColumn("at", F.lit(_AT))
    every = written(here.union(ends), "asks")
    found, open_ = _reaching(own.union(inner), every)
    steps = every.join(found, ["frame_id", "base", "pos"]).select("pos", F.concat("at", "base").alias("path"), F.col("role.to").alias("dep_pos"), F.col("role.item").alias("dep_path"))
    # what a frame does not kill is looked for at its caller too, under the argument's name
    up = bound.select(F.col("callee").alias("frame_id"), F.col("param").alias("base"), F.col("call_pos").alias("dep_pos"), mark(_AT, "base").alias("dep_path"))
    above = here.join(open_, ["frame_id", "base", "pos"]).join(up, ["frame_id", "base"]).select("pos", F.concat("at", "base").alias("path"), "dep_pos", "dep_path")
    # a frame that runs for append(Object) returns to it, whatever name is asked for
    calls = p.stmts.where(F.col("called_sig") == APPEND).select(F.col("pos").alias("caller_pos"))
    printed = p.frames.where("caller_pos <> first_pos").join(calls, "caller_pos").select("frame_id", "caller_pos")
    back = _located(p).where(F.col("kind").isin("return", "return_void")).join(printed, "frame_id").select("frame_id", F.explode(F.array("pos", "caller_pos")).alias("dep_pos"))
    text = ends.join(back, "frame_id").select("pos", F.concat("at", "base").alias("path"), "dep_pos", mark(_DEFINED, "base").alias("dep_path"))
    steps = written(steps.unionByName(above).unionByName(text).distinct(), "steps")
    wanted = asks.select("pos", F.concat(F.lit(_AT), F.col("base")).alias("path")).distinct()
    first = written(wanted.join(steps, ["pos", "path"]), "first")
    final = lambda c: F.substring(c, 1, 1) == _DEFINED
    far = first.where(~final("dep_path")).select("dep_pos", "dep_path").distinct()
    key = F.concat_ws(" ", "dep_pos", "dep_path")
    reached = walk_back(steps, far.select(key.alias("trace"), F.col("dep_pos").alias("pos"), F.col("dep_path").alias("path")), size)
    beyond = reached.where(final("path")).select("trace", F.col("pos").alias("def_pos"), F.col("path").alias("item"))
    near = first.where(final("dep_path")).select("pos", "path", F.col("dep_pos").alias("def_pos"), F.col("dep_path").alias("item"))
    more = first.where(~final("dep_path")).select("pos", "path", key.alias("trace")).join(beyond, "trace").select("pos", "path", "def_pos", "item")
    out = near.union(more).distinct()
    return out.select("pos", F.expr("substring(path, 2)").alias("path"), F.expr("substring(item, 2)").alias("via"), "def_pos")


def _returns(p: Program) -> DataFrame:
    return called_frames(p.stmts, p.edges, p.frames)


def _shown(p: Program) -> DataFrame:
    """(pos, frame_id, path, n): what each row uses, as text, and of how many names the path is."""
    return _located(p).join(p.uses, "unit_id").select("pos", "frame_id", F.concat_ws(".", "path").alias("path"), F.size("path").alias("n"))


def _called_by(p: Program) -> DataFrame:
    """(pos, caller_pos) of the rows that no earlier row controls and whose frame was called by the name of its method."""
    rows = _located(p).join(p.doms.where("dom_pos < pos").select("pos"), "pos", "left_anti")
    heads = rows.join(p.frames.select("frame_id", "caller_pos"), "frame_id").where("caller_pos < pos").select("pos", "name", "caller_pos")
    callers = p.stmts.where("called_sig is not null").select(F.col("pos").alias("caller_pos"), F.col("called_name").alias("called"))
    return heads.join(callers, "caller_pos").where("called = name").select("pos", "caller_pos")


def item_dependences(p: Program, options: Options = Options(), criteria: DataFrame | None = None, library_classes: bool = True, size: int = BUCKET) -> DataFrame:
    """(pos, path, dep_pos, dep_path, type) between items; ``path`` is null for what holds for all paths of a row.

    Data dependences start at paths without fields.  ``criteria(pos, path)`` adds items
    that are asked for though their row does not use them.  Items are strings: a path
    with dots, empty for a row that uses nothing.  Items of the support library's rows
    (``library_classes``) and of the stop field have no dependences.  A parameter that
    has several arguments at one call is an error.
    """
    rows = _located(p)
    uses = _shown(p)
    shown = uses.select(F.col("pos").alias("dep_pos"), F.col("path").alias("dep_path")).distinct()
    returns = written(_returns(p), "returns")
    library = None
    if p.calls is not None:
        own = library_calls(p.stmts, p.edges).select("pos")
        library = written(framework.applied(p.calls.join(own, "pos", "left_semi"), p.rules).where("left is not null"), "library")
    parts = []
    if not options.control_only:
        bound = _bindings(p)
        roles = written(_roles(p, library), "roles")
        asks = uses.where("n = 1").select("frame_id", F.col("path").alias("base"), "pos")
        back = returns.where("ret_var is not null").select(F.col("ret_pos").alias("pos"), F.col("ret_var").alias("base")).join(p.ids, "pos").select("frame_id", "base", "pos")
        asks = asks.union(back).union(roles.where("not kill").select("frame_id", "base", "pos"))
        if criteria is not None:
            asks = asks.union(criteria.where(~F.col("path").contains(".") & (F.col("path") != "")).join(p.ids, "pos").select("frame_id", F.col("path").alias("base"), "pos"))
        # ``via`` is the name that the definition was found by
        data = written(_definitions(p, roles, bound, asks, size), "data")
        given = returns.select(F.col("call_pos").alias("def_pos"), F.col("ret_pos").alias("dep_pos"), F.coalesce("ret_var", F.lit("")).alias("dep_path"))
        by_return = data.join(given, "def_pos").select("pos", "path", "dep_pos", "dep_path")
        plain = written(data.join(given.select("def_pos"), "def_pos", "left_anti"), "plain")
        by_use = plain.join(shown.withColumnRenamed("dep_pos", "def_pos"), "def_pos").select("pos", "path", F.col("def_pos").alias("dep_pos"), "dep_path")
        # a row that writes a field of the name, or makes the object, is asked for the name again
        fields = rows.join(p.defs.where("def_kind = 'field'"), "unit_id").select(F.col("pos").alias("def_pos"), F.col("base").alias("path"))
        made = rows.where(F.col("called_sig") == OBJECT_INIT).join(p.receivers, "unit_id").select(F.col("pos").alias("def_pos"), F.col("base").alias("path"))
        again = plain.join(fields.union(made).distinct(), ["def_pos", "path"]).select("pos", "path", F.col("def_pos").alias("dep_pos"), F.col("path").alias("dep_path"))
        parts += [by_return, by_use, again]
        if library is not None:
            used = library.where("size(right) > 0").select(F.col("pos").alias("def_pos"), F.get("left", F.lit(0)).alias("via"), F.concat_ws(".", "right").alias("dep_path")).distinct()
            parts.append(plain.join(used, ["def_pos", "via"]).select("pos", "path", F.col("def_pos").alias("dep_pos"), "dep_path"))
        parts = [x.withColumn("type", F.lit("data")) for x in parts]
    if not options.data_only:
        nothing = F.lit(None).cast("string").alias("path")
        doms = p.doms.where("dom_pos < pos")
        by_dom = doms.join(shown.withColumnRenamed("dep_pos", "dom_pos"), "dom_pos").select("pos", nothing, F.col("dom_pos").alias("dep_pos"), "dep_path", F.lit("control").alias("type"))
        by_call = _called_by(p).select("pos", nothing, F.col("caller_pos").alias("dep_pos"), F.lit("").alias("dep_path"), F.lit("control").alias("type"))
        parts += [by_dom, by_call]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    out = out.where("dep_pos < pos")
    if library_classes:
        # nothing is followed from rows of the support library, nor from the stop field
        stop = p.stmts.where(is_library(F.col("class"))).select("pos")
        out = out.join(stop, "pos", "left_anti")
    return out.where(F.col("path").isNull() | ~F.col("path").endswith("." + STOP_FIELD)).distinct()


def program_slice(p: Program, criteria: DataFrame, options: Options = Options(), lines: DataFrame | None = None, size: int = BUCKET) -> DataFrame:
    """(trace, pos, path, dep_pos, dep_path, type): the slice of each ``criteria(trace, pos, path)`` row.

    Each criterion is followed on its own, and only through the buckets of ``size``
    positions that it comes to.  A null path stands for all paths its row uses; if its
    row calls a traced frame, the row that returns from it is asked for what it uses too.
    ``options.once`` needs ``lines(pos, line)``.  A criterion has an edge to itself.
    """
    uses = _shown(p).select("pos", F.col("path").alias("used"))
    whole = criteria.where("path is null").join(_returns(p).select(F.col("call_pos").alias("pos"), "ret_pos"), "pos").select("trace", "pos", "ret_pos")
    entered = whole.join(uses.withColumnsRenamed({"pos": "ret_pos", "used": "dep_path"}), "ret_pos").join(uses, "pos").select("trace", "pos", F.col("used").alias("path"), F.col("ret_pos").alias("dep_pos"), "dep_path", F.lit("data").alias("type"))
    entered = written(entered.distinct(), "entered")
    seeds = criteria.join(uses, "pos", "left").select("trace", "pos", F.coalesce("path", "used", F.lit("")).alias("path")).distinct()
    seeds = written(seeds, "seeds")
    starts = seeds.union(entered.select("trace", F.col("dep_pos").alias("pos"), F.col("dep_path").alias("path"))).distinct()
    deps = item_dependences(p, options, starts.select("pos", "path"), size=size)
    if options.once:
        # which rows may be followed differs from criterion to criterion
        deps = written(deps, "items")
        at = seeds.join(lines, "pos").select("trace", F.col("line").alias("l")).distinct()
        same = lines.join(at, F.col("line") == F.col("l")).select("trace", "pos").distinct()
        rows = deps.join(same, "pos")
        last = rows.where("type = 'data'").groupBy("trace", "pos", "path").agg(F.max("dep_pos").alias("dep_pos"))
        deps = rows.where("type <> 'data'").unionByName(rows.where("type = 'data'").join(last, ["trace", "pos", "path", "dep_pos"], "left_semi"))
    rows = written(deps, "items")
    items = walk_back(rows, starts, size)
    own = [c for c in ("trace",) if c in rows.columns]
    columns = ["trace", "pos", "path", "dep_pos", "dep_path", "type"]
    by_path = rows.where("path is not null").join(items, [*own, "pos", "path"]).select(*columns)
    by_row = rows.where("path is null").join(items.select("trace", "pos").distinct(), [*own, "pos"]).select(*columns)
    first = seeds.where("trace is not null and pos is not null").select("trace", "pos", "path", F.col("pos").alias("dep_pos"), F.col("path").alias("dep_path"), F.lit("data").alias("type"))
    return by_path.union(by_row).union(first).union(entered.select(*columns)).distinct()


def methods_of(p: Program, edges: DataFrame) -> DataFrame:
    """(trace, pos, caller_pos): for each row of a slice that no row controls, the call that its method was entered by."""
    nodes = edges.select("trace", "pos").union(edges.select("trace", F.col("dep_pos").alias("pos"))).distinct()
    return nodes.join(_called_by(p), "pos").select("trace", "pos", "caller_pos")


def listed(edges: DataFrame, stmts: DataFrame) -> DataFrame:
    """The edges that a slice lists: those to rows that return nothing are in its graph only."""
    return edges.join(stmts.where("kind = 'return_void'").select(F.col("pos").alias("dep_pos")), "dep_pos", "left_anti").select(*edges.columns)
