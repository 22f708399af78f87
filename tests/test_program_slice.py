"""Slices across frames, into callees and libraries, on small hand-made programs."""

import dataclasses

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema

from tracery.operators import dcfg, frames
from tracery.operators.program_slice import APPEND, OBJECT_INIT, Program, listed, methods_of, program_slice
from tracery.operators.slicer import Options
from tracery.plans import walk
from tracery.plans.scratch import written
from tracery.sources import rules


def local(spark, rows, schema):
    """A table that the planner holds itself, so that small programs are quick."""
    kinds = spark.createDataFrame([], schema).schema
    columns = [[r[k] for r in rows] for k in range(len(kinds))]
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(kinds), strict=True)], names=kinds.names), kinds)


ARG = "array<struct<name:string,type:string,is_constant:boolean>>"


def program(spark, statements, params, doms=(), calls=None, listed=None):
    """``statements``: method, kind, called, defs [(kind, base)], uses, args, receiver, returned variable; a row each."""
    rows, defs, uses, args, receivers = [], [], [], [], []
    for i, (method, kind, called, d, u, a, r, ret) in enumerate(statements):
        rows.append((i, i, 0, method, method, "K", method, True, called, called, "K" if called else None, kind, not kind.startswith("return"), called, ret, "T" if ret else None, True))
        defs += [(i, k, b) for k, b in d]
        uses += [(i, x.split(".") if x else [], False) for x in (u or [""])]
        args += [(i, k, x) for k, x in enumerate(a)]
        receivers += [(i, r)] if r else []
    stmts = local(spark, rows, "pos long, unit_id long, thread_id long, method string, subsig string, class string, name string, is_app boolean, called_sig string, called_subsig string, called_class string, kind string, falls_through boolean, called_name string, ret_var string, ret_type string, is_static boolean")
    edges = written(dcfg.build(stmts))
    ids = written(frames.frame_ids(stmts, edges))
    listed = None if listed is None else rules.model_rules(local(spark, listed, "method_sig string, kind string"))
    return Program(
        stmts, ids, frames.frame_table(stmts, ids, edges), edges, local(spark, defs, "unit_id long, def_kind string, base string"), local(spark, uses, "unit_id long, path array<string>, is_static boolean"),
        local(spark, args, "unit_id long, idx int, arg string"), local(spark, params, "method string, idx int, local string"), local(spark, receivers, "unit_id long, base string"),
        local(spark, list(doms), "pos long, dom_pos long"), None if calls is None else local(spark, calls, f"pos long, method_sig string, base string, ret string, args {ARG}"), listed,
    )


def sliced(spark, p, pos, path=None, options=Options(), lines=None):
    out = program_slice(p, spark.createDataFrame([(0, pos, path)], "trace long, pos long, path string"), options, lines).collect()
    return sorted({(r.dep_pos, r.dep_path) for r in out}), sorted({(r.dep_pos, r.pos, r.type) for r in out})


def test_worked_example(spark):
    text = [("main", "assign", None, [("local", "a")], [], [], None, None), ("main", "assign", None, [("local", "b")], [], [], None, None), ("main", "if", None, [], ["a", "b"], [], None, None), ("main", "assign", None, [("local", "c")], ["a"], [], None, None), ("main", "other", None, [], ["c"], [], None, None)]
    p = program(spark, text, [], doms=[(3, 2)])
    items, edges = sliced(spark, p, 4, "c")
    assert items == [(0, ""), (1, ""), (2, "a"), (2, "b"), (3, "a"), (4, "c")]
    assert edges == [(0, 2, "data"), (0, 3, "data"), (1, 2, "data"), (2, 3, "control"), (3, 4, "data"), (4, 4, "data")]
    assert {d for d, _ in sliced(spark, p, 4, None, Options(data_only=True))[0]} == {0, 3, 4}
    assert {d for d, _ in sliced(spark, p, 3, None, Options(control_only=True))[0]} == {2, 3}
    lines = spark.createDataFrame([(i, i if i < 3 else 3) for i in range(5)], "pos long, line long")
    assert {d for d, _ in sliced(spark, p, 4, "c", Options(once=True), lines)[0]} == {0, 2, 3, 4}


CALL = [
    ("main", "assign", None, [("local", "a")], [], [], None, None),
    ("main", "assign", "f", [("local", "b")], ["a"], ["a"], None, None),
    ("f", "assign", None, [("local", "x")], ["p"], [], None, None),
    ("f", "return", None, [], ["x"], [], None, "x"),
    ("main", "other", None, [], ["b"], [], None, None),
    ("main", "return_void", None, [], [], [], None, None),
]


def test_call_and_return(spark):
    items, edges = sliced(spark, program(spark, CALL, [("f", 0, "p")]), 4, "b")
    # the call gives its returned variable; the parameter leads back to the argument
    assert items == [(0, ""), (1, ""), (2, "p"), (3, "x"), (4, "b")]
    assert (3, 4, "data") in edges and (0, 2, "data") in edges and (1, 3, "control") in edges


def test_callee_writes_into_its_argument(spark):
    text = [
        ("main", "assign", None, [("local", "o")], [], [], None, None),
        ("main", "invoke", "g", [], ["o"], ["o"], None, None),
        ("g", "assign", None, [("field", "q")], ["k"], [], None, None),
        ("g", "return_void", None, [], [], [], None, None),
        ("main", "assign", None, [("field", "o")], ["z"], [], None, None),
        ("main", "other", None, [], ["o"], [], None, None),
        ("main", "return_void", None, [], [], [], None, None),
    ]
    items, _ = sliced(spark, program(spark, text, [("g", 0, "q")]), 5, "o")
    positions = {d for d, _ in items}
    assert positions == {0, 1, 2, 4, 5}
    assert (4, "z") in items and (4, "o") in items and (2, "k") in items


def test_two_levels_up_and_down(spark):
    text = [
        ("main", "assign", None, [("local", "a")], [], [], None, None),
        ("main", "assign", "f", [("local", "r")], ["a"], ["a"], None, None),
        ("f", "assign", "h", [("local", "y")], ["p"], ["p"], None, None),
        ("h", "assign", None, [("local", "w")], ["t"], [], None, None),
        ("h", "return", None, [], ["w"], [], None, "w"),
        ("f", "return", None, [], ["y"], [], None, "y"),
        ("main", "other", None, [], ["r"], [], None, None),
        ("main", "return_void", None, [], [], [], None, None),
    ]
    items, _ = sliced(spark, program(spark, text, [("f", 0, "p"), ("h", 0, "t")]), 6, "r", Options(data_only=True))
    assert {d for d, _ in items} == {0, 3, 4, 5, 6}


@pytest.mark.parametrize("kind, found", [("Generate", {0, 1, 2, 3}), ("Exclude", {1, 2, 3}), (None, {1, 3})])
def test_library_call(spark, kind, found):
    """``l.add(v)`` defines l as its rules say; without rules it defines nothing."""
    text = [
        ("main", "assign", None, [("local", "v")], [], [], None, None),
        ("main", "assign", None, [("local", "l")], [], [], None, None),
        ("main", "invoke", "<L: boolean add(O)>", [], ["l"], ["l", "v"], "l", None),
        ("main", "other", None, [], ["l"], [], None, None),
        ("main", "return_void", None, [], [], [], None, None),
    ]
    sig = "<L: boolean add(O)>"
    calls = None if kind is None else [(2, sig, "l", None, [("v", "O", False)])]
    p = program(spark, text, [], calls=calls, listed=None if kind is None else [(sig, kind)])
    items, _ = sliced(spark, p, 3, "l", Options(data_only=True))
    assert {d for d, _ in items} == found


def test_several_criteria(spark):
    p = program(spark, CALL, [("f", 0, "p")])
    out = program_slice(p, spark.createDataFrame([(7, 4, "b"), (8, 2, None)], "trace long, pos long, path string")).collect()
    assert {r.dep_pos for r in out if r.trace == 7} == {0, 1, 2, 3, 4} and {r.dep_pos for r in out if r.trace == 8} == {0, 1, 2}


def test_library_call_on_what_was_loaded(spark):
    """``x = r.f`` and then ``x.add(v)`` define r, through v; a call that comes later, or on another local, does not."""
    sig = "<L: boolean add(O)>"
    text = [
        ("main", "assign", None, [("local", "v")], [], [], None, None),
        ("main", "assign", None, [("local", "r")], [], [], None, None),
        ("main", "assign", None, [("local", "x")], ["r.f"], [], None, None),
        ("main", "invoke", sig, [], ["x", "v"], ["x", "v"], "x", None),
        ("main", "assign", None, [("local", "w")], [], [], None, None),
        ("main", "assign", None, [("local", "y")], ["r.g"], [], None, None),
        ("main", "assign", None, [("local", "z")], [], [], None, None),
        ("main", "invoke", sig, [], ["y", "w"], ["y", "w"], "y", None),
        ("main", "other", None, [], ["r"], [], None, None),
        ("main", "return_void", None, [], [], [], None, None),
    ]
    calls = [(3, sig, "x", None, [("v", "O", False)]), (7, sig, "y", None, [("w", "O", False)])]
    p = program(spark, text, [], calls=calls, listed=[(sig, "Generate")])
    assert {d for d, _ in sliced(spark, p, 8, "r", Options(data_only=True))[0]} == {1, 8}
    p = dataclasses.replace(p, loads=local(spark, [(2, "r", "x"), (5, "r", "y")], "unit_id long, base string, local string"))
    assert {d for d, _ in sliced(spark, p, 8, "r", Options(data_only=True))[0]} == {0, 1, 2, 3, 8}


def test_text_of_an_appended_object(spark):
    """What append(Object) is given is defined by the ``toString()`` that it runs: its return and the call."""
    text = [
        ("main", "assign", None, [("local", "o")], [], [], None, None),
        ("main", "invoke", APPEND, [], ["s", "o"], ["s", "o"], "s", None),
        ("toString", "assign", None, [("local", "q")], ["this.f"], [], None, None),
        ("toString", "return", None, [], ["q"], [], None, "q"),
        ("main", "other", None, [], ["o"], [], None, None),
        ("main", "return_void", None, [], [], [], None, None),
    ]
    p = program(spark, text, [("toString", 1, "this")])
    edges = written(p.edges.where("dst <> 2").unionByName(spark.createDataFrame([(1, 2, "CALL_EDGE")], "src long, dst long, type string")))
    ids = written(frames.frame_ids(p.stmts, edges))
    p = dataclasses.replace(p, edges=edges, ids=ids, frames=frames.frame_table(p.stmts, ids, edges))
    items, _ = sliced(spark, p, 4, "o", Options(data_only=True))
    assert {(1, "o"), (1, "s"), (3, "q")} <= set(items) and {d for d, _ in items} == {0, 1, 2, 3, 4}


def test_made_object_and_array(spark):
    """A constructor's row is asked for the object again; an element written adds to the array."""
    text = [
        ("main", "assign", None, [("local", "a")], [], [], None, None),
        ("main", "assign", None, [("array", "a")], ["i"], [], None, None),
        ("main", "invoke", OBJECT_INIT, [], ["v"], ["a", "v"], "a", None),
        ("main", "other", None, [], ["a"], [], None, None),
        ("main", "return_void", None, [], [], [], None, None),
    ]
    p = program(spark, text, [], calls=[(2, OBJECT_INIT, "a", None, [("v", "O", False)])], listed=[(OBJECT_INIT, "Generate")])
    rule = [(OBJECT_INIT, "Summary", "INSTANCE", None, "", "PARAM", 0, "")]
    p = dataclasses.replace(p, rules=local(spark, rule, "method_sig string, kind string, left_type string, left_idx int, left_path string, right_type string, right_idx int, right_path string"))
    items, _ = sliced(spark, p, 3, "a", Options(data_only=True))
    assert {(0, ""), (1, "i"), (2, "v"), (2, "a"), (3, "a")} <= set(items)


def test_parameter_with_two_arguments(spark):
    text = [
        ("main", "assign", None, [("local", "a")], [], [], None, None),
        ("main", "assign", "f", [("local", "b")], ["a", "c"], ["a", "c"], None, None),
        ("f", "return", None, [], ["p"], [], None, "p"),
        ("main", "other", None, [], ["b"], [], None, None),
        ("main", "return_void", None, [], [], [], None, None),
    ]
    with pytest.raises(ValueError, match="more than one argument"):
        sliced(spark, program(spark, text, [("f", 0, "p"), ("f", 1, "p")]), 3, "b")


def test_recursion(spark, depth=60):
    """Each level writes a field of its parameter after its call: all of them define what the first was given."""
    text = [("main", "assign", None, [("local", "o")], [], [], None, None), ("main", "invoke", "f", [], ["o"], ["o"], None, None)]
    down = [("f", "invoke", "f", [], ["p"], ["p"], None, None)] * depth
    rows, ids, table = text + down, [0, 0], []
    n = len(rows) + depth
    text = rows + [("f", "assign", None, [("field", "p")], [f"k{i}"], [], None, None) for i in range(depth)] + [("main", "other", None, [], ["o"], [], None, None)]
    # frame i has the row of its call to the next and, on the way back, the row that writes
    ids = [(0, 0), (1, 0)] + [(2 + i, 2 + i) for i in range(depth)] + [(n - 1 - i, 2 + i) for i in range(depth)] + [(n, 0)]
    table = [(0, "main", 0, 0, n)] + [(2 + i, "f", 2 + i, 1 + i, n - 1 - i) for i in range(depth)]
    p = program(spark, text[:2] + [text[-1]], [("f", 0, "p")])
    stmts = [(i, i, 0, m, m, "K", m, True, c, c, "K" if c else None, k, True, c, None, None, True) for i, (m, k, c, *_) in enumerate(text)]
    p = dataclasses.replace(
        p, stmts=local(spark, stmts, p.stmts._jdf.schema().toDDL()), ids=local(spark, ids, "pos long, frame_id long"),
        frames=local(spark, table, "frame_id long, method string, first_pos long, caller_pos long, last_pos long"),
        edges=local(spark, [(1 + i, 2 + i, "CALL_EDGE") for i in range(depth)], "src long, dst long, type string"),
        defs=local(spark, [(i, k, b) for i, (_, _, _, d, *_) in enumerate(text) for k, b in d], "unit_id long, def_kind string, base string"),
        uses=local(spark, [(i, [x], False) for i, (_, _, _, _, u, *_) in enumerate(text) for x in u], "unit_id long, path array<string>, is_static boolean"),
        args=local(spark, [(i, 0, a[0]) for i, (_, _, _, _, _, a, *_) in enumerate(text) if a], "unit_id long, idx int, arg string"),
    )
    rounds = []
    plain = walk.written
    try:
        walk.written = lambda df, name="part": (rounds.append(name), plain(df, name))[1]
        items, _ = sliced(spark, p, n, "o", Options(data_only=True))
    finally:
        walk.written = plain
    assert {(n - 1 - i, f"k{depth - 1 - i}") for i in range(depth)} <= set(items)
    assert rounds.count("walked") <= 8


def test_call_as_criterion_methods_and_list(spark):
    """A call asked for as a whole enters its frame; rows that nothing controls name the call of their method; bare returns are not listed."""
    p = program(spark, CALL, [("f", 0, "p")], doms=[])
    out = written(program_slice(p, spark.createDataFrame([(0, 1, None)], "trace long, pos long, path string")))
    assert {(r.pos, r.path, r.dep_pos, r.dep_path) for r in out.collect()} >= {(1, "a", 3, "x"), (1, "a", 0, "")}
    assert {(r.pos, r.caller_pos) for r in methods_of(p, out).collect()} == {(2, 1), (3, 1)}
    extra = out.union(spark.createDataFrame([(0, 4, "b", 5, "", "data")], out.schema))
    assert listed(extra, p.stmts).count() == out.count()
