"""Graph building, frames, slicing and the ordered windows, against plain Python."""

import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracery.operators import control, dcfg, defuse, frames, scope, slicer
from tracery.plans import closure, walk
from tracery.plans.ordered import fits, last_before, numbered, previous, running_max, running_total
from tracery.plans.scratch import written


@pytest.mark.parametrize("size", [1, 3, 1 << 17])
def test_ordered_windows(spark, size):
    rng = random.Random(size)
    rows = [(p, rng.choice(["a", "b", None]), rng.choice([None, p])) for p in sorted(rng.sample(range(100), 40))]
    df = spark.createDataFrame(rows, "pos long, g string, v long")
    plain = Window.partitionBy("g").orderBy("pos")
    want = df.select("pos", F.last("v", True).over(plain.rowsBetween(Window.unboundedPreceding, -1)), F.lag("pos").over(plain), F.lead("pos").over(plain), F.sum("v").over(plain))
    out = last_before(df, "pos", {"lb": F.col("v")}, ["g"], size)
    out = previous(previous(out, "pos", {"pp": "pos"}, ["g"], size), "pos", {"np": "pos"}, ["g"], size, forward=True)
    out = running_total(out, "pos", {"rt": F.col("v")}, ["g"], size)
    peak = [r.m for r in running_max(df, "pos", {"m": -F.col("v")}, ["g"], size).orderBy("pos").collect()]
    assert peak == [r.m for r in df.select("pos", F.max(-F.col("v")).over(plain).alias("m")).orderBy("pos").collect()]
    got = [(r.pos, r.lb, r.pp, r.np, r.rt) for r in out.orderBy("pos").collect()]
    assert got == [(a, b, c, d, e or 0) for a, b, c, d, e in want.orderBy("pos").collect()]
    n = numbered(df, "n", ["pos", "g"], size).orderBy("pos").collect()
    assert [r.n for r in n] == list(range(40))


def test_closures(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    assert sorted(r.node for r in closure.reachable(edges, spark.createDataFrame([(2,), (None,)], "node long")).collect()) == [1, 2, 3]
    links = [(i, i - 1 if i % 50 else None) for i in range(300)]
    got = {r.node: r.head for r in closure.heads(spark.createDataFrame(links, "node long, up long")).collect()}
    assert got == {i: i - i % 50 for i in range(300)}


def trace(rng, n, threads=2):
    methods = ["A", "B", "C"]
    rows = []
    for pos in range(n):
        kind = rng.choice(["assign", "assign", "invoke", "return", "goto", "if"])
        called = rng.choice(methods) if kind == "invoke" else None
        m = rng.choice(methods)
        rows.append(dict(pos=pos, thread_id=rng.randrange(threads), method=m, subsig=m, **{"class": "K" + m}, name=rng.choice(["x", "<clinit>"]) if m == "C" else "x", is_app=m != "B" or rng.random() < 0.5, called_sig=called, called_subsig=called, called_class="K" + called if called else None, kind=kind, falls_through=kind not in ("goto", "return")))
    return rows


SCHEMA = "pos long, thread_id long, method string, subsig string, class string, name string, is_app boolean, called_sig string, called_subsig string, called_class string, kind string, falls_through boolean"


def scanned_links(rows, edges):
    """The literal rule: from last to first, each orphan scans back."""
    has_flow = {s for s, _, t in edges if t == dcfg.FLOW}
    linked = {d for _, d, _ in edges}
    out = []
    for thread in {r["thread_id"] for r in rows}:
        own = [r for r in rows if r["thread_id"] == thread]
        for i in range(len(own) - 1, -1, -1):
            a = own[i]
            if a["pos"] in linked:
                continue
            for j in range(i - 1, -1, -1):
                b = own[j]
                if b["method"] == a["method"] and b["kind"] != "return" and b["pos"] not in has_flow:
                    out.append((b["pos"], a["pos"], dcfg.FLOW))
                    has_flow.add(b["pos"])
                    break
                if b["called_subsig"] is not None and not b["class"].startswith(dcfg.LIBRARY):
                    if b["called_subsig"] == a["subsig"]:
                        if a["is_app"]:
                            out.append((b["pos"], a["pos"], dcfg.CALL))
                            break
                    elif a["name"] == "<clinit>" and b["called_class"] == a["class"]:
                        out.append((b["pos"], a["pos"], dcfg.CALL))
                        break
    return out


def test_linking_orphans(spark):
    for seed in range(6):
        rows = trace(random.Random(seed), 60)
        df = spark.createDataFrame(rows, SCHEMA)
        edges = [tuple(r) for r in dcfg.clean_edges(dcfg.flow_edges(df, size=7), df).collect()]
        got = sorted(tuple(r) for r in dcfg.link_orphans(df, spark.createDataFrame(edges, "src long, dst long, type string")).collect())
        assert got == sorted(scanned_links(rows, edges))


@pytest.mark.parametrize("size", [4, 1 << 17])
def test_linking_orphans_of_consistent_methods(spark, size):
    """Rows of a method agree on what the method is; long threads are cut into buckets."""
    for seed in range(2):
        rng = random.Random(seed)
        rows = trace(rng, 80)
        # D and E are static initialisers of one sub-signature, E of a class of the library, B is no application code
        for r in rows:
            m = r["method"] = rng.choice(["A", "B", "C", "D", "E"])
            r.update({"subsig": "init" if m in "DE" else m, "class": "android.support.E" if m == "E" else "K" + m, "name": "<clinit>" if m in "DE" else m.lower(), "is_app": m not in "BE"})
            if r["called_sig"]:
                c = rng.choice(["A", "B", "C", "D", "init", "E"])
                r.update(called_sig=c, called_subsig="init" if c in ("D", "init") else c, called_class=rng.choice(["KD", "KA", "android.support.E"]))
        df = spark.createDataFrame(rows, SCHEMA)
        edges = [tuple(r) for r in dcfg.clean_edges(dcfg.flow_edges(df, size=7), df).collect()]
        got = sorted(tuple(r) for r in dcfg.link_orphans(df, spark.createDataFrame(edges, "src long, dst long, type string"), size).collect())
        assert got == sorted(scanned_links(rows, edges))
        assert {t for _, _, t in got} == {dcfg.FLOW, dcfg.CALL}


def program(spark):
    """main calls f twice; f returns."""
    text = [("main", "assign", None), ("main", "invoke", "f"), ("f", "assign", None), ("f", "return", None), ("main", "assign", None), ("main", "invoke", "f"), ("f", "assign", None), ("f", "return", None), ("main", "return", None)]
    rows = [
        dict(pos=i, thread_id=0, method=m, subsig=m, **{"class": "app.K"}, name=m, is_app=True, called_sig=c, called_subsig=c, called_class="app.K" if c else None, kind=k, falls_through=k != "return", called_name=c, ret_var="x" if (m, k) == ("f", "return") else None, ret_type="int" if (m, k) == ("f", "return") else None, is_static=True)
        for i, (m, k, c) in enumerate(text)
    ]
    return spark.createDataFrame(rows, SCHEMA + ", called_name string, ret_var string, ret_type string, is_static boolean")


def test_call_and_return(spark):
    stmts = program(spark)
    edges = dcfg.build(stmts)
    got = sorted(tuple(r) for r in edges.collect())
    f, c = dcfg.FLOW, dcfg.CALL
    assert got == [(0, 1, f), (1, 2, c), (1, 4, f), (2, 3, f), (4, 5, f), (5, 6, c), (5, 8, f), (6, 7, f)]
    ids = frames.frame_ids(stmts, edges)
    assert {r.pos: r.frame_id for r in ids.collect()} == {0: 0, 1: 0, 4: 0, 5: 0, 8: 0, 2: 2, 3: 2, 6: 6, 7: 6}
    table = frames.frame_table(stmts, ids, edges)
    assert sorted((r.frame_id, r.last_pos, r.caller_pos) for r in table.collect()) == [(0, 8, 0), (2, 3, 1), (6, 7, 5)]
    assert {r.pos: r.caller_pos for r in frames.callers(ids, table).collect()}[7] == 5
    called = sorted(tuple(r) for r in frames.called_frames(stmts, edges, table).collect())
    assert called == [(1, 2, 3, "x", "int"), (5, 6, 7, "x", "int")]
    assert frames.library_calls(stmts, edges).count() == 0
    assert sorted((r.pos, r.member_pos) for r in frames.chunk(ids).where("pos = 4").collect()) == [(4, 0), (4, 1), (4, 4)]
    assert {r.pos: r.step for r in frames.islands(stmts, edges).collect()}[8] == 4
    near = frames.neighbours(stmts, edges).where("pos = 1").collect()
    assert sorted((r.near_pos, r.type) for r in near) == [(2, c), (4, f)]


def test_edges_across_threads_go(spark):
    stmts = spark.createDataFrame([(0, 1, "invoke", True), (1, 2, "assign", True), (2, 2, "return", False), (3, 2, "goto", False), (4, 2, "assign", True)], "pos long, thread_id long, kind string, falls_through boolean")
    edges = spark.createDataFrame([(0, 1, dcfg.CALL), (1, 2, dcfg.FLOW), (2, 3, dcfg.FLOW), (3, 4, dcfg.FLOW), (0, 2, dcfg.FLOW)], "src long, dst long, type string")
    assert sorted((r.src, r.dst) for r in dcfg.clean_edges(edges, stmts).collect()) == [(0, 2), (1, 2), (3, 4)]
    assert dcfg.clean_edges(edges, stmts, keep_thread_edges=True).count() == 4


def test_look_back_is_bounded(spark):
    rows = [(i, "x", "K", dcfg.PRINTERS[0] if i in (0, 150) else None) for i in range(300)]
    rows = [(p, dcfg.TO_STRING if p in (101, 102, 251, 252) else s, c, k) for p, s, c, k in rows]
    stmts = spark.createDataFrame(rows, "pos long, subsig string, class string, called_sig string")
    none = spark.createDataFrame([], "src long, dst long, type string")
    for size in (10, 1 << 17):
        assert sorted((r.src, r.dst) for r in dcfg.look_back_edges(stmts, none, size).collect()) == [(0, 101), (150, 251)]


def worked_example(spark):
    deps = [(0, 4, 3, "data"), (0, 3, 0, "data"), (0, 3, 2, "control"), (0, 2, 0, "data"), (0, 2, 1, "data")]
    return spark.createDataFrame(deps, "trace long, pos long, dep_pos long, type string"), spark.createDataFrame([(0, 4)], "trace long, pos long")


def test_worked_example(spark):
    deps, seeds = worked_example(spark)
    nodes = lambda e: sorted(r.pos for r in slicer.slice_nodes(e).collect())
    whole = slicer.backward_slice(deps, seeds)
    assert nodes(whole) == [0, 1, 2, 3, 4]
    assert nodes(slicer.backward_slice(deps, seeds, slicer.Options(data_only=True))) == [0, 3, 4]
    assert sorted((r.dep_pos, r.pos, r.type) for r in whole.collect()) == [(0, 2, "data"), (0, 3, "data"), (1, 2, "data"), (2, 3, "control"), (3, 4, "data"), (4, 4, "data")]
    ways = slicer.chop(whole, spark.createDataFrame([(0, 1)], "trace long, pos long"))
    assert sorted((r.dep_pos, r.pos) for r in ways.collect()) == [(1, 2), (2, 3), (3, 4)]
    called = spark.createDataFrame([(0, 1, 0)], "trace long, pos long, caller_pos long")
    assert (0, 3) in {(r.dep_pos, r.pos) for r in slicer.chop(whole, spark.createDataFrame([(0, 1)], "trace long, pos long"), called).collect()}
    kinds = slicer.edge_kinds(whole.union(spark.createDataFrame([(0, 4, 3, "control")], whole.schema)))
    assert {(r.dep_pos, r.pos): r.kinds for r in kinds.collect()}[(3, 4)] == "datacontrol"
    assert [r.dep_pos for r in slicer.ordered_slice(whole).collect()] == [4, 3, 2, 1, 0, 0]


def random_deps(rng, traces=4, n=40):
    out = set()
    for t in range(traces):
        for p in range(1, n):
            for _ in range(rng.randint(0, 2)):
                out.add((t, p, rng.randrange(p), rng.choice(["data", "control"])))
    return sorted(out)


def test_one_pass_equals_the_fixpoint(spark):
    rng = random.Random(8)
    deps = spark.createDataFrame(random_deps(rng), "trace long, pos long, dep_pos long, type string")
    seeds = spark.createDataFrame([(t, rng.randint(20, 39)) for t in range(3)] + [(0, 11)], "trace long, pos long")
    whole = slicer.backward_slice(deps, seeds)
    one = {tuple(r) for r in slicer.slice_nodes(whole).collect()}
    assert one == {tuple(r) for r in slicer.slice_by_frontier(deps, seeds).collect()}
    data = {tuple(r) for r in slicer.backward_slice(deps, seeds, slicer.Options(data_only=True)).collect()}
    ctrl = {tuple(r) for r in slicer.backward_slice(deps, seeds, slicer.Options(control_only=True)).collect()}
    lines = deps.select("trace", "pos", (F.col("pos") % 5).alias("line")).distinct()
    once = {tuple(r) for r in slicer.backward_slice(deps, seeds, slicer.Options(once=True), lines).collect()}
    all_ = {tuple(r) for r in whole.collect()}
    assert data | ctrl | once <= all_
    again = slicer.backward_slice(whole.where("pos <> dep_pos"), seeds)
    assert {tuple(r) for r in again.collect()} == all_


@pytest.mark.parametrize("size", [7, 16])
def test_slices_by_buckets(spark, size):
    """One trace in many buckets gives what one bucket gives; so do the ways forward."""
    rng = random.Random(size)
    deps = spark.createDataFrame(random_deps(rng), "trace long, pos long, dep_pos long, type string")
    seeds = spark.createDataFrame([(t, rng.randint(20, 39)) for t in range(3)] + [(0, 11), (None, 4), (2, None)], "trace long, pos long")
    whole = sorted(tuple(r) for r in slicer.backward_slice(deps, seeds).collect())
    cut = slicer.backward_slice(deps, seeds, size=size)
    assert sorted(tuple(r) for r in cut.collect()) == whole
    sources = spark.createDataFrame([(0, 0), (1, 3), (1, 2)], "trace long, pos long")
    at, want = {(0, 0), (1, 3), (1, 2)}, set()
    for t, p, q, _ in sorted(whole, key=lambda r: r[2]):
        if (t, q) in at and p != q:
            at.add((t, p))
            want.add((t, q, p))
    for n in (size, 1 << 20):
        assert {tuple(r) for r in slicer.chop(cut, sources, size=n).collect()} == want


def test_walks_follow_items(spark):
    """An edge with a path holds for that item only, one without for all; edges without a trace hold for all traces."""
    edges = spark.createDataFrame([(9, "x", 5, "y"), (9, None, 4, "k"), (5, "y", 1, "z"), (5, "w", 2, "z"), (4, "k", 7, "f"), (7, "f", 0, "")], "pos long, path string, dep_pos long, dep_path string")
    seeds = spark.createDataFrame([("a", 9, "x"), ("b", 9, "q"), ("c", 5, "w")], "trace string, pos long, path string")
    want = {("a", 9, "x"), ("a", 5, "y"), ("a", 4, "k"), ("a", 1, "z"), ("a", 7, "f"), ("a", 0, ""), ("b", 9, "q"), ("b", 4, "k"), ("b", 7, "f"), ("b", 0, ""), ("c", 5, "w"), ("c", 2, "z")}
    for size in (2, 100):
        assert sorted(tuple(r) for r in walk.walk_back(edges, seeds, size).collect()) == sorted(want)
    assert walk.walk_back(edges, seeds.where("pos < 0")).isEmpty()


def test_field_write_after_a_definition(spark):
    """Both the field write and the definition before it reach the use; the definition before that does not."""
    rows = [(0, "r", True, False, False), (1, "r", True, False, False), (2, "r", False, True, False), (3, "s", True, False, False), (4, "r", False, False, True), (5, "r", True, False, True)]
    df = spark.createDataFrame(rows, "pos long, base string, kill boolean, adds boolean, uses boolean")
    for size in (2, 1 << 17):
        got = defuse.reaching_definitions(df, ["base"], F.col("kill"), F.col("adds"), F.col("uses"), size=size)
        assert sorted((r.use_pos, r.def_pos) for r in got.collect()) == [(4, 1), (4, 2), (5, 1), (5, 2)]


def test_static_fields(spark):
    rows = [(0, "F", False, False), (10, "F", True, True), (20, "F", False, False), (5, "G", False, False), (6000, "G", True, True)]
    df = spark.createDataFrame(rows, "pos long, field string, writes boolean, init boolean")
    got = {r.pos: r.def_pos for r in defuse.static_definition(df, "field", F.col("writes"), F.col("init"), size=8).collect()}
    assert got == {0: 10, 10: None, 20: 10, 5: None, 6000: None}


def test_control_dependence(spark):
    # unit 1: if; units 2, 3: its branch; units 10..12: a catch block entered after unit 20
    stmts = spark.createDataFrame([(0, 1, 0, "if"), (1, 2, 0, "assign"), (2, 3, 0, "goto"), (3, 1, 0, "if"), (4, 2, 0, "assign"), (5, 20, 0, "assign"), (6, 10, 0, "assign"), (7, 11, 0, "assign"), (8, 12, 0, "assign")], "pos long, unit_id long, frame_id long, kind string")
    regions = spark.createDataFrame(
        [(0, 1, 0, True, False, False), (1, 2, 0, True, False, False), (1, 3, 1, False, False, False), (2, 10, 0, True, True, True), (2, 11, 1, False, True, False), (2, 12, 2, False, True, False)],
        "region_id long, unit_id long, ord int, is_first boolean, is_exception boolean, is_catch boolean",
    )
    cfg = spark.createDataFrame([(99, 2, 0), (1, 2, 1)], "src_unit long, dst_unit long, ord int")
    got = {r.pos: r.dom_pos for r in control.dominators(stmts, regions, cfg).collect()}
    # the catch rows: the last row before those of the catch block that come before them
    assert got == {1: 0, 2: 0, 4: 3, 6: 5, 7: 6, 8: 6}


def test_scopes(spark):
    args = spark.createDataFrame([(7, "f", 0, "o"), (7, "f", 1, "$v")], "key long, callee string, idx int, arg string")
    params = spark.createDataFrame([("f", 0, "r0"), ("f", 1, "p")], "method string, idx int, local string")
    paths = spark.createDataFrame([(7, ["v", "a", "b"], False, "callee"), (7, ["C", "s"], True, "callee"), (7, ["zz"], False, "callee"), (7, ["r0"], False, "caller"), (7, ["k"], False, "same")], "key long, path array<string>, is_static boolean, direction string")
    got = sorted((r.path, r.changed) for r in scope.change_scope(paths, args, params).collect())
    assert got == [(["C", "s"], False), (["k"], False), (["o"], True), (["p", "a", "b"], True)]
    left = scope.not_translated(paths.where("direction = 'callee'"), args, params).collect()
    assert [r.path for r in left] == [["zz"]]
    frames_ = spark.createDataFrame([(3, "f", 2)], "frame_id long, method string, caller_pos long")
    seen = scope.caller_context(frames_, spark.createDataFrame([(3, ["p", "x"], False), (3, ["t"], False), (3, ["C", "s"], True)], "frame_id long, path array<string>, is_static boolean"), params)
    assert sorted(r.path for r in seen.collect()) == [["C", "s"], ["p", "x"]]


def test_thread_edges_come_from_rows_that_have_run(spark):
    """Entries of a thread method are reached from the last row of each starting statement up to them, whatever the buckets."""
    rng = random.Random(4)
    rows = [(p, rng.choice("abc"), rng.randrange(6)) for p in range(80)]
    stmts = spark.createDataFrame(rows, "pos long, method string, unit_id long")
    want = set()
    for i, (p, m, _) in enumerate(rows):
        if m == "b" and (i == 0 or rows[i - 1][1] != "b"):
            for u in (1, 4, 9):
                before = [q for q, _, v in rows if v == u and q <= p]
                want |= {(max(before), p, "CALL_EDGE")} if before else set()
    starters = spark.createDataFrame([(1,), (4,), (9,)], "unit_id long")
    for size in (7, 1000):
        got = {tuple(r) for r in dcfg.thread_edges(stmts, starters, spark.createDataFrame([("b",)], "method string"), size).collect()}
        assert got == want


def test_static_paths_are_defined_by_their_beginnings(spark):
    rng = random.Random(6)
    path = lambda: [rng.choice("CD"), *(rng.choice(["f", "$g", "g"]) for _ in range(rng.randrange(1, 4)))]
    writes = [(p, path(), f"v{p}", rng.random() < 0.3) for p in rng.sample(range(60), 20)]
    asks = [(p, path()) for p in range(0, 60, 2) for _ in range(2)] + [(None, ["C"]), (1, [])]
    plain = lambda x: [e.removeprefix("$") for e in x]
    want = set()
    for p, a in asks[:-2]:
        fits = [w for w in writes if plain(a)[: len(w[1])] == plain(w[1])]
        hit = max((w for w in fits if w[0] < p), default=None) or min((w for w in fits if p < w[0] <= p + 9 and w[3]), default=None)
        want.add((p, tuple(a), *((None, None) if hit is None else (hit[0], (hit[2], *a[len(hit[1]) :])))))
    a = spark.createDataFrame(asks, "pos long, path array<string>")
    w = spark.createDataFrame(writes, "pos long, path array<string>, right string, in_initialiser boolean")
    for size in (5, 1000):
        got = {(r.pos, tuple(r.path), r.def_pos, r.source and tuple(r.source)) for r in defuse.static_field_definition(a, w, 9, size).collect()}
        assert got == want


def test_second_slice_follows_only_what_is_new(spark, monkeypatch):
    deps = spark.createDataFrame([(1, p, p - 1) for p in range(1, 60)] + [(1, 70, 40), (1, 70, 65), (1, 65, 64)], "trace long, pos long, dep_pos long")
    seed = lambda p: spark.createDataFrame([(1, p)], "trace long, pos long")
    first = written(slicer.reached_again(deps, seed(50), size=8))
    assert {r.pos for r in first.collect()} == set(range(51))
    walked = []
    plain = walk.written
    monkeypatch.setattr(walk, "written", lambda df, name="part": (walked.append((name, (out := plain(df, name)).count())), out)[1])
    both = {r.pos for r in slicer.reached_again(deps, seed(70), first, 8).collect()}
    assert both == set(range(51)) | {64, 65, 70}
    # three new rows are walked, not the forty that are known
    assert sum(n for name, n in walked if name == "walked") <= 5


@pytest.mark.parametrize("size", [4, 16, 1 << 20])
def test_shared_edges_for_many_traces(spark, size):
    """Random edges that all traces share, with and without paths, from many items at once and on from known ones, against a loop."""
    rng = random.Random(size)
    edges = [(p, rng.choice(["x", "y", None]), rng.randrange(p) if rng.random() < 0.95 else rng.randrange(40), rng.choice("xy")) for p in rng.choices(range(1, 40), k=90)]
    seeds = [[(t, rng.randrange(40), rng.choice("xy")) for t in range(25)] for _ in range(2)]

    def reach(items):
        items, todo = set(items), list(items)
        while todo:
            t, pos, path = todo.pop()
            for more in {(t, d, dp) for p, e, d, dp in edges if p == pos and e in (None, path)} - items:
                items.add(more)
                todo.append(more)
        return sorted(items)

    e = written(spark.createDataFrame(edges, "pos long, path string, dep_pos long, dep_path string"))
    one, two = (spark.createDataFrame(x, "trace long, pos long, path string") for x in seeds)
    first = written(walk.walk_back(e, one, size))
    assert sorted(map(tuple, first.collect())) == reach(seeds[0])
    assert sorted(map(tuple, walk.walk_back(e, two, size, first).collect())) == reach(seeds[0] + seeds[1])


def test_shared_edges_are_not_copied_for_each_trace(spark, n=15_000):
    """Each of many traces has one edge of the bucket; a copy of all edges for each would be n * n rows."""
    ids = spark.range(n)
    edges = written(ids.select((F.col("id") * 2 + 1).alias("pos"), F.lit("x").alias("path"), (F.col("id") * 2).alias("dep_pos"), F.lit("y").alias("dep_path")))
    began = time.time()
    assert walk.walk_back(edges, ids.select(F.col("id").alias("trace"), (F.col("id") * 2 + 1).alias("pos"), F.lit("x").alias("path"))).count() == 2 * n
    assert time.time() - began < 40


def test_rounds_do_not_grow_with_positions(spark, monkeypatch):
    names = []
    monkeypatch.setattr(walk, "written", lambda df, name="part": names.append(name) or written(df, name))
    chain = [(t, 10 * i + t, 10 * (i - 1) + t) for t in (1, 2) for i in range(1, 40)]
    edges = written(spark.createDataFrame(chain, "trace long, pos long, dep_pos long"))
    seeds = spark.createDataFrame([(t, 390 + t) for t in (1, 2)], "trace long, pos long")
    want = sorted((t, 10 * i + t) for t in (1, 2) for i in range(40))
    # 40 edges of a trace fit one bucket of 64, though they lie 10 positions apart
    assert sorted(map(tuple, walk.walk_back(edges, seeds, 64).collect())) == want
    assert names.count("walked") == 1
    # a trace with more edges than a bucket takes is cut
    assert sorted(map(tuple, walk.walk_back(edges, seeds, 8).collect())) == want
    assert names.count("walked") > 3
    monkeypatch.setattr(walk, "FEW", 0)
    assert sorted(map(tuple, walk.walk_back(edges, seeds, 8).collect())) == want
    both = walk.walk_back(edges, seeds, 8, written(walk.walk_back(edges, seeds.where("trace = 1"), 8)))
    assert sorted(map(tuple, both.collect())) == want


def test_last_before_in_one_window(spark):
    rows = spark.createDataFrame([(p % 3 if p % 5 else None, p, p % 4 == 0) for p in range(60)], "key long, pos long, marked boolean")
    mark = {"at": F.when(F.col("marked"), F.col("pos"))}
    assert fits(rows, ["key"], 20) and not fits(rows, ["key"], 10)
    for forward in (False, True):
        one, cut = (last_before(rows, "pos", mark, ["key"], size, forward).select("key", "pos", "at").collect() for size in (None, 7))
        assert sorted(one, key=lambda r: r.pos) == sorted(cut, key=lambda r: r.pos)


def test_edge_kinds_are_aggregated_in_place(spark):
    edges = spark.createDataFrame([(1, 2, 1, "data"), (1, 2, 1, "control"), (1, 3, 1, "control"), (2, 3, 1, "data"), (2, 3, 1, "data")], "trace long, pos long, dep_pos long, type string")
    kinds = slicer.edge_kinds(edges)
    assert sorted((r.trace, r.pos, r.kinds) for r in kinds.collect()) == [(1, 2, "datacontrol"), (1, 3, "control"), (2, 3, "data")]
    plan = kinds._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
