"""Taint along frames against a loop over the calls of a frame."""

import random

from tracery.operators import frametaint
from tracery.operators.framework import applied
from tracery.operators.frametaint import taint_along
from tracery.sources import rules

CALLS = "frame long, pos long, method_sig string, base string, ret string, args array<struct<name:string,type:string,is_constant:boolean>>"


def loop(flows, seeds, frames, last):
    """The calls one after the other, each applied to every path that its rules name."""
    alive, out = {f: set() for f in set(frames.values())}, set()
    for pos in range(-1, last):
        rows = flows.get(pos, [])
        named = {x[0].removeprefix("$") for r in rows for x in (r.left, r.right) if x}
        for p in [p for p in alive[frames[pos]] if p[0].removeprefix("$") in named] if rows else []:
            plain = [x.removeprefix("$") for x in p]
            new = {p}
            for r in rows:
                if r.left is not None and r.right and r.left_ok and plain[: len(r.right)] == r.right:
                    new.add(tuple(r.left) if r.right_type == "INSTANCE" and r.left_type != "RETURN" else (tuple(r.left) + p[len(r.right) :])[:10])
            new -= {tuple(r.left) for r in rows if r.left is not None and r.right_type == "CLEAR"}
            out |= {(frames[pos], pos, x) for x in new}
            alive[frames[pos]].discard(p)
            alive[frames[pos]] |= {("new", *x) for x in new}
        for f in alive:
            alive[f] = {x[1:] if x[0] == "new" else x for x in alive[f]}
        for f, at, path in seeds:
            if at == pos and f is not None and path:
                alive[f].add(tuple(path))
    return out


def test_against_a_loop_over_calls(spark):
    rng = random.Random(11)
    sigs = {"<A: app.A gen(app.A,int)>": "Generate", "<A: void kill(app.A)>": "Kill", "<A: app.A copy(app.A)>": "Default"}
    rows = []
    for pos in range(60):
        sig = rng.choices(list(sigs), [4, 1, 4])[0]
        args = [(rng.choice("abcdef"), "app.A", False)] + ([("7", "int", True)] if "int" in sig else [])
        rows.append((rng.choice([1, 1, 2]), pos, sig, rng.choice("xyz"), rng.choice([None, "r", "a"]), args))
    calls = spark.createDataFrame(rows, CALLS)
    model = rules.model_rules(spark.createDataFrame(list(sigs.items()), "method_sig string, kind string"))
    seeds = [(1, -1, ["a", "f"]), (1, 5, ["x"]), (2, 3, ["$b"]), (2, 0, ["r", "g", "h"]), (None, 1, ["a"]), (1, 2, []), (1, 5, ["x"])]
    flows = {}
    for r in applied(calls, model).collect():
        flows.setdefault(r.pos, []).append(r)
    want = loop(flows, seeds, {r[1]: r[0] for r in rows} | {-1: 1}, 60)
    assert len(want) > 30
    taint = spark.createDataFrame(seeds, "frame long, pos long, path array<string>")
    for size in (4, 1000):
        assert {(r.frame, r.pos, tuple(r.path)) for r in taint_along(calls, model, taint, size).collect()} == want


def test_nothing_to_follow(spark):
    calls = spark.createDataFrame([(1, 0, "<A: app.A f(app.A)>", "x", None, [("a", "app.A", False)])], CALLS)
    model = rules.model_rules(spark.createDataFrame([("<A: app.A f(app.A)>", "Generate")], "method_sig string, kind string"))
    for rows in ([], [(1, 0, ["x"])], [(9, -1, ["x"])]):
        assert taint_along(calls, model, spark.createDataFrame(rows, "frame long, pos long, path array<string>")).count() == 0
    assert taint_along(calls.where("false"), model, spark.createDataFrame([(1, 0, ["x"])], "frame long, pos long, path array<string>")).count() == 0


def test_calls_far_apart_are_one_bucket(spark, monkeypatch):
    """Rounds follow the number of a frame's calls, not how far they lie apart."""
    arg = [("v", "app.A", False)]
    calls = spark.createDataFrame([(f, p * 1000 + f, "<l: o m(o)>", "b", "v", arg) for f in range(3) for p in range(8)], CALLS)
    seeds = spark.createDataFrame([(f, 0, ["v", "f"]) for f in range(3)], "frame long, pos long, path array<string>")
    rounds, plain = [], frametaint.written
    monkeypatch.setattr(frametaint, "written", lambda df, name="part": (rounds.append(name), plain(df, name))[1])
    out = taint_along(calls, rules.model_rules(spark.createDataFrame([("<l: o m(o)>", "Generate")], "method_sig string, kind string")), seeds, 10).collect()
    assert {(r.frame, r.pos) for r in out} == {(f, p * 1000 + f) for f in range(3) for p in range(f == 0, 8)}
    assert rounds.count("walked") == 1
