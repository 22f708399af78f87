"""Grammars of traces against the same rounds in plain Python, and their expansion against the trace."""

import random
from collections import Counter

from tracery.operators import grammar
from tracery.plans.scratch import written


def collapse(seq):
    out = []
    for pos, sym, times in seq:
        if out and out[-1][1] == sym:
            out[-1] = (out[-1][0], sym, out[-1][2] + times)
        else:
            out.append((pos, sym, times))
    return out


def plain(traces):
    """(bodies by rule, sequences) by the rounds of the operator; one bucket for each trace."""
    items = {t: collapse([(p, "'" + s, 1) for p, s in rows]) for t, rows in traces.items()}
    rules, number = {}, 0
    while True:
        number += 1
        pairs = {t: [(a[1], a[2], b[1], b[2]) for a, b in zip(x, x[1:], strict=False)] for t, x in items.items()}
        counts = Counter(p for x in pairs.values() for p in x)
        rank = {t: [(counts[p], p) if counts[p] > 1 else (0,) for p in x] for t, x in pairs.items()}
        chosen = [(t, i) for t, x in rank.items() for i, r in enumerate(x) if r > (0,) and (i == 0 or r > x[i - 1]) and (i + 1 == len(x) or r > x[i + 1])]
        uses = {}
        for t, i in chosen:
            uses.setdefault(pairs[t][i], []).append((t, items[t][i][0], i))
        uses = {p: u for p, u in uses.items() if len(u) > 1}
        if not uses:
            return rules, items
        named = {}
        for p, u in uses.items():
            t, pos, _ = min(u)
            rules[f"R{number}.{t}.{pos}"] = p
            for s, _, i in u:
                named[s, i] = f"R{number}.{t}.{pos}"
        for t, x in items.items():
            drop = {i + 1 for s, i in named if s == t}
            items[t] = collapse([(pos, named.get((t, i), sym), 1 if (t, i) in named else times) for i, (pos, sym, times) in enumerate(x) if i not in drop])


def check(spark, traces, **options):
    rows = spark.createDataFrame([(t, p, s) for t, x in traces.items() for p, s in x] + [(None, 1, "x"), (1, None, "x"), (1, 999, None)], "trace long, pos long, symbol string")
    rules, sequence = grammar.trace_grammar(rows, **options)
    back = {}
    for r in grammar.expanded(rules, sequence).collect():
        back.setdefault(r.trace, []).append((r["at"], r.symbol))
    for t, x in traces.items():
        assert sorted(back.get(t, [])) == [(i, s) for i, (_, s) in enumerate(x)]
    return rules, sequence


def test_rounds_against_plain_python(spark):
    rng = random.Random(2)
    words = ["abcab", "xyz", "aaaa", "bc d", "q"]
    traces = {t: [(7 * i + t, s) for i, s in enumerate("".join(rng.choice(words) for _ in range(25)))] for t in (1, 2, 3)}
    rules, sequence = check(spark, traces)
    want_rules, want_items = plain(traces)
    assert {r.rule: (r.left, r.left_times, r.right, r.right_times) for r in rules.collect()} == want_rules and want_rules
    assert sorted((r.trace, r.pos, r.sym, r.times) for r in sequence.collect()) == sorted((t, *i) for t, x in want_items.items() for i in x)
    # no pair of items is left twice
    left = Counter((a[1:], b[1:]) for x in want_items.values() for a, b in zip(x, x[1:], strict=False))
    assert max(left.values(), default=0) < 2
    uses = {r.rule: r.uses for r in grammar.rule_uses(rules, sequence).collect()}
    assert set(uses) <= set(want_rules) and sum(uses.values()) > 0
    bodies = {r.rule: r.body for r in grammar.grammar_lines(rules).collect()}
    assert any("_" in b for b in bodies.values()) and set(bodies) == set(want_rules)


def test_buckets_and_odd_traces(spark):
    check(spark, {1: [(i, "ab"[i % 2]) for i in range(50)], 5: [(3, "only")]}, size=8)
    rules, sequence = check(spark, {2: [(i, "z") for i in range(9)]})
    assert rules.count() == 0 and [(r.sym, r.times) for r in sequence.collect()] == [("'z", 9)]


def test_expansion_writes_each_symbol_once(spark, monkeypatch):
    symbols = [(1, i, "abcd"[i % 4] + str(i % 16)) for i in range(256)]
    rules, sequence = grammar.trace_grammar(spark.createDataFrame(symbols, "trace long, pos long, symbol string"))
    assert rules.agg({"round": "max"}).first()[0] > 3
    opened = []

    def counted(df, name="part"):
        out = written(df, name)
        opened.append(out.count())
        return out

    monkeypatch.setattr(grammar, "written", counted)
    back = grammar.expanded(rules, sequence)
    assert sorted(map(tuple, back.collect())) == [(1, i, s) for _, i, s in symbols]
    # symbols once each, and fewer rules than symbols
    assert sum(opened) < 2 * len(symbols)
