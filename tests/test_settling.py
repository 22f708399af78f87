"""Loops either come to their end or raise; none returns a part."""

import pytest

from tracery.plans import closure
from tracery.sources import traces

BLOCKS = "bb_id long, method string, stmt_idx int, instr string, bb_src_line long"


def test_reachable_raises_instead_of_a_part(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "node long")
    assert closure.reachable(edges, seeds).count() == 7
    with pytest.raises(RuntimeError):
        closure.reachable(edges, seeds, rounds=3)


def test_long_goto_chains_and_circles(spark):
    rows = [(i, "m", 0, f'goto tmpString = "{i + 1}"', 1) for i in range(20)] + [(20, "m", 0, r"x = $y\z", 1), (30, "m", 0, 'goto tmpString = "99"', 1)]
    got = {r.bb_id: r.instr for r in traces.resolve_gotos(spark.createDataFrame(rows, BLOCKS)).collect()}
    assert all(got[i] == "goto " * (20 - i) + r"x = $y\z" for i in range(21)) and got[30] == 'goto tmpString = "99"'
    with pytest.raises(RuntimeError):
        traces.resolve_gotos(spark.createDataFrame([(1, "m", 0, 'goto tmpString = "1"', 1)], BLOCKS))
