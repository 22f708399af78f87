"""A grammar of a trace: pairs of symbols that repeat become rules, round by round.

In each round runs of one symbol become one item with a repetition count, pairs of
neighbouring items are counted over all traces, and of the pairs that repeat those are
replaced that come before both pairs they overlap with, in the order of their counts.
The most frequent pair always goes, so a round makes a rule or is the last.  At the end no
pair of items repeats within the buckets.

Traces are cut into buckets of ``size`` positions, each with a window of its own; pairs
across a border stay.  A rule is known by its round and the position of its first use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracery.plans.ordered import SIZE, running_total
from tracery.plans.scratch import forget, written

#: Marks of symbols: taken from the trace, or a rule.
_PLAIN, _RULE = "'", "R"
_NEAR = ["trace", "b"]
_SIDES = ["sym", "times", "sym2", "times2"]


def _order() -> Window:
    return Window.partitionBy(*_NEAR).orderBy("pos")


def _paired(seq: DataFrame) -> DataFrame:
    """(trace, b, pos, sym, len, times, sym2, len2, times2): runs of one symbol as one item, with the item after it, in one pass over a bucket."""
    upto = _order().rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.lag("sym").over(_order()) != F.col("sym"), F.lit(True))
    before, total = F.coalesce(F.sum("times").over(upto), F.lit(0).cast("bigint")), F.sum("times").over(Window.partitionBy(*_NEAR))
    heads = seq.select(*_NEAR, "pos", "sym", "len", fresh.alias("fresh"), before.alias("x"), total.alias("total")).where("fresh")
    near = heads.select("*", *[F.lead(c).over(_order()).alias(f"{c}2") for c in ("sym", "len", "x")], F.lead("x", 2).over(_order()).alias("x3"))
    return near.select(
        *_NEAR, "pos", "sym", "len", (F.coalesce("x2", "total") - F.col("x")).alias("times"), "sym2", "len2", F.when(F.col("x2").isNotNull(), F.coalesce("x3", "total") - F.col("x2")).alias("times2")
    )


def _chosen(paired: DataFrame) -> DataFrame:
    """Items with ``picked``: whether their pair repeats and comes before those it overlaps with, in the order of counts."""
    counts = paired.where("sym2 is not null").groupBy(F.struct(*_SIDES).alias("pair")).agg(F.count("*").alias("n")).where("n > 1")
    ranked = paired.withColumn("pair", F.struct(*_SIDES)).join(counts, "pair", "left").withColumn("rank", F.when(F.col("n").isNotNull(), F.struct("n", "pair"))).drop("pair", "n")
    near = ranked.select("*", F.lag("rank").over(_order()).alias("p"), F.lead("rank").over(_order()).alias("q"))
    first = F.col("rank").isNotNull() & (F.col("p").isNull() | (F.col("rank") > F.col("p"))) & (F.col("q").isNull() | (F.col("rank") > F.col("q")))
    return near.select(*paired.columns, first.alias("picked"))


def trace_grammar(rows: DataFrame, size: int = SIZE, rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(rules, sequence) for ``rows(trace, pos, symbol)``.

    ``rules`` are (rule, round, left, left_times, left_len, right, right_times, right_len,
    length): what a rule stands for and the number of symbols in it and its sides.
    ``sequence`` is (trace, pos, sym, len, times), the items that are left of each trace
    in order.  Symbols of the trace have a ``'`` before them.  Rows without a trace,
    position or symbol are left out; positions are whole numbers without repeats within a
    trace.
    """
    start = rows.where("trace is not null and pos is not null and symbol is not null")
    start = start.select("trace", F.floor(F.col("pos") / size).alias("b"), F.col("pos").cast("bigint").alias("pos"), F.concat(F.lit(_PLAIN), "symbol").alias("sym"), F.lit(1).cast("bigint").alias("len"), F.lit(1).cast("bigint").alias("times"))
    items = written(_paired(start), "items")
    made = None
    for number in range(1, rounds + 1):
        chosen = written(_chosen(items), "chosen")
        picked = chosen.where("picked").withColumn("pair", F.struct(*_SIDES))
        name = F.concat_ws(".", F.lit(f"{_RULE}{number}"), F.min(F.struct("trace", "pos"))["trace"].cast("string"), F.min(F.struct("trace", "pos"))["pos"].cast("string"))
        each = picked.groupBy("pair").agg(F.count("*").alias("n"), name.alias("rule"), F.max("len").alias("left_len"), F.max("len2").alias("right_len")).where("n > 1")
        found = written(each.withColumn("length", F.col("pair.times") * F.col("left_len") + F.col("pair.times2") * F.col("right_len")), "found")
        if found.isEmpty():
            break
        rules = found.select("rule", F.lit(number).alias("round"), F.col("pair.sym").alias("left"), F.col("pair.times").alias("left_times"), "left_len", F.col("pair.sym2").alias("right"), F.col("pair.times2").alias("right_times"), "right_len", "length")
        made = rules if made is None else made.unionByName(rules)
        # what is not picked is not joined, and what a rule takes in is the row behind it
        own = ["trace", "b", "pos", "sym", "len", "times"]
        named = picked.join(found.select("pair", "rule", "length"), "pair", "left").select(*own, "rule", "length")
        placed = named.unionByName(chosen.where("not picked").select(*own), allowMissingColumns=True)
        placed = placed.withColumn("gone", F.lag("rule").over(_order()).isNotNull()).where("not gone")
        fresh = placed.select("trace", "b", "pos", F.coalesce("rule", "sym").alias("sym"), F.coalesce("length", "len").alias("len"), F.when(F.col("rule").isNotNull(), F.lit(1).cast("bigint")).otherwise(F.col("times")).alias("times"))
        before, items = items, written(_paired(fresh), "items")
        forget(before), forget(chosen)
    else:
        raise RuntimeError("the grammar did not settle; give more rounds")
    none = "rule string, round int, left string, left_times bigint, left_len bigint, right string, right_times bigint, right_len bigint, length bigint"
    return (rows.sparkSession.createDataFrame([], none) if made is None else written(made, "rules")), items.select("trace", "pos", "sym", "len", "times")


def rule_uses(rules: DataFrame, sequence: DataFrame) -> DataFrame:
    """(rule, uses): how often each rule stands in the sequence and in other rules, repetitions counted."""
    sides = [rules.select(F.col(s).alias("sym"), F.col(f"{s}_times").alias("n")) for s in ("left", "right")]
    every = sequence.select("sym", F.col("times").alias("n")).unionByName(sides[0]).unionByName(sides[1])
    return every.where(F.col("sym").startswith(_RULE)).groupBy(F.col("sym").alias("rule")).agg(F.sum("n").alias("uses"))


def grammar_lines(rules: DataFrame) -> DataFrame:
    """(rule, body): each rule as text, symbols by spaces, repetitions behind a star; blanks as ``_`` and line ends as ``\\n``."""
    shown = lambda c: F.replace(F.replace(F.when(F.col(c).startswith(_PLAIN), F.expr(f"substring({c}, 2)")).otherwise(F.col(c)), F.lit(" "), F.lit("_")), F.lit("\n"), F.lit("\\n"))
    times = lambda c: F.when(F.col(c) > 1, F.concat(F.lit("*"), F.col(c).cast("string"))).otherwise("")
    return rules.select("rule", F.concat(shown("left"), times("left_times"), F.lit(" "), shown("right"), times("right_times")).alias("body"))


def _unrolled(items: DataFrame) -> DataFrame:
    """Items repeated as often as they say, each at its place."""
    each = items.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1)).alias("i"))
    return each.select("trace", "sym", "len", (F.col("at") + F.col("i") * F.col("len")).alias("at"))


def expanded(rules: DataFrame, sequence: DataFrame, size: int = SIZE) -> DataFrame:
    """(trace, at, symbol): the traces again, symbols numbered from 0 in each trace.

    All rules that stand in the rows are opened at the same time, and symbols are put
    aside when they appear, so each is written once.
    """
    weight: Column = F.col("times") * F.col("len")
    placed = running_total(sequence, "pos", {"end": weight}, ["trace"], size).withColumn("at", F.col("end") - weight)
    rows = written(_unrolled(placed.select("trace", "sym", "len", "times", "at")), "open")
    sides = F.array(
        F.struct(F.col("left").alias("s"), F.col("left_times").alias("t"), F.col("left_len").alias("n"), F.lit(0).cast("bigint").alias("o")),
        F.struct(F.col("right").alias("s"), F.col("right_times").alias("t"), F.col("right_len").alias("n"), (F.col("left_times") * F.col("left_len")).alias("o")),
    )
    bodies = rules.select(F.col("rule").alias("sym"), sides.alias("sides"))
    plain = None
    while True:
        done = rows.where(F.col("sym").startswith(_PLAIN)).select("trace", "at", F.expr("substring(sym, 2)").alias("symbol"))
        plain = done if plain is None else plain.unionByName(done)
        waiting = rows.where(F.col("sym").startswith(_RULE))
        if waiting.isEmpty():
            return plain
        parts = waiting.join(bodies, "sym").select("trace", "at", F.explode("sides").alias("x"))
        parts = parts.select("trace", F.col("x.s").alias("sym"), F.col("x.n").alias("len"), F.col("x.t").alias("times"), (F.col("at") + F.col("x.o")).alias("at"))
        rows = written(_unrolled(parts), "open")
