"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame functions only).

1. A source's target is its weighted share of ``ratio`` times all words, stopped at
   ``max_repeat`` times its own size; what is cut off is shared again by weight.
2. The mix is cut into blocks of ``block_words`` words.  The sources get their
   blocks by the highest quotients target / (2k + 1).
   Blocks of one word, the default, bring every source to within a word of its target.
3. A source is dealt into shards of about ``shard_words`` words by a seeded hash of
   the document id.  Every shard gets whole blocks by the same rounding rule (its
   share to the nearest whole block), so a source's total stays near its quota
   without a pass over all its shards in one place.  Small sources need small blocks:
   a source is within half a block for each of its shards of its quota, and its quota
   within about a block of its target.
4. In a shard the documents stand in seeded order as one tape of words, and the
   quota is taken from the tape's beginning, again from the beginning if it exceeds
   the tape.  No document is taken more than ``max_repeat`` times.

A hot source has more shards, not larger ones.  The table of sources (one row
each) is the only one sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written


def source_quotas(sizes: DataFrame, weights=(5, 2, 1), ratio: float = 1.5, max_repeat: int = 2, block_words: int = 1) -> DataFrame:
    """One row per source of ``sizes(source, size)``: source_size, target (double), blocks (long).

    Sources are ranked by code point, null last; the weights repeat along the ranks.
    A source without words gets target 0.  An empty table gives an empty table.
    """
    everything = Window.partitionBy()
    named = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = named.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)) + 1)
    ranked = ranked.select("*", weight.alias("weight"), (F.lit(float(max_repeat)) * F.col("source_size")).alias("cap"))
    ranked = ranked.withColumn("total", F.lit(float(ratio)) * F.sum("source_size").over(everything))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(
        filling.rowsBetween(0, Window.unboundedFollowing)
    )
    filled = ranked.select("*", level.alias("level"), F.row_number().over(filling).alias("step"))
    # the first level that the source it is computed for can still take is the common one
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("step", "level"))
    common = F.min(fits).over(everything)["level"]
    target = F.least(F.col("cap"), F.coalesce(common * F.col("weight"), F.col("cap")))
    aimed = filled.select("source", "source_size", "rank", target.alias("target"))
    aimed = aimed.withColumn("seats", F.round(F.sum("target").over(everything) / block_words).cast("long"))
    aimed = aimed.withColumn("n", F.count("*").over(everything))
    share = F.floor(F.col("target") / block_words).cast("long")
    # rounding all shares is at most n/2 blocks off, so the deciding quotient moves a source's
    # share by its part of that: over all sources some 5 n quotients decide
    reach = F.ceil(share * (F.col("n") + 1) / (2 * F.greatest(F.col("seats"), F.lit(1)))) + 2
    low = F.when(F.col("target") > 0, F.greatest(F.lit(0), share - reach)).otherwise(0)
    aimed = aimed.withColumn("low", low.cast("long")).withColumn("high", F.when(F.col("target") > 0, share + reach).otherwise(0).cast("long"))
    aimed = aimed.withColumn("open", F.col("seats") - F.sum("low").over(everything))
    near = aimed.where("high > low").select("rank", "target", "open", F.explode(F.sequence("low", F.col("high") - 1)).alias("k"))
    order = Window.orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), "rank", "k")
    won = near.select("rank", "open", F.row_number().over(order).alias("place")).where("place <= open").groupBy("rank").agg(F.count("*").alias("won"))
    return aimed.join(won, "rank", "left").select(
        "source", "source_size", "target", (F.col("low") + F.coalesce("won", F.lit(0))).alias("blocks")
    )


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=(5, 2, 1),
    ratio: float = 1.5, max_repeat: int = 2, block_words: int = 1, shard_words: int = 8000, seed: int = 42, carry: tuple = (),
) -> DataFrame:
    """Return (id, size, source_size, target, taken) and the columns ``carry`` for every row of ``docs``.

    ``taken`` counts the words the mix takes from the row, repeats included.  A null
    or empty text has size 0 and nothing is taken; a null source is a source of its
    own; rows with equal ids are rows of their own in the same shard; other columns
    are ignored.  Equal inputs give equal outputs, whatever the partitioning.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    named = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")]
    sizes = written(docs.select(*named), "sizes")
    quotas = written(source_quotas(sizes, weights, ratio, max_repeat, block_words), "quotas").withColumnRenamed("source", "of")
    rows = docs.select(*named, F.struct(*carry).alias("carried")) if carry else sizes
    each = rows.join(quotas, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    seeded = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), F.col("size").cast("string")))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))
    each = each.withColumn("h", seeded).withColumn("shard", F.conv(F.left("h", F.lit(8)), 16, 10).cast("long") % shards)
    tape = Window.partitionBy("source", "shard")
    so_far = tape.orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("*", F.sum("size").over(tape).alias("length"), F.coalesce(F.sum("size").over(so_far), F.lit(0)).alias("before"))
    blocks = F.floor(F.col("blocks") * F.col("length") / F.col("source_size") + 0.5)
    want = F.least(blocks * block_words, max_repeat * F.col("length"))
    each = each.withColumn("want", F.when(F.col("length") > 0, want).otherwise(0).cast("long"))
    rounds = F.when(F.col("length") > 0, F.floor(F.col("want") / F.col("length"))).otherwise(0)
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("want") - rounds * F.col("length") - F.col("before")))
    return each.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (rounds * F.col("size") + rest).cast("long").alias("taken"),
        *(["carried.*"] if carry else []),
    )
