"""SimHash near-duplicates by an exact comparison in tiles.

Fingerprints are put into tiles by the population counts of their three parts (21,
21 and 22 bits).  Counts of a part cannot differ by more than the bits do, so two
tiles are compared only if their counts differ by at most the radius in sum; all
other tile pairs are skipped.  A tile of many fingerprints is cut into blocks of
bounded size, and a pair of blocks is compared with numpy: exclusive-or and bit
counts of all pairs, of which only a spanning forest is emitted.  Equal
fingerprints are merged before, so a group of copies is one fingerprint here.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components, forest

#: Bits of the three parts, from the low end, and the base of a tile's number.
PARTS = (21, 21, 22)
BLOCK = 512


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42, step: int = 1 << 15) -> int:
    """64-bit SimHash of a text: A-Z lower-cased, shingles of ``width`` words, XXH64 of each, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        starts, ends = [0], [len(joined)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(sizes + 1) - 1
        starts, ends = (stops - sizes)[: len(words) - width + 1].tolist(), stops[width - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), step):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[k : k + step], ends[k : k + step], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def _fingerprints(texts: pa.Array) -> pa.Array:
    found = np.array([fingerprint(t.as_py()) for t in texts], np.uint64)
    return pa.array(found.view(np.int64))


def _near(a: np.ndarray, b: np.ndarray, radius: int, rows: int = 128) -> np.ndarray:
    """Which pairs of two blocks differ in at most ``radius`` bits."""
    return np.concatenate([np.bitwise_count(a[k : k + rows, None] ^ b[None, :]) <= radius for k in range(0, len(a), rows)])


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for x, y, same in zip(batch.column("x"), batch.column("y"), batch.column("same"), strict=True):
                a = x.values.to_numpy().view(np.uint64)
                b = y.values.to_numpy().view(np.uint64)
                for i, j in forest(_near(a, b, radius), same.as_py()):
                    left.append(a[i])
                    right.append(b[j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (left, right)], names=["a", "b"]
            )

    return run


def links(prints: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the distinct values of ``prints(fp)``: their components are those of all pairs within ``radius`` bits."""
    at, counts = 0, []
    for bits in PARTS:
        counts.append(F.bit_count(F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1))))
        at += bits
    tiled = prints.select("fp", *[c.alias(f"p{k}") for k, c in enumerate(counts)])
    # at most 22 * 22 * 23 rows, whatever the number of fingerprints
    sizes = F.broadcast(tiled.groupBy("p0", "p1", "p2").agg(F.count("*").alias("n")))
    blocks = tiled.join(sizes, ["p0", "p1", "p2"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / block)))
    packed = written(blocks.groupBy("p0", "p1", "p2", "block").agg(F.collect_list("fp").alias("fps")), "tiles")
    near = [d for d in product(range(-radius, radius + 1), repeat=3) if sum(map(abs, d)) <= radius and d >= (0, 0, 0)]
    steps = F.array(*[F.struct(*[F.lit(x).alias(f"d{k}") for k, x in enumerate(d)]) for d in near])
    left = packed.select("p0", "p1", "p2", F.col("block").alias("lb"), F.col("fps").alias("x"), F.explode(steps).alias("d"))
    inside = F.lit(True)
    for k, bits in enumerate(PARTS):
        inside &= (F.col(f"p{k}") + F.col(f"d.d{k}")).between(0, bits)
    left = left.where(inside).select(*[(F.col(f"p{k}") + F.col(f"d.d{k}")).alias(f"p{k}") for k in range(3)], "lb", "x", (F.abs("d.d0") + F.abs("d.d1") + F.abs("d.d2") == 0).alias("home"))
    pairs = left.join(packed.withColumnRenamed("fps", "y"), ["p0", "p1", "p2"]).where("not home or lb <= block")
    pairs = pairs.select("x", "y", (F.col("home") & (F.col("lb") == F.col("block"))).alias("same"))
    return pairs.mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """Return (id, fingerprint, component_id) for every row of ``docs``.

    Two rows are linked if their fingerprints differ in at most ``radius`` bits; the
    component is named by its least id.  Null and empty texts have fingerprint zero
    and are linked like any other.  A row with a null id gets a fingerprint but no
    component and links nothing.  Rows that repeat an id are rows of their own.  Other
    columns are ignored.
    """
    prints = written(docs.select(F.col(id_col).alias("id"), F.arrow_udf(_fingerprints, "long")(F.col(text_col).cast("binary")).alias("fp")), "prints")
    distinct = written(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    named = components(links(distinct.select("fp"), radius)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = written(distinct.join(named, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    labels = written(rooted.join(least, "root").select("fp", "component_id"), "labels")
    out = prints.join(labels, "fp", "left")
    return out.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
