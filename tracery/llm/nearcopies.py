"""Near copies by wide SimHash fingerprints compared in tiles, verified on the shingle sets.

A text's set of word shingles gives a fingerprint of 256 bits.  Fingerprints are put into
tiles by the size of the set and by their population count.  Sets of a similarity s have
sizes that differ by a factor of 1 / s at most and fingerprints within ``RADIUS`` bits, so
a pair of tiles is skipped if its sizes or its population counts are farther apart.
Blocks of the other pairs are compared with numpy: exclusive-or and bit counts, the first
64 bits of all pairs, the rest of those that pass.

What is within the radius is a candidate cluster.  In a second pass the sets themselves
decide: inside a cluster each set is compared with the others that are not yet in its
class, and only classes leave the task.  A cluster too large for one task is cut into
blocks, and pairs of blocks are compared in tasks of their own.  Equal sets are merged
before everything else, so a group of copies is one fingerprint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import bytes_of, mixed, pieces, window_hashes, word_hashes, words_of
from .common import forget, written
from .components import components

WIDTH, SIMILARITY = 5, 0.8
#: 64-bit words of a fingerprint, bits that a candidate pair may differ in, and those of them in the first word.
WORDS, RADIUS, FIRST = 4, 64, 22
#: Fingerprints in a block of a tile; sets and shingles in a block of a cluster.
BLOCK, MEMBERS, SHINGLES = 8192, 1024, 1 << 20
_SALT = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``width`` words, A-Z lower-cased; a text of fewer words is one shingle."""
    raw, offsets = bytes_of(texts)
    for lo, hi in pieces(offsets):
        part = raw[offsets[lo] : offsets[hi]]
        part = np.where((part >= 65) & (part <= 90), part + np.uint8(32), part)
        starts, ends, first = words_of(part, offsets[lo : hi + 1] - offsets[lo])
        words = word_hashes(part, starts, ends)
        rolled = window_hashes(words, width)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            else:
                yield np.array([xxhash.xxh64_intdigest(words[a:b].tobytes())], np.uint64)


def wide_fingerprint(found: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """SimHash of a set of hashes, as ``WORDS`` 64-bit words: a bit is 1 if it is in over half of the images."""
    ones = np.zeros(64 * WORDS, np.int64)
    for k in range(0, len(found), step):
        images = np.stack([mixed(found[k : k + step] + salt) for salt in _SALT], axis=1)
        bits = np.unpackbits(images.view(np.uint8), axis=1, bitorder="little")
        # sums of 255 rows fit in a byte
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)


def _prints(width: int):
    names = ["id", "tie", "h", "n", *[f"f{k}" for k in range(WORDS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n, prints = [], [], np.empty((batch.num_rows, WORDS), np.uint64)
            for k, found in enumerate(shingles(batch.column("text"), width)):
                h.append(xxhash.xxh64_intdigest(found.tobytes()))
                n.append(len(found))
                prints[k] = wide_fingerprint(found)
            longs = [pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(n, pa.int64())]
            longs += [pa.array(np.ascontiguousarray(prints[:, k]).view(np.int64)) for k in range(WORDS)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tie"), *longs], names=names)

    return run


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give all that the pairs (i, j) connect the least of their labels, in place; labels are positions."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        least = np.arange(len(label))
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least[least] != least).any():
            least = least[least]
        label[:] = least[label]


def _stars(h: np.ndarray, label: np.ndarray) -> pa.Table:
    """An edge from each member to the first of its class."""
    to = np.flatnonzero(label != np.arange(len(label)))
    return pa.table({"a": pa.array(h[to]), "b": pa.array(h[label[to]])})


def _compared(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        """The classes within the radius in a pair of blocks (or in one block)."""
        blocks = [x.values for x in table.column("rows")]
        h, n = (np.concatenate([b.field(c).to_numpy() for b in blocks]) for c in ("h", "n"))
        prints = [np.concatenate([b.field(f"f{k}").to_numpy() for b in blocks]).view(np.uint64) for k in range(WORDS)]
        cut = len(blocks[0])
        label = np.arange(len(h))
        for lo in range(0, cut, 128):
            hi = min(lo + 128, cut)
            right = cut if len(blocks) > 1 else lo
            near = np.bitwise_count(prints[0][lo:hi, None] ^ prints[0][None, right:]) <= FIRST
            i, j = np.nonzero(near)
            i, j = i + lo, j + right
            some = i != j
            i, j = i[some], j[some]
            bits = sum(np.bitwise_count(f[i] ^ f[j]).astype(np.int16) for f in prints)
            hit = (bits <= RADIUS) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
            unite(label, i[hit], j[hit])
        return _stars(h, label)

    return run


def candidates(prints: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose components are the clusters of ``prints(h, n, f0, ...)`` within the radius."""
    bits = sum((F.bit_count(f"f{k}") for k in range(1, WORDS)), F.bit_count("f0"))
    place = ["band", "ones", "block"]
    row = F.struct("h", "n", *[f"f{k}" for k in range(WORDS)])
    tiled = prints.select(row.alias("row"), "h", F.floor(F.log("n") / -math.log(similarity)).cast("int").alias("band"), F.floor(bits / RADIUS).cast("int").alias("ones"))
    # a row for each size band (below 200, for texts of any length) and 64 ones (at most 5)
    sizes = F.broadcast(tiled.groupBy("band", "ones").agg(F.ceil(F.count("*") / block).alias("m")))
    dealt = tiled.join(sizes, ["band", "ones"]).withColumn("block", F.pmod(F.xxhash64("h"), "m").cast("int"))
    packed = written(dealt.groupBy(*place).agg(F.collect_list("row").alias("rows")), "tiles")
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    left = packed.select(*place, F.explode(steps).alias("d")).select("*", (F.col("band") + F.col("d.x")).alias("band2"), (F.col("ones") + F.col("d.y")).alias("ones2"))
    right = packed.select(F.col("band").alias("band2"), F.col("ones").alias("ones2"), F.col("block").alias("block2"))
    cell = [*place, "band2", "ones2", "block2"]
    cells = written(left.join(right, ["band2", "ones2"]).where("d.x <> 0 or d.y <> 0 or block <= block2").select(*cell), "cells")
    one = cells.select(*cell, *[F.col(c).alias(f"of_{c}") for c in place], F.lit(0).alias("side"))
    two = cells.select(*cell, *[F.col(f"{c}2").alias(f"of_{c}") for c in place], F.lit(1).alias("side"))
    same = F.lit(True)
    for c in place:
        same &= F.col(c) == F.col(f"{c}2")
    sides = one.union(two.where(~same)).join(packed.select(*[F.col(c).alias(f"of_{c}") for c in place], "rows"), [f"of_{c}" for c in place])
    edges = sides.select(*cell, "rows").groupBy(*cell).applyInArrow(_compared(similarity), "a long, b long")
    return written(edges, "candidates")


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in shingles(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("m"), batch.column("h"), pa.array(found, pa.binary())], names=["cluster", "m", "h", "found"])

    return run


def classes(sets: list[np.ndarray], block: np.ndarray, similarity: float) -> np.ndarray:
    """The class of each set, as its first member's position; where there are several blocks, only pairs across them count."""
    sizes = np.array([len(s) for s in sets])
    at = np.concatenate([[0], np.cumsum(sizes)])
    kinds, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark, label = np.zeros(len(kinds), bool), np.arange(len(sets))
    across = len(np.unique(block)) > 1
    for i in range(len(sets) - 1):
        rest = slice(i + 1, None)
        open_ = (label[rest] != label[i]) & (np.minimum(sizes[rest], sizes[i]) >= similarity * np.maximum(sizes[rest], sizes[i]))
        if across:
            open_ &= block[rest] != block[i]
        if not open_.any():
            continue
        own = ids[at[i] : at[i + 1]]
        mark[own] = True
        shared = np.add.reduceat(mark[ids[at[i + 1] :]], at[i + 1 : -1] - at[i + 1], dtype=np.int64)
        mark[own] = False
        near = np.flatnonzero(open_ & (shared >= similarity * (sizes[rest] + sizes[i] - shared)))
        unite(label, np.full(len(near), i), near + i + 1)
    return label


def _verified(similarity: float):
    key = ("cluster", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h, block, sets = None, [], [], []

        def done() -> pa.RecordBatch:
            # equal sets may come from repeated rows
            first = list({x: k for k, x in enumerate(h)}.values())
            table = _stars(np.array([h[k] for k in first]), classes([sets[k] for k in first], np.array([block[k] for k in first]), similarity))
            return table.combine_chunks().to_batches()[0] if table.num_rows else empty

        empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"])
        for batch in batches:
            for *now, x, own, found in zip(*(batch.column(c).to_pylist() for c in (*key, "h", "block", "found")), strict=True):
                if now != at:
                    if len(h) > 1:
                        yield done()
                    at, h, block, sets = now, [], [], []
                h.append(x), block.append(own), sets.append(np.frombuffer(found, np.uint64))
        if len(h) > 1:
            yield done()

    return run


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, members: int = MEMBERS) -> DataFrame:
    """Return (h, component, id, tie) for the different shingle sets of the rows with an id.

    ``h`` is the set's hash, ``component`` the least hash that a chain of sets with a
    Jaccard similarity of at least ``similarity`` leads to, ``id`` and ``tie`` the least id
    with such a text and the hash of that text.  Texts that differ in letter case or
    white space only have equal sets; null and empty texts are copies of each other.
    """
    tie = F.xxhash64(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), tie.alias("tie"), F.col(text_col).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    longs = ["n", *[f"f{k}" for k in range(WORDS)]]
    prints = rows.mapInArrow(_prints(width), f"id {kind}, tie long, h long, " + ", ".join(f"{c} long" for c in longs))
    distinct = written(prints.groupBy("h").agg(*[F.max(c).alias(c) for c in longs], F.min(F.struct("id", "tie")).alias("rep")), "prints")
    found = candidates(distinct.select("h", *longs), similarity)
    named = components(found)
    near = written(distinct.select("h", "n", "rep.id", "rep.tie").join(named.select(F.col("node").alias("h"), F.col("component").alias("cluster")), "h"), "near")
    blocks = F.ceil(F.greatest(F.count("*") / members, F.sum("n") / SHINGLES)).cast("int").alias("m")
    near = near.join(near.groupBy("cluster").agg(blocks).where("m > 1"), "cluster", "left").select("cluster", F.coalesce("m", F.lit(1)).alias("m"), "h", "id", "tie")
    # the texts of the clusters only are read again
    sets = rows.join(written(near, "clusters"), ["id", "tie"]).select("cluster", "m", "h", "text").mapInArrow(_sets(width), "cluster long, m int, h long, found binary")
    placed = sets.withColumn("block", F.pmod(F.xxhash64("h"), "m").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    key = ["cluster", "p", "q"]
    dealt = placed.select("cluster", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "h", "block", "found")
    links = written(dealt.repartition(*key).sortWithinPartitions(*key, "h").mapInArrow(_verified(similarity), "a long, b long"), "links")
    labels = components(links).withColumnRenamed("node", "h")
    out = distinct.join(labels, "h", "left").select("h", F.coalesce("component", "h").alias("component"), "rep.id", "rep.tie")
    forget(found)
    return out


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The row of ``docs`` with the least id of each group of near copies; rows with a null id stay.

    A row is known by its id and the hash of its text, so rows that repeat an id with
    different texts are documents of their own (the lesser hash breaks the tie).  Rows
    equal in id and text are copies: the one whose other columns come first as JSON
    stays.  All columns stay as they are, whatever their names.
    """
    labels = near_copies(docs, id_col, text_col, width, similarity)
    least = labels.groupBy("component").agg(F.min(F.struct("id", "tie")).alias("r"))
    stay = written(least.select("r.id", "r.tie"), "stay")
    row = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))).alias("tie"), F.struct("*").alias("row"))
    others = F.to_json(F.struct(*[F.col(f"row.`{c}`") for c in docs.columns if c != text_col])) if len(set(docs.columns)) == len(docs.columns) else F.to_json("row")
    kept = row.where("id is not null").join(stay, ["id", "tie"], "left_semi").groupBy("id", "tie").agg(F.min_by("row", others).alias("row"))
    return kept.select("row.*").unionByName(docs.where(F.col(id_col).isNull()))
