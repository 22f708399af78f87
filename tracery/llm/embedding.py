"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of random signs and a Hadamard transform; a vector's hash
is the axis, with its sign, that it is nearest to.  A table joins ``axes`` such hashes.
A vector lies in its own bucket of every table and probes the buckets next best for
it.  The vectors of a bucket are compared exactly, in double precision; a pair that
meets in several buckets is counted in the first of them only.  Equal vectors are
merged before; a bucket of many vectors is cut into blocks, and pairs of blocks are
compared in tasks of their own.  No pairs leave a task, only a vector's number of
links and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components, forest

BLOCK = 1024


def _rotated(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    n, d = x.shape
    for _ in range(3):
        x = x * rng.choice([-1.0, 1.0], d)
        half = 1
        while half < d:
            y = x.reshape(n, d // (2 * half), 2, half)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
            half *= 2
        x = x / d**0.5
    return x


def codes(x: np.ndarray, tables: int, axes: int, probes: int, seed: int) -> np.ndarray:
    """Bucket codes (rows, tables, 1 + probes) of the rows of ``x``; the first is the row's own bucket."""
    n, dim = x.shape
    d = 1 << max(2, (dim - 1).bit_length())
    unit = np.zeros((n, d))
    unit[:, :dim] = x / np.linalg.norm(x, axis=1, keepdims=True)
    rng, out = np.random.default_rng([seed, d]), np.empty((n, tables, 1 + probes), np.int64)
    picks = list(product(range(3), repeat=axes))
    for t in range(tables):
        sides, costs = [], []
        for _ in range(axes):
            y = _rotated(unit, rng)
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :3]
            value = np.take_along_axis(y, top, 1)
            sides.append(2 * top + (value < 0))
            costs.append((np.abs(value[:, :1]) - np.abs(value)) ** 2)
        cost = np.stack([sum(c[:, k] for c, k in zip(costs, pick, strict=True)) for pick in picks], axis=1)
        code = np.stack([sum(s[:, k] * (2 * d) ** j for j, (s, k) in enumerate(zip(sides, pick, strict=True))) for pick in picks], axis=1)
        best = np.argsort(cost, axis=1, kind="stable")[:, : 1 + probes]
        out[:, t] = np.take_along_axis(code, best, 1)
    return out


def _coded(tables: int, axes: int, probes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(v, np.float64) for v in batch.column("vec").to_pylist()]
            found: list = [None] * len(vectors)
            for size in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == size]
                for i, c in zip(at, codes(np.stack([vectors[i] for i in at]), tables, axes, probes, seed), strict=True):
                    found[i] = c.ravel()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names, "codes"])

    return run


def _group(rep, mult, block, x, code, key, radius: float, width: int):
    """(vector, number of linked rows, edges) of one pair of blocks of a bucket."""
    _, table, bucket, p, q = key
    own = code[:, table * width] == bucket
    if not own.any() or len(rep) < 2:
        return None
    norms = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / np.outer(norms, norms) >= radius
    near &= own[:, None] | own[None, :]
    if p != q:
        near &= block[:, None] != block[None, :]
    np.fill_diagonal(near, False)
    i, j = np.nonzero(np.triu(near))
    if not len(i):
        return None
    # of the buckets where a pair meets, the least in (table, bucket) counts it
    first = np.ones(len(i), bool)
    for t in range(table + 1):
        a, b = code[i, t * width : (t + 1) * width], code[j, t * width : (t + 1) * width]
        meets_a, meets_b = (b == a[:, :1]).any(axis=1), (a == b[:, :1]).any(axis=1)
        if t < table:
            first &= ~(meets_a | meets_b)
        else:
            first &= ~((meets_a & (a[:, 0] < bucket)) | (meets_b & (b[:, 0] < bucket)))
    count = np.bincount(i[first], mult[j[first]], len(rep)) + np.bincount(j[first], mult[i[first]], len(rep))
    return count.astype(np.int64), forest(near, True)


def _compared(radius: float, width: int):
    names = ("lab", "table", "bucket", "p", "q")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole groups, whatever the batches."""
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            keys = np.stack([table.column(c).to_numpy() for c in names], axis=1)
            cut = np.flatnonzero((keys != keys[-1]).any(axis=1))
            end = int(cut[-1]) + 1 if len(cut) else 0
            if end:
                yield table.slice(0, end)
            rest = table.slice(end)
        if rest is not None and rest.num_rows:
            yield rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            keys = np.stack([table.column(c).to_numpy() for c in names], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            rep, mult, block = (table.column(c).to_numpy() for c in ("rep", "mult", "block"))
            vec, code = table.column("vec").combine_chunks(), table.column("codes").combine_chunks()
            at, flat = vec.offsets.to_numpy(), vec.values.to_numpy(zero_copy_only=False).astype(np.float64)
            flat_code = code.flatten().to_numpy().reshape(len(keys), -1)
            a, b, n = [], [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo < 2:
                    continue
                x = flat[at[lo] : at[hi]].reshape(hi - lo, -1)
                found = _group(rep[lo:hi], mult[lo:hi], block[lo:hi], x, flat_code[lo:hi], keys[lo].tolist(), radius, width)
                if found:
                    count, edges = found
                    some = np.flatnonzero(count)
                    a += rep[lo:hi][some].tolist() + [int(rep[lo + i]) for i, _ in edges]
                    b += [None] * len(some) + [int(rep[lo + j]) for _, j in edges]
                    n += count[some].tolist() + [None] * len(edges)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b, n)], names=["a", "b", "n"])

    return run


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", radius: float = 0.93,
    tables: int = 5, axes: int = 2, probes: int = 3, block: int = BLOCK, seed: int = 11,
) -> DataFrame:
    """Return (id, n_links, component_id, kept) for every row of ``vectors``.

    Two rows are linked if their labels are equal and not null, their vectors have the
    same length and a cosine of at least ``radius``.  Vectors that are null, empty or
    zero, or that hold a null or non-finite component, link with nothing, nor do rows
    with a null id (their component is null).  Rows that repeat an id count as vectors
    of their own.  ``kept`` marks the least id of a component.  Ids are integers.
    Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))
    merged = rows.where(usable).groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("mult"))
    merged = merged.withColumn("lab", F.xxhash64("label", F.size("vec")))
    kept = written(merged.repartition("rep"), "vectors")
    schema = "lab long, rep long, mult long, vec array<{0}>, codes array<long>".format(vectors.schema[vec_col].dataType.elementType.simpleString())
    coded = written(kept.select("lab", "rep", "mult", "vec").mapInArrow(_coded(tables, axes, probes, seed), schema), "codes")
    width = 1 + probes
    place = F.explode(F.sequence(F.lit(0), F.lit(tables * width - 1)))

    def entries(*columns: str) -> DataFrame:
        spread = coded.select(*columns, "lab", "codes", place.alias("at"))
        return spread.withColumn("table", F.floor(F.col("at") / width).cast("int")).withColumn("bucket", F.get("codes", "at"))

    hot = written(entries().groupBy("lab", "table", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > block), "hot")
    placed = entries("rep", "mult", "vec").join(hot, ["lab", "table", "bucket"], "left")
    blocks = F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
    key = ["lab", "table", "bucket", "p", "q"]
    dealt = placed.select(*key, "rep", "mult", "block", "vec", "codes").repartition(*key).sortWithinPartitions(*key)
    found = written(dealt.mapInArrow(_compared(radius, width), "a long, b long, n long"), "links")
    counts = found.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("more"))
    named = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "component")
    known = kept.join(counts, "rep", "left").join(named, "rep", "left")
    known = written(known.select("label", "vec", (F.col("mult") - 1 + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component")), "known")
    linked = rows.where(usable).join(known, ["label", "vec"]).select("id", "n", "component")
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    return linked.union(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )
