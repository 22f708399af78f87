"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated probabilities.

Every word has a sparse ternary index vector given by its hash.  A word's vector is
the sum of the index vectors of the words around it in the training sample, kept in
a table of fixed size that words share by their hash.  A document is pooled to the
mean of its words' vectors and of the index vectors of their shapes (length, case,
digits, marks, repetition).  A network with one hidden layer is trained with numpy on
the pooled vectors of the sample, and its scores are divided by a temperature fitted
on a part of the sample that it has not seen.

The sample is bounded: at most ``sample`` labelled documents, those with the least
hash of their id.  Only it, its pooled vectors and the table reach the driver; every
document is scored where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import bytes_of, mixed, pieces, word_hashes, words_of
from .common import forget, written

DIM, ROWS, SHAPES, ONES, NEAR = 48, 1 << 14, 1 << 12, 4, 2
#: A document of so many words is drawn halfway to the sample's mean.
FEW = 4
#: Parts in which the word table is summed.
BLOCKS = 64
#: Words that are pooled at once, however long their text.
STEP = 1 << 16
WIDTH = 2 * DIM


@dataclass
class Model:
    """What scoring needs; a constant probability where there is nothing to learn from."""

    words: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    w1: np.ndarray | None = None
    b1: np.ndarray | None = None
    w2: np.ndarray | None = None
    b2: float = 0.0
    temperature: float = 1.0
    constant: float | None = None


def _places(h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(dimension, sign) of each non-zero entry of the index vectors of hashes."""
    for k in range(ONES):
        yield (h >> np.uint64(12 * k)) % np.uint64(DIM), 1.0 - 2.0 * ((h >> np.uint64(60 + k)) & np.uint64(1))


def _index_table(n: int) -> np.ndarray:
    h = mixed(np.arange(n, dtype=np.uint64) + np.uint64(77))
    out = np.zeros((n, DIM), np.float32)
    for dim, sign in _places(h):
        np.add.at(out, (np.arange(n), dim.astype(np.int64)), sign)
    return out


_SHAPE_VECTORS = _index_table(SHAPES)


def _shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number for the shape of each word: length, capitals, digits, marks, non-ASCII, same as the word before."""

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return total[ends] - total[starts]

    size = ends - starts
    upper = count((raw >= 65) & (raw <= 90))
    digits = count((raw >= 48) & (raw <= 57))
    wide = count(raw >= 128)
    letters = upper + count((raw >= 97) & (raw <= 122)) + wide
    again = np.zeros(len(h), np.int64)
    again[1:] = h[1:] == h[:-1]
    again[first[:-1][first[:-1] < len(h)]] = 0
    marks = np.minimum(size - letters - digits, 3)
    case = np.where(upper == 0, 0, np.where((upper > 1) & (upper * 2 > letters), 2, 1))
    number = ((again * 4 + marks) * 3 + case) * 3 + np.minimum(digits, 2)
    return (number * 6 + np.minimum(size // 4, 5)) % SHAPES


def _scan(column: pa.Array) -> Iterator[tuple]:
    raw, offsets = bytes_of(column)
    for lo, hi in pieces(offsets, 1 << 19):
        part, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = words_of(part, at)
        h = word_hashes(part, starts, ends)
        yield h, _shapes(part, starts, ends, h, first), first


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The table of context sums of one partition, in blocks; entries are whole numbers, so any order of sums agrees."""
    table = np.zeros(ROWS * DIM)
    for batch in batches:
        for h, _, first in _scan(batch.column("text")):
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            row = (h % np.uint64(ROWS)).astype(np.int64) * DIM
            for step in range(1, NEAR + 1):
                near = doc[step:] == doc[:-step]
                for a, b in ((row[step:], h[:-step]), (row[:-step], h[step:])):
                    for dim, sign in _places(b[near]):
                        table += np.bincount(a[near] + dim.astype(np.int64), sign, ROWS * DIM)
    parts = np.split(table.astype(np.float32), BLOCKS)
    yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["block", "table"])


def _added(parts: pa.Table) -> pa.Table:
    """The sum of one block of all partitions' tables."""
    total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in parts.column("table"))
    return pa.table({"block": pa.array([parts.column("block")[0].as_py()], pa.int32()), "table": pa.array([total.tobytes()], pa.binary())})


def _unit(table: np.ndarray) -> np.ndarray:
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1.0)).astype(np.float32)


def _pooled(column: pa.Array, words: np.ndarray) -> np.ndarray:
    """Mean vector of each document's words, and the weight that its number of words gives it."""
    out = []
    for h, shapes, first in _scan(column):
        n = np.diff(first)
        sums = np.zeros((len(n), WIDTH), np.float32)
        for lo in range(0, len(h), STEP):
            hi = min(lo + STEP, len(h))
            rows = np.concatenate([words[(h[lo:hi] % np.uint64(ROWS)).astype(np.int64)], _SHAPE_VECTORS[shapes[lo:hi]]], axis=1)
            at = np.clip(first, lo, hi) - lo
            full = np.diff(at) > 0
            sums[full] += np.add.reduceat(rows, at[:-1][full], axis=0)
        out.append(np.concatenate([sums / np.maximum(n, 1)[:, None], (n / (n + FEW))[:, None]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, WIDTH + 1))


def _standard(model: Model, x: np.ndarray) -> np.ndarray:
    """Pooled vectors in units of the sample's spread; those of few words are drawn to its mean."""
    return (x[:, :WIDTH] - model.mean) / model.scale * x[:, WIDTH:]


def _probability(model: Model, x: np.ndarray) -> np.ndarray:
    hidden = np.maximum(_standard(model, x) @ model.w1 + model.b1, 0)
    return 1 / (1 + np.exp(-np.clip((hidden @ model.w2 + model.b2) / model.temperature, -60, 60)))


def _train(x: np.ndarray, y: np.ndarray, hidden: int, epochs: int, seed: int) -> Model:
    """Two layers, logistic loss with weight decay, Adam; every fifth row is kept for the temperature."""
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    m = Model(mean=x[:, :WIDTH].mean(axis=0), scale=x[:, :WIDTH].std(axis=0) + 1e-3)
    z = _standard(m, x)
    params = [rng.normal(0, (2 / WIDTH) ** 0.5, (WIDTH, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    train, t = np.flatnonzero(~held), 0
    for _ in range(epochs):
        rng.shuffle(train)
        for k in range(0, len(train), 256):
            rows = train[k : k + 256]
            a = z[rows] @ params[0] + params[1]
            r = np.maximum(a, 0)
            p = 1 / (1 + np.exp(-np.clip(r @ params[2] + params[3], -60, 60)))
            d = (p - y[rows]) / len(rows)
            back = np.outer(d, params[2]) * (a > 0)
            grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(axis=0), r.T @ d + 1e-4 * params[2], d.sum(keepdims=True)]
            t += 1
            for p_, g, (m1, m2) in zip(params, grads, moments, strict=True):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                p_ -= 0.003 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    m.w1, m.b1, m.w2, m.b2 = params[0], params[1], params[2], float(params[3][0])
    part = held if held.any() else ~held

    def loss(temperature: float) -> float:
        m.temperature = temperature
        p = np.clip(_probability(m, x[part]), 1e-9, 1 - 1e-9)
        return float(-np.mean(y[part] * np.log(p) + (1 - y[part]) * np.log(1 - p)))

    m.temperature = float(min(np.exp(np.linspace(-1.5, 2.5, 81)), key=loss))
    return m


def held_out(id_col: str) -> Column:
    """Whether a row's labels are kept from training: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = 20_000, parts: int = 8, hidden: int = 32, epochs: int = 30, seed: int = 7,
) -> Model:
    """Train on the labelled rows that are not held out, at most ``sample`` of them.

    Rows with a null id or label are skipped; a repeated id has its greatest label and text.
    Without labelled rows the model says 0.5, with one class only that class.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    chosen = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64(F.col("id")), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    picked = texts.join(F.broadcast(chosen), "id")
    # of rows that repeat an id the greatest text counts, so the sample bounds the rows too
    one = picked.groupBy("id", "y").agg(F.max("text").alias("text"))
    rows = written(one.repartition(parts).select("id", "y", "text"), "sample")
    kinds = "block int, table binary"
    blocks = rows.select("text").mapInArrow(_contexts, kinds).groupBy("block").applyInArrow(_added, kinds).collect()  # one table
    words = np.concatenate([np.frombuffer(r["table"]) for r in sorted(blocks)] or [np.zeros(ROWS * DIM)])
    words = _unit(words.reshape(ROWS, DIM))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _pooled(batch.column("text"), words).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "y", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = sorted((r["id"], r["x"], r["y"]) for r in rows.mapInArrow(pool, f"id {kind}, y double, x binary").collect())
    forget(rows)
    y = np.array([r[2] for r in found])
    if len(set(y.tolist())) < 2:
        return Model(constant=float(y[0]) if len(y) else 0.5)
    model = _train(np.array([np.frombuffer(r[1], np.float32) for r in found], np.float64), y, hidden, epochs, seed)
    model.words = words
    return model


def score(model: Model, text: Column) -> Column:
    """Probability of label 1 for each text; null and empty texts pool to zero and are scored too."""
    if model.constant is not None:
        return F.lit(float(model.constant))

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(_probability(model, _pooled(texts, model.words).astype(np.float64)))

    return scored(text.cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Return (id, held_out, score, predicted) for every row of ``docs``; other columns are ignored."""
    model = fit(docs, labels, id_col, text_col, **options)
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score(model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns."""
    model = fit(docs, labels, id_col, text_col, **options)
    return docs.where(score(model, F.col(text_col)) >= 0.5)
