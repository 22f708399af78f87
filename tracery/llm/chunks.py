"""Matching the contents of a corpus with itself, chunk by chunk.

Documents are dealt into chunks of bounded size by a hash of their id.  A chunk asks
about hashes of its contents: it removes its own repeats first and sends the rest,
packed and sorted, to parts by the leading bits of the hash.  A part sees one
message of each chunk, compares the hashes and answers each chunk in the order of
its question, so no positions are sent.  A content that a third of all documents
share is one entry of a chunk's message, however often the chunk holds it.

The chunks are exchanged once: the passes over them read the same shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POST = "chunk int, part long, keys binary, more binary"
CHUNK_BYTES = 8 << 20
LAST_ID = np.iinfo(np.int64).max


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """(chunks, bytes): ``docs`` as (chunk, id, text) with as many chunks as its bytes need, and the number of bytes."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, math.ceil(total / chunk_bytes))
    dealt = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.octet_length(text_col)), F.lit(n)).cast("int")
    return docs.select(dealt.alias("chunk"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")), total


def leading_bits(entries: float, most: int = 1 << 21) -> int:
    """Bits of the part number so that a part has at most about ``most`` entries."""
    return max(4, math.ceil(math.log2(max(entries, 1) / most)) if entries > most else 0)


def in_order(table: pa.Table) -> tuple[list, pa.Array, np.ndarray]:
    """(ids, texts, keys) of a chunk in the order of ids, null last; texts break ties, so the order is always the same."""
    ids, texts = table.column("id").to_pylist(), table.column("text").combine_chunks()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    keys = np.array([LAST_ID if ids[i] is None else ids[i] for i in order], np.int64)
    if (keys[1:] == keys[:-1]).any():
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i].as_py() or b""))
    return [ids[i] for i in order], texts.take(pa.array(order, pa.int64())), keys


def posts(chunk: int, hashes: np.ndarray, bits: int, pack) -> pa.Table:
    """Messages for the parts that have any of the hashes: ``hashes`` is sorted; ``pack(lo, hi)`` gives the two byte strings for a range of it."""
    part = hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes), np.uint64)
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(hashes)] if len(hashes) else [0]
    return as_posts([(chunk, int(part[lo]), *pack(lo, hi)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)])


def as_posts(rows: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    kinds = (("chunk", pa.int32()), ("part", pa.int64()), ("keys", pa.binary()), ("more", pa.binary()))
    return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)})


def messages(table: pa.Table) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Rows of a table of posts by chunk and part."""
    yield from sorted(zip(*(table.column(c).to_pylist() for c in ("chunk", "part", "keys", "more")), strict=True), key=lambda r: r[:2])


def answers(table: pa.Table, n: int, bits: int, hashes: np.ndarray, kind=np.bool_) -> np.ndarray:
    """One value for each of a chunk's sorted hashes, from the answers of the parts (none: 0)."""
    out = np.zeros(n, kind)
    for _, part, keys, _ in messages(table):
        if part >= 0:
            got = np.unpackbits(np.frombuffer(keys, np.uint8)).astype(bool) if kind == np.bool_ else np.frombuffer(keys, kind)
            at = int(np.searchsorted(hashes, np.uint64(part << (64 - bits) if bits else 0)))
            take = min(len(got), n - at)
            out[at : at + take] = got[:take]
    return out


def distinct_pairs(high: np.ndarray, low: np.ndarray, tie: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first of each distinct pair, pairs in order; number of each row's pair; count of each pair); ``tie`` says which is first."""
    order = np.lexsort((low, high) if tie is None else (tie, low, high))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (high[order[1:]] != high[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
    index = np.empty(len(order), np.int64)
    index[order] = np.cumsum(fresh) - 1
    return order[fresh], index, np.bincount(index, minlength=int(fresh.sum()))


def two_rounds(chunks: DataFrame, ask, match, ask_again, match_again, finish, schema: str) -> DataFrame:
    """Ask, answer, ask again, answer again and finish, all on Arrow tables of a chunk or a part."""
    told = chunks.groupBy("chunk").applyInArrow(ask, POST).groupBy("part").applyInArrow(match, POST)
    again = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(ask_again, POST)
    told_again = again.groupBy("part").applyInArrow(match_again, POST)
    return chunks.groupBy("chunk").cogroup(told_again.groupBy("chunk")).applyInArrow(finish, schema)


def only_covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Mask of the positions in 0 .. n-1 that lie in start .. start + width - 1 for any of the starts."""
    steps = np.zeros(n + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + width, n), -1)
    return np.cumsum(steps[:n]) > 0


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of True."""
    steps = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
