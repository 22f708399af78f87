"""Repeated byte strings by bucket-pointer refinement of suffix buckets.

The suffixes that matter start at every byte.  Their buckets are refined as in
bucket-pointer refinement: the identifier of a suffix's bucket for 2q bytes is made
from its identifier for q bytes and that of the suffix q bytes later, and each level's
identifiers are used again by the next: 8, 16, 32, 64, 128 and at last ``width``
bytes.  Identifiers are 64-bit hashes, so a level needs no order of the whole corpus.
What decides has 96 bits: a run its anchor's bucket (32 and the part's number) and 64 of
its own, a string of ``width`` bytes 64 and 32 of two refinements.  Both refinements
start from the 64-bit identifiers of grams: strings that differ within one gram only are
told apart by 64 bits.

Not every suffix is taken through all levels.  Of the 64-byte buckets of the suffixes
in a window, the least (the rightmost, if equal) is the window's anchor, so equal
windows have equal anchors, and a run of windows with one anchor is one candidate.
Buckets of one suffix are done.  A bucket whose suffixes agree over their whole runs
repeats as a whole.  Only the suffixes of the other buckets are refined to ``width``
bytes, one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytescan import bytes_of, mixed, pieces, range_hashes
from .chunks import CHUNK_BYTES, answers, as_posts, chunked, distinct_pairs, in_order, leading_bits, messages, only_covered, posts, runs_of, two_rounds

SCHEMA = "id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
#: Bytes of an anchor, and the windows of a long document that are worked on at once.
GRAM, SEGMENT = 64, 1 << 21
_PLACE = (1 << 22) - 1


def _refined(ids: np.ndarray, step: int) -> np.ndarray:
    """Bucket identifiers of twice the length (or of a length and ``step`` more)."""
    x = ids[:-step] * np.uint64(0x9E3779B97F4A7C15) + ids[step:]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _buckets(raw: np.ndarray) -> np.ndarray:
    """Identifiers for ``GRAM`` bytes at every position that has so many bytes left."""
    ids = raw.astype(np.uint64)
    for step in (1, 2, 4):  # up to eight bytes the identifier is the string itself
        ids = ids[:-step] | (ids[step:] << np.uint64(8 * step))
    step = 8
    while step < GRAM:
        ids = _refined(ids, step)
        step *= 2
    return ids


def _full(ids: np.ndarray, width: int) -> np.ndarray:
    """Identifiers for ``width`` bytes (between 2 and 4 grams) from those of a gram."""
    ids = _refined(ids, GRAM)
    return mixed(_refined(ids, width - 2 * GRAM))


def _second(ids: np.ndarray, width: int) -> np.ndarray:
    """32 bits of another identifier for ``width`` bytes."""
    return (_full(mixed(ids ^ np.uint64(0xA0761D6478BD642F)), width) >> np.uint64(32)).astype(np.uint32)


def _least(v: np.ndarray, n: int) -> np.ndarray:
    """Least of each ``n`` consecutive values."""
    size = 1
    out = v
    while 2 * size <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(v) - n + 1], out[n - size :]) if n > size else out


def _segments(offsets: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, document ends): byte ranges whose windows are worked on together; parts of a long document overlap by ``width - 1``."""
    for lo, hi in pieces(offsets, 1 << 19):
        a, b = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or b - a <= SEGMENT:
            yield a, b, offsets[lo + 1 : hi + 1]
        else:
            for s in range(a, b, SEGMENT):
                end = min(s + SEGMENT + width - 1, b)
                if end - s >= width:
                    yield s, end, np.array([end])


def _runs(raw: np.ndarray, offsets: np.ndarray, width: int):
    """Runs of windows with one anchor, over a chunk: (bucket of the anchor, identifier of the whole run, first start, number of starts)."""
    out = ([], [], [], [])
    for a, b, ends in _segments(offsets, width):
        part = raw[a:b]
        n = len(part) - width + 1
        if n <= 0:
            continue
        ids = _buckets(part)
        spread = mixed(ids)
        place = np.arange(len(ids), dtype=np.uint64)
        least = _least((spread & ~np.uint64(_PLACE)) | (np.uint64(_PLACE) - place), width - GRAM + 1)[:n]
        anchor = (np.uint64(_PLACE) - (least & np.uint64(_PLACE))).astype(np.int64)
        last = np.zeros(n, bool)  # windows that start too near to a document's end
        for e in ends - a:
            last[max(0, e - width + 1) : min(n, e)] = True
        fresh = np.ones(n, bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | last[:-1]
        starts = np.flatnonzero(fresh & ~last)
        stops = np.flatnonzero(~last & np.append((fresh | last)[1:], True)) + 1
        whole = range_hashes(part, starts, stops + width - 1)
        # anchors have the least identifiers of their windows: mixed again, they spread over all parts
        for to, values in zip(out, (mixed(spread[anchor[starts]]), whole, starts + a, stops - starts), strict=True):
            to.append(values)
    return tuple(np.concatenate(x) if x else np.empty(0, np.uint64 if k < 2 else np.int64) for k, x in enumerate(out))


def _grouped(bucket: np.ndarray, whole: np.ndarray):
    """Distinct buckets: (buckets, index of each run, runs, one whole-run identifier, whether all runs agree)."""
    found, index, count = np.unique(bucket, return_inverse=True, return_counts=True)
    low, high = np.full(len(found), np.iinfo(np.uint64).max), np.zeros(len(found), np.uint64)
    order = np.argsort(index, kind="stable")
    if len(order):
        cuts = np.concatenate([[0], np.cumsum(count)[:-1]])
        low, high = np.minimum.reduceat(whole[order], cuts), np.maximum.reduceat(whole[order], cuts)
    return found, index, count, low, low == high


def unrepeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Return (id, n_bytes, n_removed, spans, kept) for every row of ``docs``.

    A byte is removed if a string of ``width`` bytes that covers it also starts
    anywhere else, in the same document or another; strings do not cross documents and
    are judged on the input.  ``spans`` are the maximal removed runs [start, end);
    ``kept`` holds the remaining bytes.  A null text is empty; shorter texts lose
    nothing.  Null and repeated ids are rows like any other.  Ids are integers.  Other
    columns are ignored.  An empty table gives an empty table.
    """
    if not 2 * GRAM < width <= 4 * GRAM:
        raise ValueError(f"width must be over {2 * GRAM} and at most {4 * GRAM}")
    chunks, total = chunked(docs, id_col, text_col, chunk_bytes)
    bits, bits_again = leading_bits(total / 60), leading_bits(total / 6)

    def ask(table: pa.Table) -> pa.Table:
        _, texts, _ = in_order(table)
        bucket, whole, _, _ = _runs(*bytes_of(texts), width)
        found, _, count, low, agree = _grouped(bucket, whole)
        marks = (count > 1).astype(np.uint8) | (~agree).astype(np.uint8) << 1
        short = (found >> np.uint64(32 - bits)).astype(np.uint32)
        return posts(table.column("chunk")[0].as_py(), found, bits, lambda lo, hi: (short[lo:hi].tobytes(), low[lo:hi].tobytes() + marks[lo:hi].tobytes()))

    def match(table: pa.Table) -> pa.Table:
        """Answers by bucket: 0 single, 1 all runs agree, 2 the runs differ."""
        rows = list(messages(table))
        keys = [np.frombuffer(r[2], np.uint32) for r in rows]
        sizes = [len(k) for k in keys]
        whole = np.concatenate([np.frombuffer(r[3][: 8 * n], np.uint64) for r, n in zip(rows, sizes, strict=True)])
        marks = np.concatenate([np.frombuffer(r[3][8 * n :], np.uint8) for r, n in zip(rows, sizes, strict=True)])
        _, index, count, low, agree = _grouped(np.concatenate(keys), whole)
        several = np.bincount(index, marks & 1) > 0
        differ = (np.bincount(index, marks >> 1) > 0) | ~agree
        answer = np.where((count > 1) | several, np.where(differ, 2, 1), 0).astype(np.uint8)
        told = np.split(answer[index], np.cumsum(sizes)[:-1])
        return as_posts([(r[0], r[1], t.tobytes(), None) for r, t in zip(rows, told, strict=True) if t.any()])

    def looked_up(texts: pa.Array, told: pa.Table):
        """The chunk's runs with their answers, and the windows to be refined: (all repeated starts so far, distinct identifiers, their second ones, their counts, starts, index)."""
        raw, offsets = bytes_of(texts)
        bucket, whole, starts, sizes = _runs(raw, offsets, width)
        found, index = np.unique(bucket, return_inverse=True)
        answer = answers(told, len(found), bits, found, np.uint8)[index]

        def every(chosen: np.ndarray) -> np.ndarray:
            n = sizes[chosen]
            return np.repeat(starts[chosen] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)

        open_at = every(answer == 2)
        ids, low = [], []
        order = np.sort(open_at)
        for a, b, _ in _segments(offsets, width):
            n = max(0, b - a - width + 1)
            lo, hi = np.searchsorted(order, [a, a + n])
            if hi > lo:
                grams = _buckets(raw[a:b])
                ids.append(_full(grams, width)[order[lo:hi] - a])
                low.append(_second(grams, width)[order[lo:hi] - a])
        ids = np.concatenate(ids) if ids else np.empty(0, np.uint64)
        low = np.concatenate(low) if low else np.empty(0, np.uint32)
        one, which, count = distinct_pairs(ids, low)
        return raw, offsets, every(answer == 1), ids[one], low[one], count, order, which

    def ask_again(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows or not told.num_rows:
            return as_posts([])
        chunk = table.column("chunk")[0].as_py()
        _, texts, _ = in_order(table)
        _, _, _, distinct, low, count, _, _ = looked_up(texts, told)
        out = posts(chunk, distinct, bits_again, lambda lo, hi: (distinct[lo:hi].tobytes(), low[lo:hi].tobytes() + np.packbits(count[lo:hi] > 1).tobytes()))
        # the first answers pass through the second round, so that the last pass has both
        return pa.concat_tables([out, as_posts([(chunk, -1 - chunk, np.int64(r[1]).tobytes() + r[2], None) for r in messages(told)])])

    def match_again(table: pa.Table) -> pa.Table:
        rows = list(messages(table))
        if not rows or rows[0][1] < 0:
            return table
        keys = [np.frombuffer(r[2], np.uint64) for r in rows]
        low = np.concatenate([np.frombuffer(r[3][: 4 * len(k)], np.uint32) for r, k in zip(rows, keys, strict=True)])
        many = np.concatenate([np.unpackbits(np.frombuffer(r[3][4 * len(k) :], np.uint8))[: len(k)] for r, k in zip(rows, keys, strict=True)])
        _, index, count = distinct_pairs(np.concatenate(keys), low)
        twice = (count > 1) | (np.bincount(index, many) > 0)
        told = np.split(twice[index], np.cumsum([len(k) for k in keys])[:-1])
        return as_posts([(r[0], r[1], np.packbits(t).tobytes(), None) for r, t in zip(rows, told, strict=True) if t.any()])

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        ids, texts, _ = in_order(table)
        parts = told.column("part").to_numpy()
        before = [(r[0], int(np.frombuffer(r[2][:8], np.int64)[0]), r[2][8:], None) for r in messages(told.filter(pa.array(parts < 0)))]
        raw, offsets, sure, distinct, _, count, order, which = looked_up(texts, as_posts(before))
        twice = answers(told.filter(pa.array(parts >= 0)), len(distinct), bits_again, distinct) | (count > 1)
        gone = only_covered(len(raw), np.concatenate([sure, order[twice[which]]]), width)
        spans, kept, removed = [], [], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            mask = gone[a:b]
            x, y = runs_of(mask)
            spans.append([{"start": int(p), "end": int(q)} for p, q in zip(x, y, strict=True)])
            kept.append(raw[a:b][~mask].tobytes())
            removed.append(int(mask.sum()))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"id": pa.array(ids, pa.int64()), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})

    return two_rounds(chunks, ask, match, ask_again, match_again, finish, SCHEMA).withColumnRenamed("id", id_col)
