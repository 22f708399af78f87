"""Substring deduplication of words by fixed-block anchors.

Every document is cut into blocks of ``window // 2`` words that do not overlap; these
are the index.  Any window of ``window`` words contains a whole block, so a repeated
window shows as a hit when all rolling windows of a block's length are probed against
the index.  Hits are extended on both sides, word by word, to the windows around them; those
are compared by their own hash, which gives each repeat its full length, and every
occurrence but the first (by document id, then by position) is removed.

A block's hash has 64 bits, of which 32 and the part's number cross the network; a clash
there costs a comparison, not a wrong result.  A window is known by 96 bits, 64 and 32
of two hashes of the text: among n different windows a clash has a probability of about n**2 / 2**97.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytescan import bytes_of, pieces, window_hashes, word_hashes, words_of
from .chunks import CHUNK_BYTES, answers, as_posts, chunked, distinct_pairs, in_order, leading_bits, messages, only_covered, posts, runs_of, two_rounds

PLACE = np.dtype([("id", np.int64), ("start", np.int32), ("low", np.uint32)])
SCHEMA = "id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept binary"


def _words(texts: pa.Array, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a chunk and where each document's words begin."""
    raw, offsets = bytes_of(texts)
    hashes, firsts, n = [], [np.zeros(1, np.int64)], 0
    for lo, hi in pieces(offsets):
        part, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = words_of(part, at)
        hashes.append(word_hashes(part, starts, ends, seed))
        firsts.append(first[1:] + n)
        n += len(starts)
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.concatenate(firsts)


def _windows(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the windows that lie within one document."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(words))
    inside = np.flatnonzero(left[: max(0, len(words) - width + 1)] >= width)
    return window_hashes(words, width)[inside], inside


def _second(texts: pa.Array, starts: np.ndarray, width: int) -> np.ndarray:
    """32 bits of another hash of the windows at ``starts``, from other hashes of their words."""
    return (window_hashes(_words(texts, 1)[0], width)[starts] >> np.uint64(32)).astype(np.uint32) if len(starts) else np.empty(0, np.uint32)


def _blocks(words: np.ndarray, first: np.ndarray, block: int):
    """Distinct hashes of the rolling blocks; for each whether it is an anchor and whether it repeats here; the hash index of each start."""
    hashes, at = _windows(words, first, block)
    offset = at - np.repeat(first[:-1], np.diff(first))[at]
    distinct, which, count = np.unique(hashes, return_inverse=True, return_counts=True)
    anchor = np.zeros(len(distinct), bool)
    anchor[which[offset % block == 0]] = True
    return distinct, anchor, count > 1, which, at


def unrepeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Return (id, n_words, n_removed, spans, kept) for every row of ``docs``.

    ``spans`` are the removed runs as word positions [start, end); ``kept`` holds the
    other words, unchanged, joined by one space, as UTF-8.  Windows are judged on the
    input.  A null or empty text has no words and an empty ``kept``; documents with
    fewer than ``window`` words lose nothing.  A null id comes after all others; of
    rows that repeat an id the one whose window starts earliest in its own text has it
    first, and of equal starts one of them.  Ids are integers.  Other columns are ignored.  An empty table gives an empty table.
    """
    block = window // 2
    chunks, total = chunked(docs, id_col, text_col, chunk_bytes)
    bits = leading_bits(total / 5)

    def ask(table: pa.Table) -> pa.Table:
        _, texts, _ = in_order(table)
        distinct, anchor, _, _, _ = _blocks(*_words(texts), block)
        short = (distinct >> np.uint64(32 - bits)).astype(np.uint32)
        return posts(table.column("chunk")[0].as_py(), distinct, bits, lambda lo, hi: (short[lo:hi].tobytes(), np.packbits(anchor[lo:hi]).tobytes()))

    def match(table: pa.Table) -> pa.Table:
        rows = list(messages(table))
        keys = [np.frombuffer(r[2], np.uint32) for r in rows]
        anchors = [np.unpackbits(np.frombuffer(r[3], np.uint8))[: len(k)] for r, k in zip(rows, keys, strict=True)]
        _, which, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        hit = (count > 1) & (np.bincount(which, np.concatenate(anchors)) > 0)
        told = np.split(hit[which], np.cumsum([len(k) for k in keys])[:-1])
        return as_posts([(r[0], r[1], np.packbits(t).tobytes(), None) for r, t in zip(rows, told, strict=True) if t.any()])

    def candidates(texts: pa.Array, words: np.ndarray, first: np.ndarray, keys: np.ndarray, told: pa.Table):
        """Windows around a hit: (distinct hashes, their second hashes, first start of each, all starts, hash index of each start)."""
        distinct, anchor, again, which, at = _blocks(words, first, block)
        hit = answers(told, len(distinct), bits, distinct) | (anchor & again)
        hashes, starts = _windows(words, first, window)
        near = np.zeros(len(words) + 1, np.int32)
        near[at[hit[which]] + 1] = 1
        near = np.cumsum(near)
        # a window from s holds the blocks from s to s + window - block
        chosen = near[np.minimum(starts + window - block + 1, len(words))] > near[starts]
        starts, hashes = starts[chosen], hashes[chosen]
        low = _second(texts, starts, window)
        turn = starts
        if (keys[1:] == keys[:-1]).any():
            doc = np.searchsorted(first, starts, "right") - 1
            turn = np.empty_like(starts)
            turn[np.lexsort((starts, starts - first[doc], keys[doc]))] = np.arange(len(starts))
        one, index, _ = distinct_pairs(hashes, low, turn)
        return hashes[one], low[one], starts[one], starts, index

    def ask_again(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return as_posts([])
        chunk = table.column("chunk")[0].as_py()
        _, texts, keys = in_order(table)
        words, first = _words(texts)
        found, low, one, _, _ = candidates(texts, words, first, keys, told)
        doc = np.searchsorted(first, one, "right") - 1
        place = np.empty(len(one), PLACE)
        place["id"], place["start"], place["low"] = keys[doc], one - first[doc], low
        out = posts(chunk, found, bits, lambda lo, hi: (found[lo:hi].tobytes(), place[lo:hi].tobytes()))
        # the first answers pass through the second round, so that the last pass has both
        kept = [(chunk, -1 - chunk, np.int64(part).tobytes() + bits_, None) for _, part, bits_, _ in messages(told)]
        return pa.concat_tables([out, as_posts(kept)])

    def match_again(table: pa.Table) -> pa.Table:
        rows = list(messages(table))
        if not rows or rows[0][1] < 0:
            return table
        keys = [np.frombuffer(r[2], np.uint64) for r in rows]
        places = np.concatenate([np.frombuffer(r[3], PLACE) for r in rows])
        sizes = [len(k) for k in keys]
        every, chunk = np.concatenate(keys), np.repeat([r[0] for r in rows], sizes)
        order = np.lexsort((chunk, places["start"], places["id"], places["low"], every))
        later = np.zeros(len(every), bool)
        later[order[1:]] = (every[order[1:]] == every[order[:-1]]) & (places["low"][order[1:]] == places["low"][order[:-1]])
        told = np.split(later, np.cumsum(sizes)[:-1])
        return as_posts([(r[0], r[1], np.packbits(t).tobytes(), None) for r, t in zip(rows, told, strict=True) if t.any()])

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        ids, texts, keys = in_order(table)
        words, first = _words(texts)
        parts = told.column("part").to_numpy()
        before = [(r[0], int(np.frombuffer(r[2][:8], np.int64)[0]), r[2][8:], None) for r in messages(told.filter(pa.array(parts < 0)))]
        found, _, one, starts, index = candidates(texts, words, first, keys, as_posts(before))
        later = answers(told.filter(pa.array(parts >= 0)), len(found), bits, found)
        repeats = starts[later[index] | (starts != one[index])]
        gone = only_covered(len(words), repeats, window)
        kept, spans = [], []
        for k, text in enumerate(texts):
            own = (text.as_py() or b"").split()
            mask = gone[first[k] : first[k + 1]]
            if mask.any():
                own = [w for w, out in zip(own, mask.tolist(), strict=True) if not out]
            kept.append(b" ".join(own))
            a, b = runs_of(mask) if mask.any() else ((), ())
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)])
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), first[:-1]) * (np.diff(first) > 0) if len(ids) else np.empty(0, np.int64)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table({"id": pa.array(ids, pa.int64()), "n_words": pa.array(np.diff(first)), "n_removed": pa.array(removed), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})

    return two_rounds(chunks, ask, match, ask_again, match_again, finish, SCHEMA).withColumnRenamed("id", id_col)
