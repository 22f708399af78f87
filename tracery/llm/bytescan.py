"""Vectorised scans of Arrow binary columns: documents as slices of one byte array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_MASK = (1 << 64) - 1
#: Base of the rolling window hash (odd, so it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_SEEDS = np.array([0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93], np.uint64)
#: Bytes of a range from which on it is hashed on its own.
LONG = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit image of a uint64 array (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    up = _powers(BASE, 1)
    down = _powers(_INVERSE, 1)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            cls.up, cls.down = _powers(BASE, size), _powers(_INVERSE, size)
        return cls.up[:n], cls.down[:n]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string array without copying; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    if column.null_count:
        # a null's slice may hold anything: keep only what is valid
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
        if (np.diff(at) != sizes).any():
            raw = np.concatenate([raw[s : s + n] for s, n in zip(at[:-1], sizes, strict=True)] or [raw[:0]])
            at = np.concatenate([[0], np.cumsum(sizes)])
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes together; a longer document comes alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all words, and where each document's words begin (one more entry than documents)."""
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(raw)]
    begins[cuts] = solid[cuts]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[cuts[cuts > 0] - 1] = solid[cuts[cuts > 0] - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range, equal for equal bytes; hashes of different seeds are independent.

    Ranges are taken eight bytes at a time, each step a bijection of what it is given,
    so ranges that differ in eight bytes only never clash.  Long ones are hashed one by one.
    """
    n = ends - starts
    out = mixed(n.astype(np.uint64) ^ _SEEDS[seed])
    # the eight bytes from each place on, without copying
    lanes = np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), 0, (1,))
    live, k = np.flatnonzero((n > 0) & (n <= LONG)), 0
    while len(live):
        left = n[live] - 8 * k
        spare = (8 * np.maximum(8 - left, 0)).astype(np.uint64)
        lane = (lanes[starts[live] + 8 * k] << spare) >> spare
        out[live] = mixed((out[live] ^ lane) * np.uint64(BASE))
        live, k = live[left > 8], k + 1
    return _one_by_one(out, raw, starts, ends, np.flatnonzero(n > LONG), seed)


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, for long ranges."""
    return _one_by_one(np.zeros(len(starts), np.uint64), raw, starts, ends, np.arange(len(starts)), 0)


def _one_by_one(out: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray, seed: int) -> np.ndarray:
    whole = memoryview(np.ascontiguousarray(raw))
    for i, a, b in zip(which.tolist(), starts[which].tolist(), ends[which].tolist(), strict=True):
        out[i] = xxhash.xxh64_intdigest(whole[a:b], seed)
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive entries (the result is ``width - 1`` shorter)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _Powers.upto(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mixed((total[width:] - total[:n]) * down[:n])
