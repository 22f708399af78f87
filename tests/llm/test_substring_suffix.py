"""Operators 1 and 9 against plain loops."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracery.llm import bytescan, substring, suffix
from tracery.llm.chunks import distinct_pairs
from tracery.llm.substring import unrepeated
from tracery.llm.suffix import unrepeated_bytes

SCHEMA = "doc_id long, text string, id int, chunk int, kept string"


def corpus(seed: int) -> list[tuple]:
    """Documents with shared passages, copies, periodic and very long texts, nulls, repeated ids and rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é x", "漢字"]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passages = [words(rng.randint(18, 70)) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = words(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            parts += rng.choice(passages) + words(rng.randint(0, 15))
        docs.append((i, rng.choice([" ", "  ", "\n", "\t"]).join(parts)))
    docs += [(100, None), (101, ""), (102, " \n "), (103, "one two"), (104, "ha " * 300), (105, docs[3][1]), (105, docs[3][1]), (106, docs[5][1]), (106, docs[7][1])]
    docs += [(107, " ".join(words(4000) + passages[0])), (None, " ".join(passages[1])), (None, None)]
    rng.shuffle(docs)
    return [(d, t, 1, 2, "x") for d, t in docs]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))


def expected_words(rows, width=20):
    seen, out = set(), []
    for d, t, *_ in ordered(rows):
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            if key in seen:
                gone[s : s + width] = [True] * width
            seen.add(key)
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def expected_bytes(rows, width=200):
    count = Counter()
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    for _, b in texts:
        count.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def key(r):
    return tuple(str(x) for x in r)


@pytest.mark.parametrize("chunk_bytes", [8 << 20, 3000])
def test_words_against_a_loop(spark, chunk_bytes):
    rows = corpus(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in unrepeated(df, chunk_bytes=chunk_bytes).collect()]
    assert sorted(got, key=key) == sorted(expected_words(rows), key=key)


def test_spans_are_the_removed_words(spark):
    rows = corpus(2)
    for r in unrepeated(spark.createDataFrame(rows, SCHEMA)).collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(0 <= s.start < s.end <= r.n_words for s in r.spans)


@pytest.mark.parametrize("chunk_bytes", [8 << 20, 3000])
def test_bytes_against_a_loop(spark, chunk_bytes):
    rows = corpus(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in unrepeated_bytes(df, chunk_bytes=chunk_bytes).collect()]
    assert sorted(got, key=key) == sorted(expected_bytes(rows), key=key)


def test_long_document_in_segments(spark, monkeypatch):
    """A document longer than a segment finds its own repeats across the segments' borders."""
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefgh ", k=700))
    text = "".join(rng.choices("abcdefgh ", k=900_000)) + passage + "".join(rng.choices("abcdefgh ", k=1_500_000)) + passage
    rows = [(1, text, 1, 2, "x"), (2, passage[100:420], 1, 2, "x")]
    got = {r.doc_id: (r.n_removed, len(r.spans)) for r in unrepeated_bytes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (1400, 2), 2: (320, 1)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert unrepeated(empty).count() == 0
    assert unrepeated_bytes(empty).count() == 0


def test_equal_first_hashes_do_not_decide():
    """Windows and strings whose first hash is the same for all are told apart by the second."""
    low = np.arange(4, dtype=np.uint32)
    one, index, count = distinct_pairs(np.zeros(8, np.uint64), np.tile(low, 2))
    assert len(one) == 4 and count.tolist() == [2] * 4 and index.tolist() == [0, 1, 2, 3] * 2
    rng = np.random.default_rng(3)
    texts, ids = pa.array([" ".join(map(str, rng.integers(0, 1 << 63, 400)))]), rng.integers(0, 1 << 63, 400).astype(np.uint64)
    # the second hashes do not follow from the first ones: both families tell all windows apart
    assert len(np.unique(substring._second(texts, np.arange(381), 20))) == 381
    assert len(np.unique(suffix._second(ids, 200))) == len(suffix._full(ids, 200))


@pytest.mark.parametrize("chunk_bytes", [100, 1 << 20])
def test_rows_that_repeat_an_id(spark, chunk_bytes):
    """Whatever the chunks: of two rows of one id the one whose window starts earlier in its text keeps it, though its text comes later."""
    shared = " ".join(f"s{i}" for i in range(25))
    rows = [(5, "a b c d e f " + shared), (5, "z " + shared), (None, "q r " + shared), (9, shared)]
    out = unrepeated(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=chunk_bytes).collect()
    got = sorted((r.n_words, r.n_removed, bytes(r.kept).decode()) for r in out)
    assert got == [(25, 25, ""), (26, 0, "z " + shared), (27, 25, "q r"), (31, 25, "a b c d e f")]


def thue_morse(levels):
    """Two different strings of a length whose polynomials modulo 2**64 are equal at every odd base."""
    a, b = "a", "b"
    for _ in range(levels):
        a, b = a + b, b + a
    return a, b


def test_words_built_to_clash(spark):
    """Long words that a polynomial modulo 2**64 cannot tell apart are different words, and different bytes."""
    x, y = thue_morse(11)
    head = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{head} {x}", 0, 0, ""), (2, f"{head} {y}", 0, 0, ""), (3, f"{head} {x}", 0, 0, "")]
    out = {r.doc_id: r.n_removed for r in unrepeated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: 0, 2: 0, 3: 20}
    a, b = (np.frombuffer(z.encode(), np.uint8) for z in (x, y))
    at, end = np.array([0]), np.array([len(a)])
    assert bytescan.word_hashes(a, at, end)[0] != bytescan.word_hashes(b, at, end)[0]
    assert bytescan.range_hashes(a, at, end)[0] != bytescan.range_hashes(b, at, end)[0]


def test_word_hashes_depend_on_bytes_and_seed_only():
    rng = np.random.default_rng(3)
    words = [rng.integers(33, 200, n).astype(np.uint8).tobytes() for n in [*range(1, 40), 63, 64, 65, 300]]
    raw = np.frombuffer(b" ".join([*words, *words[::-1]]), np.uint8)
    starts = np.cumsum([0] + [len(w) + 1 for w in [*words, *words[::-1]]])[:-1]
    ends = starts + np.array([len(w) for w in [*words, *words[::-1]]])
    one, two = bytescan.word_hashes(raw, starts, ends), bytescan.word_hashes(raw, starts, ends, 1)
    n = len(words)
    assert (one[:n] == one[n:][::-1]).all() and (two[:n] == two[n:][::-1]).all() and len({*one.tolist(), *two.tolist()}) == 2 * n
