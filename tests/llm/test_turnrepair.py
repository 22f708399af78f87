"""Repair of conversations against trying all edits, and the damage of the query."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tracery.llm.turnrepair import damaged, repair_audit, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string, cost string, hash string"
GRAMMAR = re.compile("(s?(ua)+)?")


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Uniform-cost search over (cost, letters): the first goal is the cheapest and of those the least string."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, shape, kept = heapq.heappop(heap)
        if i == len(rows) and GRAMMAR.fullmatch(shape):
            return cost, audit, kept
        key = (i, shape[-1:] if shape else "", audit, cost)
        if key in done:
            continue
        done.add(key)
        fits = lambda c: re.fullmatch("s?(ua)*u?", shape + c) is not None
        if audit[-2:] != "II":
            for c, role in (("u", "user"), ("a", "assistant")):
                if fits(c):
                    heapq.heappush(heap, (cost + 5, audit + "I", i, shape + c, (*kept, f"{role}:")))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, shape, kept))
        if faults[i] in ("blank", "duplicate"):
            continue
        more = 5 if faults[i] == "truncated" else 0
        if role[:1] and fits(role[:1]):
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, shape + role[0], (*kept, f"{role}:{text}")))
        for c, name in (("u", "user"), ("a", "assistant")):
            if fits(c):
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, shape + c, (*kept, f"{name}:{text}")))
    raise AssertionError


def plain(rows):
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        faults = faults_of(turns)
        cost, audit, kept = cheapest(turns, faults)
        numbers = {t for t, *_ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def got(spark, rows, **options):
    return {r[0]: tuple(r)[1:] for r in repair_audit(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def sample(seed, convs, most=6):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for _ in range(rng.randrange(1, most)):
            turn = rng.choice([None, 0, 1, 2, 3, 4, 5, 9, -1])
            rows.append((c, turn, rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(["a.", "b!", "c", "", " \n", "d? ", "é.", None]), "x", "y"))
    return rows


@pytest.mark.parametrize("block", [1, 2, 1 << 14])
def test_against_trying_all_edits(spark, block):
    rows = sample(block, 60)
    assert got(spark, rows, block=block) == plain(rows)


def test_long_conversation_in_blocks(spark):
    """A conversation of many blocks over many partitions gives what one block gives."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "user", "system"]), f"{t}" + rng.choice([".", "", "!"]), None, None) for t in range(400)]
    assert got(spark, rows, block=3) == got(spark, rows)


def test_odd_input(spark):
    assert got(spark, []) == {}
    empty = hashlib.sha256(b"").hexdigest()
    convs = spark.createDataFrame([(1, 0, "user", "a.", None, None), (None, None, None, None, None, None)], SCHEMA)
    none = repair_audit(convs.where("false"), ids=convs).collect()
    assert sorted(tuple(r)[1:] for r in none) == [(0, 0, 0, 0, 0, 0, "", empty)] * 2 and {r[0] for r in none} == {1, None}
    rows = [(None, None, None, None, None, None), (None, None, "user", "a.", None, None)] + [(3, 1, "user", "a.", None, None)] * 5
    assert got(spark, rows) == plain(rows)
    long = [(4, 0, "user", "é" * 3_000_000 + ".", None, None), (4, 1, "assistant", "b.", None, None)]
    assert got(spark, long)[4][5:7] == (0, "KK")


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "q.", None, None), (1, 1, "user", "a.", None, None), (1, 4, "user", "r.", None, None), (1, 5, "user", " ", None, None)]
    turns = sorted(tuple(r)[1:] for r in repaired_turns(spark.createDataFrame(rows, SCHEMA)).collect())
    cost, audit, kept = cheapest([(r[1], r[2], r[3]) for r in rows], faults_of([(r[1], r[2], r[3]) for r in rows]))
    assert [f"{r}:{t}" for _, _, r, t in turns] == list(kept) and [p for p, *_ in turns] == list(range(len(turns)))
    assert got(spark, rows)[1][5:7] == (cost, audit)


def test_damage(spark):
    rows = [(c, t, r, x, "k", "h") for c in range(20) for t, r, x in ((0, "user", "a? b."), (1, "assistant", "c!"), (None, None, None))]
    out = sorted((r.conv_id, r.turn is not None, r.turn or 0, r.role, r.text) for r in damaged(spark.createDataFrame(rows, SCHEMA)).collect())
    want = []
    for c, t, r, x, *_ in rows:
        r, x = r or " ", x or " "
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            row = (c, t is not None, t or 0, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)
            want += [row] * (2 if kind == 3 else 1)
    assert out == sorted(want)
