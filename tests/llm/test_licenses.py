"""License scans against a plain scan of words."""

import random
import re

from tracery.llm.licenses import NOTICES, PHRASES, diagonals, license_scan, license_spans, templates

SCHEMA = "doc_id long, text string, label string, diag string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]


def plain(text, least=0.8, band=3):
    w, places, base, labels, best = words(text), [], set(), set(), 0.0
    rows = [(label, words(t), True) for t, label in PHRASES.items()] + [(label, words(t), False) for label, t in NOTICES]
    for label, t, exact in rows:
        k = min(3, len(t))
        votes = {}
        for pos in range(len(w) - k + 1):
            for off in range(len(t) - k + 1):
                if w[pos : pos + k] == t[off : off + k]:
                    votes.setdefault(pos - off, set()).add(off)
        if exact:
            here = [i for i in range(len(w) - len(t) + 1) if w[i : i + len(t)] == t]
            places += here
            base |= {label} if here else set()
        groups = []
        for d in sorted(votes):
            if groups and d - groups[-1][-1] <= band:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            cover = lambda ds: len({o + i for d in ds for o in votes[d] for i in range(k)})  # noqa: E731, B023
            span = max(d + max(votes[d]) + k for d in g) - min(d + min(votes[d]) for d in g)
            score = (cover(g) if span <= 1.5 * len(t) else max(cover([d]) for d in g)) / len(t)
            best = max(best, score)
            if not exact and score >= least:
                labels.add(label)
    if base:
        best = 1.0
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), best


def got(spark, rows, **options):
    return sorted((tuple(r) for r in license_scan(spark.createDataFrame(rows, SCHEMA), **options).collect()), key=repr)


def sample(seed, n):
    rng = random.Random(seed)
    pool = [*PHRASES, *(t for _, t in NOTICES)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(5)):
            w = rng.choice(pool).split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], ["x"], [w[i], "y"]]) if len(w) > 1 else w
            parts.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
        texts.append((rng.choice([" ", ". ", "\n", " cc "])).join(parts))
    return texts


def test_against_plain_scan(spark):
    texts = sample(1, 60) + ["the software is the software is " * 30, "gnu general public gnu general public license mit license mit license"]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    assert got(spark, rows) == sorted(((i, *plain(t)) for i, t in enumerate(texts)), key=repr)
    # without a broadcast the result is the same
    assert got(spark, rows, broadcast_runs=0) == got(spark, rows)


def test_notices_with_changes(spark):
    notice = dict(NOTICES)["bsd"].split()
    moved = " ".join([*notice[:8], "surely", *notice[8:]])
    rows = [(1, moved, None, None), (2, " ".join(notice[: len(notice) // 2]), None, None), (3, "x " * 9 + moved, None, None)]
    found = {r[0]: r for r in got(spark, rows)}
    assert found[1][6] == found[3][6] == "bsd" and found[2][6] == "" and found[1][2] == 0
    spans = license_spans(diagonals(spark.createDataFrame(rows, SCHEMA), templates(spark))).where("label = 'bsd' and id = 3").collect()
    assert [(s.start, s.end) for s in spans] == [(9, 9 + len(moved.split()))]


def test_odd_input(spark):
    assert got(spark, []) == []
    zero = (0, 0, None, None, "", "", 0.0)
    rows = [(1, None, None, None), (2, "", None, None), (None, "CC-BY", None, None), (None, "none", None, None), (5, "apache license", "q", None), (5, "apache license", "r", None), (5, "MIT license", None, None)]
    assert got(spark, rows) == sorted([(1, *zero), (2, *zero), (None, *plain("CC-BY")), (None, *plain("none")), (5, *plain("apache license")), (5, *plain("apache license")), (5, *plain("mit license"))], key=repr)
    none = license_scan(spark.createDataFrame(rows[4:5], SCHEMA), templates(spark).where("false")).collect()
    assert [tuple(r)[2:] for r in none] == [(0, None, None, "", "", 0.0)]
    long = "the mit license of " * 300_000
    (one,) = got(spark, [(1, long, None, None)])
    assert one[1:5] == (1_200_000, 300_000, 1, 1_199_997)
