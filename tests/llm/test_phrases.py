"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tracery.llm import phrases
from tracery.llm.phrases import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, chunk string"


def plain(rows, least=30, most=4, top=2000, covered=80):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, most + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in kept.items():
            score, k, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            longer = [b for q, b in kept.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= covered * a for b in longer):
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -score) for r, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def got(spark, rows, **options):
    return sorted(tuple(r) for r in collocations(spark.createDataFrame(rows, SCHEMA), **options).collect())


def sample(seed, docs, words=40):
    rng = random.Random(seed)
    vocab = ["Ab", "ab", "cd", "é", "f\x1cg", "h\x00", "longer-word", "the"]
    rows = []
    for i in range(docs):
        text = "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", " \t", ". ", ",", "\n", " ; "]) for _ in range(rng.randrange(words)))
        rows.append((i, text, rng.choice(["en", "en", "en", "de", None]), "x", "y"))
    return rows


@pytest.mark.parametrize("least, most, top, covered", [(5, 4, 2000, 80), (3, 3, 7, 100), (2, 5, 2000, 50)])
def test_against_plain_counting(spark, least, most, top, covered):
    rows = sample(least, 60)
    want = plain(rows, least, most, top, covered)
    assert want and got(spark, rows, least=least, most_words=most, top=top, covered=covered, chunk_bytes=300) == want


def test_chunks_do_not_matter(spark):
    rows = sample(9, 50)
    assert got(spark, rows, least=4, chunk_bytes=50) == got(spark, rows, least=4, chunk_bytes=1 << 20) == plain(rows, 4)


def test_odd_input(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None, None, None, None), (2, "", "en", None, None), (3, " .\n", "en", None, None)]) == []
    # repeated rows without ids count each time; null and "und" are one language
    rows = [(None, "a b c a b", None, None, None)] * 20 + [(None, "a b", "und", None, None)] * 5
    assert got(spark, rows) == plain(rows) != []
    # ties of score and count go by bytes
    rows = [(1, "z a. é b. y c.", "en", None, None)] * 30
    assert [r[2] for r in got(spark, rows)] == ["y c", "z a", "é b"]


def test_long_text_in_stretches(spark, monkeypatch):
    """Stretches end between words, whatever their size; a word longer than a stretch stays whole."""
    for step in (1, 7, 64):
        monkeypatch.setattr(phrases, "_STEP", step)
        text = "ab cde. " * 50 + "x" * 200 + " ab\tcde,f" + "g h " * 20
        names, codes = phrases._tokens([text.encode(), b"", b" q "])
        tokens = [names[i] for i in codes]
        flat = [w for piece in re.split("[.,]", text) for w in piece.split()] + ["q"]
        assert [t.decode() for t in tokens if t != phrases.END] == flat
    rows = [(1, "one two three four. " * 20000, "en", None, None)]
    monkeypatch.undo()
    assert got(spark, rows) == plain(rows)


def test_clashing_hashes_change_nothing(spark):
    """A clash keeps a candidate that is counted by its words afterwards; here the part of a hash that is sent is cut to nothing."""
    rows = sample(3, 40)
    assert got(spark, rows, least=6) == plain(rows, 6)
    assert plain(rows, 6) != plain(rows, 7)
