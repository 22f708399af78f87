"""Operator 7 against a plain version: hashes, word table, pooling, network and temperature word by word."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tracery.llm import bytescan, quality

ALL = (1 << 64) - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & ALL
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & ALL
    return x ^ x >> 31


def word_hash(w):
    if len(w) > bytescan.LONG:
        return xxhash.xxh64_intdigest(w, 0)
    h = mixed(len(w) ^ int(bytescan._SEEDS[0]))
    for k in range(0, len(w), 8):
        h = mixed((h ^ int.from_bytes(w[k : k + 8], "little")) * bytescan.BASE & ALL)
    return h


def index_vector(h):
    v = [0.0] * quality.DIM
    for k in range(quality.ONES):
        v[(h >> 12 * k) % quality.DIM] += -1.0 if h >> 60 + k & 1 else 1.0
    return v


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())


def shape(w, before):
    upper, digits = sum(65 <= b <= 90 for b in w), sum(48 <= b <= 57 for b in w)
    letters = upper + sum(97 <= b <= 122 or b >= 128 for b in w)
    case = 0 if upper == 0 else 2 if upper > 1 and 2 * upper > letters else 1
    number = (((w == before) * 4 + min(len(w) - letters - digits, 3)) * 3 + case) * 3 + min(digits, 2)
    return (number * 6 + min(len(w) // 4, 5)) % quality.SHAPES


def table_of(texts):
    table = {}
    for text in texts:
        h = [word_hash(w) for w in words_of(text)]
        for i, a in enumerate(h):
            row = table.setdefault(a % quality.ROWS, [0.0] * quality.DIM)
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(h):
                    for d, x in enumerate(index_vector(h[j])):
                        row[d] += x
    return {k: [x / max(math.sqrt(sum(y * y for y in row)), 1.0) for x in row] for k, row in table.items()}


def pooled(text, table):
    words = words_of(text)
    total = [0.0] * quality.WIDTH
    for i, w in enumerate(words):
        both = table.get(word_hash(w) % quality.ROWS, [0.0] * quality.DIM) + index_vector(mixed(shape(w, words[i - 1] if i else None) + 77))
        total = [a + b for a, b in zip(total, both, strict=True)]
    n = len(words)
    return [x / max(n, 1) for x in total], n / (n + quality.FEW)


def probability(model, vector, weight, temperature):
    z = [(x - m) / s * weight for x, m, s in zip(vector, model.mean, model.scale, strict=True)]
    hidden = [max(sum(a * w for a, w in zip(z, column, strict=True)) + b, 0.0) for column, b in zip(model.w1.T, model.b1, strict=True)]
    out = sum(a * w for a, w in zip(hidden, model.w2, strict=True)) + model.b2
    return 1 / (1 + math.exp(-min(max(out / temperature, -60), 60)))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(12)
    vocabulary = "the The sea SEA calm, 12 3.5 naïve 漢字 and we sail BUY!! NOW http://a.b/c 2024-01-02 x".split()
    texts = {i: " ".join(rng.choices(vocabulary[i % 3 :: 1 + i % 2], k=rng.randint(1, 30))) for i in range(90)}
    texts |= {90: "", 91: None, 92: " \n\t ", 93: "ha ha ha", 94: "w" * 3000}
    labels = {i: int(rng.random() < (0.8 if i % 2 else 0.2)) for i in range(80)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return texts, labels, docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")


def test_scores_word_by_word(corpus):
    texts, labels, docs, table = corpus
    model = quality.fit(docs, table)
    train = [i for i in sorted(labels) if zlib.crc32(str(i).encode()) % 3 != 1]
    words = table_of(texts[i] for i in train)
    for row, vector in words.items():
        assert np.allclose(model.words[row], vector, atol=1e-5)
    assert not np.delete(model.words, list(words), axis=0).any()

    vectors = {i: pooled(t, words) for i, t in texts.items()}
    mean = np.mean([vectors[i][0] for i in train], axis=0)
    assert np.allclose(model.mean, mean, atol=1e-5) and np.allclose(model.scale, np.std([vectors[i][0] for i in train], axis=0) + 1e-3, atol=1e-5)

    def loss(temperature):
        """Over every fifth training row, which the network has not seen."""
        parts = [(labels[i], min(max(probability(model, *vectors[i], temperature), 1e-9), 1 - 1e-9)) for i in train[4::5]]
        return -sum(math.log(p) if y else math.log(1 - p) for y, p in parts) / len(parts)

    grid = [math.exp(-1.5 + 0.05 * k) for k in range(81)]
    assert loss(model.temperature) <= min(loss(t) for t in grid) + 1e-6

    got = {r.doc_id: r.score for r in quality.classify(docs, table).collect()}
    assert set(got) == set(texts)
    for i, vector in vectors.items():
        assert got[i] == pytest.approx(probability(model, *vector, model.temperature), abs=1e-4)
    assert got[90] == got[91] == got[92]


def test_network_finds_what_is_not_linear():
    """An exclusive or of two directions, 10,000 rows at production settings: the network learns it, a line can not.

    2,000 rows are too few for it: they give 0.73.
    """
    rng = np.random.default_rng(3)
    n = 10_000
    side = rng.choice([-1.0, 1.0], (n + 1000, 2))
    x = rng.normal(0, 0.3, (n + 1000, quality.WIDTH))
    x[:, :2] += 2 * side
    y = (side[:, 0] != side[:, 1]).astype(float)
    one = np.concatenate([x, np.ones((n + 1000, 1))], axis=1)
    model = quality._train(one[:n], y[:n], 32, 30, 7)
    p = quality._probability(model, one[n:])
    assert ((p >= 0.5) == y[n:]).mean() > 0.97
    # calibrated: of rows that get a probability, about as many have label 1
    assert abs(p.mean() - y[n:].mean()) < 0.03
    line = np.linalg.lstsq(one[:n], y[:n] - 0.5, rcond=None)[0]
    assert ((one[n:] @ line >= 0) == y[n:]).mean() < 0.65


def test_long_text_is_pooled_in_steps(monkeypatch):
    """Steps of any size give the vectors of whole texts."""
    rng = random.Random(8)
    texts = pa.array([" ".join(rng.choice(["ab", "Cd", "12", "é"]) for _ in range(n)) for n in (0, 1, 700, 3, 90)])
    table = quality._unit(np.random.default_rng(1).normal(size=(quality.ROWS, quality.DIM)))
    whole = quality._pooled(texts, table)
    for step in (7, 64):
        monkeypatch.setattr(quality, "STEP", step)
        assert np.allclose(quality._pooled(texts, table), whole, atol=1e-5)
