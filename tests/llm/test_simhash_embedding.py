"""Operators 5 and 2, and the components they share, against brute force."""

import random
import re

import numpy as np
import xxhash

from tracery.llm.components import components, forest
from tracery.llm.embedding import near_vectors
from tracery.llm.simhash import fingerprint, near_duplicates


def labels_of(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)]
    edges += [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(250)] + [(5, 5), (7, 6), (7, 6)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == labels_of(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_spans():
    rng = np.random.default_rng(1)
    near = rng.random((40, 40)) < 0.04
    near |= near.T
    want = labels_of(range(40), [(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True) if i != j])
    edges = forest(near.copy(), True)
    assert labels_of(range(40), edges) == want
    assert len(edges) == 40 - len(set(want.values()))


def documents():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(50)]
    docs = []
    for i in range(80):
        docs.append((i, " ".join(rng.choices(words, k=rng.randint(1, 80)))))
    for i in range(80, 160):
        base = docs[rng.randrange(80)][1].split()
        if rng.random() < 0.7 and base:
            base[rng.randrange(len(base))] = rng.choice(words)
        docs.append((i, " ".join(base).upper() if rng.random() < 0.3 else " ".join(base)))
    docs += [(200, None), (201, ""), (202, "É a"), (203, "Z"), (204, "z"), (204, "z"), (None, "z"), (205, "x " * 50_000)]
    rng.shuffle(docs)
    return docs


def test_near_duplicates(spark):
    docs = documents()
    df = spark.createDataFrame([(d, t, 0, "c") for d, t in docs], "doc_id long, text string, fp int, component_id string").repartition(4)
    rows = near_duplicates(df).collect()
    assert len(rows) == len(docs)
    prints = {d: plain_fingerprint(t) for d, t in docs if d is not None}
    ids = sorted(prints)
    edges = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = labels_of(ids, edges)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.fingerprint == format(plain_fingerprint("z"), "016x")
        else:
            assert (r.fingerprint, r.component_id) == (format(prints[r.doc_id], "016x"), want[r.doc_id])


def test_fingerprint_of_long_text_in_steps():
    text = " ".join(str(i % 97) for i in range(500)).encode()
    assert fingerprint(text, step=16) == fingerprint(text) == plain_fingerprint(text.decode())


def vectors():
    rng = np.random.default_rng(9)
    rows, i = [], 0
    for label in (0, 1, 2):
        for _ in range(25):
            x = rng.normal(size=16)
            for _ in range(rng.integers(1, 6)):
                rows.append((i, (x + rng.normal(size=16) * 0.08 * np.linalg.norm(x)).tolist(), label))
                i += 1
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (501, rows[0][1], 0), (502, rows[0][1], None), (503, None, 0), (504, [0.0] * 16, 0), (505, [float("nan")] * 16, 0)]
    rows += [(506, [1.0, None] * 8, 0), (507, [], 0), (508, [1.0, 2.0], 0), (509, [2.0, 4.0], 0), (None, rows[0][1], 0), (510, [float("inf")] + [1.0] * 15, 0)]
    return rows


def test_near_vectors(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, rep int, n int").repartition(3)
    plain = df.select("vec_id", "embedding", "label").collect()

    def sound(r):
        v = r.embedding
        return r.vec_id is not None and r.label is not None and v and None not in v and np.isfinite(v).all() and any(v)

    good = [r for r in plain if sound(r)]
    near = {}
    for k, a in enumerate(good):
        x = np.array(a.embedding, float)
        near[k] = [j for j, b in enumerate(good) if j != k and a.label == b.label and len(a.embedding) == len(b.embedding) and x @ np.array(b.embedding, float) / np.linalg.norm(x) / np.linalg.norm(b.embedding) >= 0.93]
    comp = labels_of(range(len(good)), [(k, j) for k in near for j in near[k]])
    least = {}
    for k, c in comp.items():
        least[c] = min(least.get(c, 10**9), good[k].vec_id)
    want = [(r.vec_id, len(near[k]), least[comp[k]], r.vec_id == least[comp[k]]) for k, r in enumerate(good)]
    want += [(r.vec_id, 0, r.vec_id, r.vec_id is not None) for r in plain if not sound(r)]
    for block in (1024, 8):
        got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df, block=block, tables=10).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert near_vectors(df.limit(0)).count() == 0


def test_recall_near_the_threshold(spark):
    """Pairs just above the threshold are the hardest; nine of ten have to be found."""
    rng = np.random.default_rng(4)
    rows, n = [], 400
    for i in range(n):
        x = rng.normal(size=64)
        z = rng.normal(size=64)
        x /= np.linalg.norm(x)
        z -= (z @ x) * x
        z /= np.linalg.norm(z)
        rows += [(2 * i, x.tolist(), 0), (2 * i + 1, (0.935 * x + (1 - 0.935**2) ** 0.5 * z).tolist(), 0)]
    out = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert out.where("n_links > 0").count() / (2 * n) >= 0.9


def test_links_and_components_at_production_settings(spark):
    """Groups of near vectors, some in chains, in 64 dimensions: nearly all links, no wrong ones, components as by brute force."""
    rng = np.random.default_rng(6)
    rows = []
    for g in range(120):
        x = rng.normal(size=64)
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows), (x + rng.normal(size=64) * rng.choice([0.1, 0.22])).tolist(), int(g % 3)))
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (v @ v.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    want = labels_of(range(len(rows)), list(zip(*map(list, np.nonzero(near)), strict=True)))
    out = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    links, found = near.sum(axis=1), np.array([out[i].n_links for i in range(len(rows))])
    assert links.sum() > 500 and (found <= links).all() and found.sum() >= 0.98 * links.sum()
    assert np.mean([out[i].component_id == want[i] for i in range(len(rows))]) >= 0.98
