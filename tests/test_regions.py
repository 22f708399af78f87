"""Post-dominators and regions against searches in random graphs."""

import random

from tracery.operators import control


def graphs(seed, methods=8):
    rng = random.Random(seed)
    units, edges = [], []
    for m in range(methods):
        n = rng.randrange(1, 9)
        units += [(f"m{m}", 100 * m + i, i) for i in range(n)]
        for i in range(n - 1):
            for j in {i + 1, *(rng.randrange(n) for _ in range(rng.choice([0, 0, 1, 2])))}:
                edges.append((100 * m + i, 100 * m + j))
        if rng.random() < 0.3:
            edges.append((100 * m + n - 1, 100 * m))
    return units, edges


def ends_without(u, p, succ):
    """Whether an end can be reached from u without p."""
    seen, todo = set(), [u] if u != p else []
    while todo:
        x = todo.pop()
        if x in seen:
            continue
        seen.add(x)
        if not succ.get(x):
            return True
        todo += [y for y in succ[x] if y != p]
    return False


def brute(units, edges):
    succ = {}
    for a, b in edges:
        succ.setdefault(a, set()).add(b)
    after = {}
    for m, u, _ in units:
        can = ends_without(u, None, succ)
        after[u] = {u} | ({p for k, p, _ in units if k == m and not ends_without(u, p, succ)} if can else set())
    by = {u: set() for _, u, _ in units}
    for a, b in edges:
        if len(succ[a]) > 1:
            for u in after[b] - (after[a] - {a}):
                by[u].add((a, b))
    regions = {}
    for m, u, _ in units:
        regions.setdefault((m, tuple(sorted(by[u]))), []).append(u)
    return after, {(m, min(us), u, k, k == 0, False) for (m, _), us in regions.items() for k, u in enumerate(sorted(us))}


def test_against_searches(spark):
    units, edges = graphs(3)
    u = spark.createDataFrame(units, "method string, unit_id long, ord int")
    e = spark.createDataFrame(edges + edges[:3], "src_unit long, dst_unit long")
    after, regions = brute(units, edges)
    assert {r.unit_id: set(r.after) for r in control.post_dominators(u, e).collect()} == after
    assert {tuple(r) for r in control.regions_of(u, e).collect()} == regions


def test_no_edges(spark):
    u = spark.createDataFrame([("m", 1, 0), ("m", 2, 1)], "method string, unit_id long, ord int")
    e = spark.createDataFrame([], "src_unit long, dst_unit long")
    assert {(r.region_id, r.unit_id, r.ord) for r in control.regions_of(u, e).collect()} == {(1, 1, 0), (1, 2, 1)}
