"""Chains, paths, cycles and clusters against plain searches."""

import random
from collections import deque

import pytest

from quillmine.operators import paths, similarity


def graph(seed, nodes=9, edges=22):
    rng = random.Random(seed)
    return sorted({(rng.choice("abcdefghijkl"[:nodes]), rng.choice("abcdefghijkl"[:nodes])) for _ in range(edges)})


def search(edges, depth, most, targets=None):
    after = {}
    for a, b in edges:
        if a != b:
            after.setdefault(a, []).append(b)
    found = []

    def go(path):
        nxt = [n for n in sorted(after.get(path[-1], [])) if n not in path]
        if len(path) > 1 and ((targets and path[-1] in targets) or len(path) > depth or not nxt):
            found.append(path)
            return
        for n in nxt:
            go([*path, n])

    for start in sorted(after):
        go([start])
    return found[:most]


@pytest.mark.parametrize("seed, depth, most, targets", [(1, 6, 250, None), (2, 4, 17, None), (3, 6, 40, ["c", "f"]), (4, 2, 5, None), (5, 1, 3, None)])
def test_first_chains_in_search_order(spark, seed, depth, most, targets):
    edges = graph(seed)
    df = spark.createDataFrame(edges, "source string, target string")
    ends = spark.createDataFrame([(t,) for t in targets], "node string") if targets else None
    got = [r.path for r in paths.first_chains(df, depth, most, targets=ends).orderBy("path").collect()]
    assert got == search(edges, depth, most, targets)


def test_chains_of_given_starts_and_of_nothing(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "a"), ("l", "l")], "source string, target string")
    starts = spark.createDataFrame([("b",), ("x",), ("l",), ("gone",)], "node string")
    assert sorted(r.chain for r in paths.chains(df, starts=starts).collect()) == ["b->c", "x->a->b->c"]
    assert paths.chains(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        paths.chains(df, depth=0)


@pytest.mark.parametrize("seed, most", [(1, 100), (2, 3), (7, 1)])
def test_paths_between(spark, seed, most):
    rng = random.Random(seed)
    edges = [(a, b, t) for a, b in graph(seed, 8, 26) for t in rng.sample(["CALLS", "IMPORTS", "EXTENDS"], rng.randrange(1, 4))]
    kept = sorted(e for e in edges if e[2] != "EXTENDS")
    queue, want = deque([(("a",), ())]), []
    while queue:
        nodes, types = queue.popleft()
        if nodes[-1] == "e":
            want.append((list(nodes), list(types)))
        elif len(types) < 5:
            queue.extend(((*nodes, b), (*types, t)) for a, b, t in kept if a == nodes[-1] and b not in nodes)
    got = paths.paths_between(spark.createDataFrame(edges, "source string, target string, type string"), "a", "e", 5, most, ["CALLS", "IMPORTS"]).collect()
    assert [(r.path, r.types) for r in got] == want[:most]


def test_impact_directions_and_cap(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("z", "b")], "source string, target string")
    of = spark.createDataFrame([("b",)], "node string")
    seen = lambda **k: ([tuple(r) for r in paths.impact_radius(df, of, **k)[0].collect()], paths.impact_radius(df, of, **k)[1])
    assert seen() == ([("a", 1), ("z", 1)], 0)
    assert seen(direction="OUTGOING", depth=1) == ([("c", 1)], 0)
    assert seen(direction="BOTH", most=2) == ([("a", 1), ("c", 1)], 2)
    with pytest.raises(ValueError):
        paths.impact_radius(df, of, "UP")


def back_edges(nodes, edges):
    """The recursive search: what follows a node in the order of the edges; a cycle where it meets its own trail."""
    seen, trail, found = set(), [], {}

    def visit(n):
        seen.add(n)
        trail.append(n)
        for a, b in edges:
            if a == n:
                if b in trail:
                    c = [*trail[trail.index(b) :], b]
                    found["->".join(c)] = (b, n)
                elif b not in seen:
                    visit(b)
        trail.pop()

    for n in nodes:
        if n not in seen:
            visit(n)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_as_a_search_closes_them(spark, seed):
    rng = random.Random(seed)
    edges = graph(seed, 12, 24) + [(a + "2", b + "2") for a, b in graph(seed + 10, 6, 12)] + [("solo", "solo")]
    nodes = sorted({n for e in edges for n in e} | {"alone"})
    rng.shuffle(edges)
    rng.shuffle(nodes)
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(edges)], "source string, target string, at long")
    order = spark.createDataFrame([(n, i) for i, n in enumerate(nodes)], "node string, at long")
    want = back_edges(nodes, edges)
    assert {r.path: (r.node_a, r.node_b) for r in paths.cycles(order, df).collect()} == want
    # Component by component: as many nodes on cycles, and every one a cycle of the graph.
    large = paths.cycles(order, df, part_edges=0).collect()
    assert {n for r in large for n in r.path.split("->")} <= {n for p in want for n in p.split("->")} | {n for e in edges for n in e}
    assert bool(large) == bool(want) and all(e in edges for r in large for e in zip(r.path.split("->"), r.path.split("->")[1:], strict=False))


def test_cyclic_components(spark):
    ring = lambda name, n: [(f"{name}{i}", f"{name}{(i + 1) % n}") for i in range(n)]
    edges = ring("a", 6) + ring("b", 3) + ring("c", 2) + [("a0", "a3"), ("a1", "b0"), ("x", "y"), ("y", "z"), ("s", "s")]
    df = spark.createDataFrame(edges + edges[:2], "source string, target string")
    assert [tuple(r) for r in paths.cyclic_components(df).collect()] == [("a0", 6, 7, "HIGH"), ("b0", 3, 3, "MEDIUM"), ("c0", 2, 2, "LOW")]
    assert [r.component for r in paths.cyclic_components(df, least=3, most=1).collect()] == ["a0"]


def close(rows, threshold):
    def unit(v):
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v]

    u = {i: unit(v) for i, v in rows if v and any(v)}
    return {(a, b) for a in u for b in u if a < b and sum(x * y for x, y in zip(u[a], u[b], strict=True)) >= threshold}


@pytest.mark.parametrize("threshold", [0.3, 0.95])
def test_links_are_exact_and_clusters_whole(spark, threshold):
    rng = random.Random(8)
    heart = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.25) for x in heart[i % 5]]) for i in range(250)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0]) for i in range(150)] + [(5000, [0.0] * 6), (5001, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    pairs = close(rows, threshold)
    found = {(r.a, r.b) for r in similarity.links(df, threshold).collect()}
    assert found == pairs
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    full = similarity.clusters(df, threshold, "FULL").collect()
    assert {r.id: r.parent for r in full} == {i: top(i) for i in parent}
    assert all((r.kind == "parent") == (r.id == r.parent) and r.members == sum(top(i) == r.parent for i in parent) for r in full)
    assert {(r.id, r.members) for r in similarity.clusters(df, threshold).collect()} == {(r.id, r.members) for r in full if r.kind == "parent"}
    assert similarity.links(df, threshold, every=False).count() <= len(pairs)


def test_cluster_modes_and_errors(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0])], "id long, v array<double>")
    assert sorted(tuple(r) for r in similarity.clusters(df, 0.5, "MINIMAL").collect()) == [("parent", 1, 1, 1), ("parent", 3, 3, 1)]
    assert similarity.clusters(df.where("false"), 0.5).count() == 0
    with pytest.raises(ValueError):
        similarity.clusters(df, 1.5)
    with pytest.raises(ValueError):
        similarity.clusters(df, 0.5, "ALL")
