"""Queries that made far more rows than they have input; each result is compared with a plain search."""

import random

from quillmine.operators import boundaries, relations


def most_joined(df):
    """Rows of the largest join that ran for a collected frame."""
    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        own = node.metrics().get("numOutputRows") if "Join" in kind else None
        rows = own.get().value() if own is not None and own.isDefined() else 0
        children = node.children()
        return max([rows, *(walk(children.apply(i)) for i in range(children.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_tightest_container_meets_few(spark):
    draw = random.Random(5)
    functions = [(draw.choice([1, 2, None]), f, first, first + draw.choice([-3, 0, 1, 2, 7, 8, 60, 900])) for f in range(600) for first in [draw.randint(-40, 60)]]
    calls = [(draw.randint(0, 900), draw.choice([1, 1, 2, 3, None]), draw.choice([None, *range(-50, 120)])) for _ in range(1000)]
    want = {}
    for i, file, line in calls:
        held = [(last - first, first, f) for of, f, first, last in functions if None not in (file, line) and of == file and first <= line <= last]
        if held:
            want[i] = min([*held, *([want[i]] if i in want else [])])
    found = relations.tightest_container(spark.createDataFrame(calls, "id long, file long, line long"), spark.createDataFrame(functions, "file long, function long, first long, last long"))
    rows = found.collect()
    assert len(rows) == len(want) and {r.id: (r.span, r.function) for r in rows} == {i: (s, f) for i, (s, _, f) in want.items()}
    assert most_joined(found) <= len(calls)


def test_declared_contracts_by_every_way(spark, monkeypatch):
    """Contracts in files that all files reach used to meet all of these."""
    draw = random.Random(3)
    letters = [*"abcdefg", " h ", "h", "", None]
    declared = [(draw.choice([None, *range(8)]), draw.randint(0, 9), p, draw.choice(letters)) for p in range(400)]
    contracts = [(draw.choice(["a", "b", "b", "c", "d", "h", None]), draw.choice([*range(12), None])) for _ in range(25)]
    reachable = [(draw.choice([None, *range(8)]), draw.choice([None, *range(12)])) for _ in range(40)]
    times = {}
    for file, declaration, _, name in declared:
        if name and name.strip():
            key = file, declaration, name.strip()
            times[key] = times.get(key, 0) + 1
    want = []
    for (file, declaration, name), k in times.items():
        held = [f for n, f in contracts if n == name]
        own = [f for f in held if f is not None and f == file]
        near = [f for f in held if f is not None and (file, f) in set(reachable) and file is not None]
        n = len(own) or len(near) or len(held)
        want += [(file, declaration, name, "DUPLICATE", "LOW")] * (k - 1)
        want += [(file, declaration, name, *(("MISSING", "HIGH") if n == 0 else ("AMBIGUOUS", "MEDIUM")))] if n != 1 else []
    frames = spark.createDataFrame(declared, "file long, declaration long, position long, name string"), spark.createDataFrame(contracts, "name string, file long"), spark.createDataFrame(reachable, "file long, target long")
    for most in ((16, 256), (2, 256), (16, 2), (1, 1)):
        monkeypatch.setattr(boundaries, "HOLDERS", most[0])
        monkeypatch.setattr(boundaries, "TARGETS", most[1])
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in boundaries.declared_contracts(*frames).collect())
    monkeypatch.undo()
    names = [f"n{i}" for i in range(300)]
    held = spark.createDataFrame([(n, f) for n in names for f in (1, 2)], "name string, file long")
    every = spark.createDataFrame([(f, t) for f in range(10, 210) for t in (1, 2)], "file long, target long")
    one = boundaries.declared_contracts(spark.createDataFrame([(f, 0, 0, names[f]) for f in range(10, 210)], "file long, declaration long, position long, name string"), held, every)
    assert len(one.collect()) == 200 and most_joined(one) <= 200


def test_similar_files_in_blocks(spark, monkeypatch):
    """Pairs that meet on several features used to be made for each of them, and told apart by an exchange."""
    from quillmine.operators import alike, review

    draw = random.Random(8)
    for kinds, most, least, few, block in ((12, 9, 0.6, 2, 16), (900, 40, 0.4, 2, 16), (900, 40, 0.4, 64, 8192), (12, 9, 0.0, 2, 8192)):
        sets = {f"f{i}": {f"w{draw.randrange(kinds)}" for _ in range(draw.randint(1, most))} for i in range(120)}
        sets |= {f"g{i}": s ^ {f"w{draw.randrange(kinds)}"} for i, s in enumerate(list(sets.values())[:60])}
        rows = [(k, x) for k, s in sets.items() for x in s] + [(None, "w1"), ("f1", None), ("f2", None)]
        want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
        want = {p: s for p, s in want.items() if s >= least}
        monkeypatch.setattr(alike, "FEW", few)
        monkeypatch.setattr(alike, "BLOCK", block)
        found = review.similar_files(spark.createDataFrame(rows, "file string, feature string"), least).collect()
        assert len(found) == len(want) and {(r.a, r.b): r.similarity for r in found} == want
    monkeypatch.undo()
    rows = [(i, x) for i in range(400) for x in range(8) if x != i % 8]
    one = review.similar_files(spark.createDataFrame(rows, "file long, feature long"), 0.5)
    assert len(one.collect()) == 400 * 399 // 2
    assert most_joined(one) < 400


def test_links_hold_every_vector_once(spark, monkeypatch):
    """vectors used to be sent to most of the cells, each time whole."""
    from quillmine.operators import similarity
    from quillmine.sources.tables import rewritten

    draw, sizes = random.Random(4), []
    v = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(300)]
    v += [[x + draw.gauss(0, 0.1) for x in v[0]] for _ in range(60)]
    unit = [[x / sum(y * y for y in w) ** 0.5 for x in w] for w in v]
    want = {(i, j) for j in range(360) for i in range(j) if sum(x * y for x, y in zip(unit[i], unit[j], strict=True)) >= 0.8}
    frame = spark.createDataFrame(list(enumerate(v)), "id long, v array<double>")

    def counted(df):
        out = rewritten(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(similarity, "rewritten", counted)
    monkeypatch.setattr(similarity, "SENT", 4000)
    monkeypatch.setattr(similarity, "BLOCK", 16)
    assert {(r.a, r.b) for r in similarity.links(frame, 0.8).collect()} == want
    assert max(sizes) <= 360
    fewer = [(r.a, r.b) for r in similarity.links(frame, 0.8, every=False).collect()]
    assert set(fewer) <= want and len(fewer) < len(want) / 2
    top = list(range(360))
    other = list(range(360))
    for pairs, parent in ((want, top), (fewer, other)):
        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
        parent[:] = [root(x) for x in range(360)]
    assert top == other


def test_shared_state_counts_whole_imports_once(spark):
    """who imports all of a file used to meet each of its symbols."""
    methods = spark.createDataFrame([(f, f"s{s}", "setAll") for f in (1, 2) for s in range(100)], "file long, symbol string, method string")
    imports = [(c, 1, []) for c in range(50)] + [(c, 1, ["s3"]) for c in range(40, 60)] + [(7, 2, ["s1", "s2"]), (8, 2, ["s2"]), (None, 2, [])]
    found = boundaries.shared_state(methods, spark.createDataFrame(imports, "consumer long, file long, symbols array<string>"), ["set"])
    got = {(r.file, r.symbol): (r.consumers, r.severity) for r in found.collect()}
    assert got == {(1, f"s{s}"): (60 if s == 3 else 50, "HIGH") for s in range(100)} | {(2, "s2"): (2, "MEDIUM")}
    assert most_joined(found) <= 200
