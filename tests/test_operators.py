"""Golden values and small brute-force checks of operators whose SQL can't show them."""

import itertools

import numpy as np
import pytest

from quillmine.operators import graphs, history, metrics, review, scores, source_code


def test_trend_golden(spark):
    rows = [("a", v, i) for i, v in enumerate((2.0, 4.0, 6.0, 8.0))] + [("b", v, i) for i, v in enumerate((8.0, 6.0, 4.0, 2.0))]
    got = {r.file: (r.short_mean, r.long_mean, r.ratio, r.direction) for r in history.trend(spark.createDataFrame(rows, "file string, value double, at int"), 2, 4, 0.2).collect()}
    assert got == {"a": (7.0, 5.0, 0.4, "ACCELERATING"), "b": (3.0, 5.0, -0.4, "DECELERATING")}


def test_dominant_owner(spark):
    authors = "abbaac"
    rows = [(i, "f", a, i) for i, a in enumerate(authors)]
    df = spark.createDataFrame(rows, "id int, file string, author string, at int")
    got = [r.owner for r in history.dominant_owner(df).orderBy("id").collect()]
    count, want, owner = {}, [], None
    for a in authors:
        count[a] = count.get(a, 0) + 1
        owner = a if count[a] == max(count.values()) else owner
        want.append(owner)
    assert got == want == list("abbaaa")
    assert [(r.owner, r.changes) for r in history.owner_periods(df).orderBy("period").collect()] == [("a", 1), ("b", 2), ("a", 3)]
    assert [(r.from_owner, r.to_owner, r.id) for r in history.owner_handoffs(df).orderBy("id").collect()] == [("a", "b", 2 - 1), ("b", "a", 3)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strong_components_brute(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 12, (16, 2))]
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    want = {n: max(m for m in reach[n] if n in reach[m]) for n in nodes}
    assert {r.node: r.component for r in graphs.strong_components(spark.createDataFrame(edges, "source long, target long")).collect()} == want


def test_strong_components_empty(spark):
    assert graphs.strong_components(spark.createDataFrame([], "source long, target long")).count() == 0


def test_similar_files_brute(spark):
    rng = np.random.default_rng(4)
    sets = {i: {int(x) for x in rng.integers(0, 9, 6)} for i in range(40)}
    rows = [(i, x) for i, s in sets.items() for x in s]
    for least in (0.3, 0.5, 0.8, 1.0):
        want = {(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
        assert {(r.a, r.b) for r in review.similar_files(spark.createDataFrame(rows, "file int, feature int"), least).collect()} == want


def test_nearest_each_brute(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(50, 8))
    rows = [(i, [float(x) for x in v[i]]) for i in range(50)] + [(60, None), (61, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = metrics.nearest_each(df.where("id < 5 or id > 55"), df, 3).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(5):
        want = np.argsort(-(u @ u[i]), kind="stable")[:3].tolist()
        assert [r.id for r in sorted((r for r in got if r.query_id == i), key=lambda r: (-r.similarity, r.id))] == want
    assert {r.query_id for r in got} == set(range(5))


def test_source_code(spark):
    code = ["// if a\nif (x && y) { /* for */ s = 'while'; }\n\n  \n", "", "/* only */", 'u = "http://x" // c\n`a\n//b`;']
    df = spark.createDataFrame([(i, c) for i, c in enumerate(code)], "i int, c string")
    rows = df.select("i", source_code.lines_of_code(df.c).alias("loc"), source_code.cyclomatic(df.c, "typescript").alias("cc")).orderBy("i").collect()
    assert [(r.loc, r.cc) for r in rows] == [(1, 3), (0, 0), (0, 0), (2, 1)]
    py = spark.createDataFrame([('"""doc\nif"""\nif a and b:  # or\n    pass\n',)], "c string")
    assert py.select(source_code.lines_of_code(py.c, True), source_code.cyclomatic(py.c, "python")).first()[:] == (2, 3)
    paths = spark.createDataFrame([("a/../../b/./c//",), ("",), ("..",)], "p string")
    assert [r[0] for r in paths.select(source_code.resolved_path(paths.p)).collect()] == ["b/c", "", ""]


def test_metric_rows_unsound_values(spark):
    files = spark.createDataFrame([("a",), ("b",), ("a",), ("c",), ("d",)], "path string")
    loc = spark.createDataFrame([("a", 2.0), ("b", float("nan")), ("c", float("inf")), ("d", -1.0)], "path string, value double")
    got = sorted(map(tuple, review.metric_rows(files, {"loc": loc}).collect()))
    assert got == [("a", 2.0), ("a", 2.0), ("b", 0.0), ("c", 0.0), ("d", 0.0)]


def test_scaling(spark):
    df = spark.createDataFrame([(1000.0, 4), (480.0, 4), (100.0, 4), (1e6, 16), (0.0, 2)], "load double, replicas int")
    n, action = scores.scaling(df.load, df.replicas)
    assert [tuple(r) for r in df.select(n, action).collect()] == [(9, "SCALE_UP"), (4, "NOOP"), (2, "SCALE_DOWN"), (16, "NOOP"), (2, "NOOP")]
