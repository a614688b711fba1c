"""Golden vectors, and cases that the driver's tables don't show."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillmine.operators import insights, scores, source_code


def test_coupling_of_files(spark):
    rows = [(n, f, 0) for n, files in enumerate(["abc", "ab", "ad", "z"]) for f in files]
    got = insights.coupling_of(spark.createDataFrame(rows, "commit int, file string, at int"), spark.createDataFrame([("b",), ("d",), ("d",), ("none",)], "file string"))
    assert {(r.left, r.right): (r.shared, r.strength) for r in got.collect()} == {("a", "b"): (2, 0.6667), ("b", "c"): (1, 0.5), ("a", "d"): (1, 0.3333)}


def test_rolling_trends_golden(spark):
    day = lambda i: dt.datetime(2026, 1, 1 + i)
    series = {"a": [2, 4, 6, 8], "b": [8, 6, 4, 2], "c": [5, 5, 5, 5], "z": [0, 0], "one": [3]}
    rows = [(f, day(i), float(v)) for f, values in series.items() for i, v in enumerate(values)]
    got = {r.file: r for r in insights.rolling_trends(spark.createDataFrame(rows, "file string, at timestamp, value double"), (4, 2), 0.2, -0.2).collect()}
    told = lambda f: (got[f].samples, got[f].latest, got[f].short_mean, got[f].long_mean, got[f].delta, got[f].ratio, got[f].direction)
    assert told("a") == (4, 8, 7, 5, 2, 0.4, "ACCELERATING") and told("b") == (4, 2, 3, 5, -2, -0.4, "DECELERATING") and told("c") == (4, 5, 5, 5, 0, 0, "STABLE")
    assert told("z") == (2, 0, 0, 0, 0, 0, "STABLE") and [tuple(x) for x in got["a"].rolling] == [(2, 2, 7.0), (4, 4, 5.0)] and [tuple(x) for x in got["one"].rolling] == [(2, 1, 3.0), (4, 1, 3.0)]


def test_correlated_points_golden(spark):
    rows = [("a", 10.0, 2.0), ("b", 20.0, 4.0), ("c", 30.0, 6.0), ("d", 40.0, 8.0)]
    df = spark.createDataFrame(rows, "file string, complexity double, churn double")
    got = {r.file: r for r in insights.correlated_points(df).collect()}
    assert [(got[f].scaled_complexity, got[f].scaled_churn) for f in "abcd"] == [(0, 0), (0.333333, 0.333333), (0.666667, 0.666667), (1, 1)]
    assert [f for f in "abcd" if got[f].hotspot] == ["d"]
    flat = insights.correlated_points(df.withColumn("churn", F.lit(1.0))).collect()
    assert {r.scaled_churn for r in flat} == {0.0}


def test_priorities_and_gates(spark):
    rows = [(1, "security", "LOW"), (2, "Breaking  Change", "high"), (3, "style", "CRITICAL"), (4, "", "odd"), (5, "security", "low"), (6, None, None), (7, "bug", "HIGH")]
    df = spark.createDataFrame(rows, "ordinal long, category string, severity string")
    got = insights.prioritized(df, 3).orderBy("place").collect()
    assert [(r.ordinal, r.score, r.discarded) for r in got] == [(3, 53, None), (2, 48, None), (7, 45, None), (1, 30, "low_priority"), (5, 30, "low_priority"), (4, 0, "low_priority"), (6, 0, "low_priority")]
    kept = lambda *a: sorted(r.ordinal for r in insights.severity_gate(df, *a).where("discarded is null").collect())
    assert kept("INFO", {}) == [1, 2, 3, 4, 5, 6, 7] and kept("low", {"LOW": 1, "HIGH": 1}) == [1, 2, 3] and kept("HIGH", {"CRITICAL": 0}) == [2, 7]
    assert insights.severity_gate(df, "LOW", {}).count() == 7 and insights.prioritized(df.where("false"), 3).count() == 0


def test_path_tree(spark):
    rows = [("src/a.ts", 3), ("/src//deep/b.ts", 4), ("c.ts", None), ("src/a.ts", 1), ("", 9)]
    got = {r.path: r for r in insights.path_tree(spark.createDataFrame(rows, "path string, loc long"), ["loc"]).collect()}
    assert {p: (r.parent, r.name, r.folder, r.files, r.folders, r.loc) for p, r in got.items()} == {
        "": (None, "", True, 1, 1, 8), "src": ("", "src", True, 1, 1, 8), "src/deep": ("src", "deep", True, 1, 0, 4), "src/a.ts": ("src", "a.ts", False, 0, 0, 4), "src/deep/b.ts": ("src/deep", "b.ts", False, 0, 0, 4), "c.ts": ("", "c.ts", False, 0, 0, 0),
    }


def test_merged_configs(spark):
    layers = [("r", 2, '{"a": {"x": 2}, "list": [9]}'), ("r", 1, '{"a": {"x": 1, "y": {"z": 1}}, "list": [1, 2], "k": null}'), ("r", 3, "[1]"), ("r", 4, "nope"), ("r", 5, '{"a": {"y": 5}}'), ("s", 1, None)]
    got = {r.scope: json.loads(r.body) for r in insights.merged_configs(spark.createDataFrame(layers, "scope string, position int, body string")).collect()}
    assert got == {"r": {"a": {"x": 2, "y": 5}, "list": [9], "k": None}, "s": {}}


def test_metric_rows_and_diffs(spark):
    paths = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    metrics = spark.createDataFrame([("a", float("nan"), 7.0, 0.5, "now"), ("b", -1.0, 4.0, None, "then"), ("x", 1.0, 1.0, None, None)], "path string, loc double, issue_count double, coverage double, last_review string")
    heat = spark.createDataFrame([("a", 2), ("a", 3)], "path string, total long")
    got = sorted(tuple(r) for r in insights.file_metric_rows(paths, metrics, heat, ["loc"]).collect())
    assert got == [("a", 0.0, 5.0, 0.5, None), ("b", 0.0, 4.0, None, "then"), ("c", 0.0, 0.0, None, None)]
    b = spark.createDataFrame([("k", 1, 5), ("same", 1, None), ("gone", 2, 2), ("null", None, 1)], "file string, loc int, churn int")
    a = spark.createDataFrame([("k", 4, 5), ("same", 1, None), ("new", 7, None), ("null", 3, 1)], "file string, loc int, churn int")
    rows = {r.file: (r.state, r.delta_loc, r.delta_churn) for r in insights.metric_diff(b, a, "file", ["loc", "churn"]).collect()}
    assert rows == {"k": ("changed", 3, None), "gone": ("removed", -2, -2), "new": ("added", 7, None), "null": ("changed", 3, None)}


def test_graph_diff(spark):
    nodes = "id string, name string, metadata map<string, string>"
    b = spark.createDataFrame([("1", "x", {"k": "1", "l": "2"}), ("2", "y", None), ("3", "z", {})], nodes)
    a = spark.createDataFrame([("1", "x", {"l": "2", "k": "1"}), ("2", "y", {"n": "1"}), ("4", "w", None)], nodes)
    edges = lambda *e: spark.createDataFrame(e, "source string, target string, type string")
    got = {tuple(r) for r in insights.graph_diff((b, edges(("1", "2", "CALLS"), ("1", "2", "IMPORTS"))), (a, edges(("1", "2", "CALLS"), ("2", "1", "CALLS")))).collect()}
    assert got == {("node", "changed", "2", None, None), ("node", "removed", "3", None, None), ("node", "added", "4", None, None), ("edge", "removed", "1", "2", "IMPORTS"), ("edge", "added", "2", "1", "CALLS")}


def test_references(spark):
    uses = spark.createDataFrame([(1, "f", "one"), (2, "f", "many"), (3, "g", "many"), (4, "f", "none"), (5, "h", "many")], "use int, file string, symbol string")
    candidates = spark.createDataFrame([("one", "t"), ("many", "u"), ("many", "t"), ("many", "w"), ("many", "u")], "symbol string, target string")
    imports = spark.createDataFrame([("f", "u"), ("g", "u"), ("g", "t")], "file string, target string")
    rows = {r.use: (r.status, r.target, r.confidence, r.reason, r.candidates) for r in insights.resolved_references(uses, candidates, imports, 0.9, 0.6, show=2).collect()}
    assert rows[1] == ("resolved", "t", 0.6, None, None) and rows[2] == ("resolved", "u", 0.9, None, None)
    assert rows[3] == ("unresolved", None, None, "AMBIGUOUS_SYMBOL", ["t", "u"]) and rows[4] == ("unresolved", None, None, "SYMBOL_NOT_FOUND", None) and rows[5][3] == "AMBIGUOUS_SYMBOL"
    strict = {r.use: r.reason for r in insights.resolved_references(uses, candidates, imports, 0.9, 0.6, least=0.7).collect()}
    assert strict[1] == "LOW_CONFIDENCE" and strict[2] is None


def test_breaking_changes(spark):
    exports = "file string, symbol string"
    before = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("c", "k")], exports)
    after = spark.createDataFrame([("a", "x"), ("c", "k"), ("d", "n")], exports)
    imports = spark.createDataFrame([("i", "a", ["y"]), ("j", "a", ["x"]), ("k", "a", []), ("l", "b", ["other"]), ("m", "b", ["z"])], "file string, target string, symbols array<string>")
    got = {(r.kind, r.file, r.symbol): (r.total, r.importers, r.truncated) for r in insights.breaking_changes(before, after, imports, 1).collect()}
    assert got == {("REMOVED_SYMBOL_EXPORT", "a", "y"): (2, ["i"], True), ("REMOVED_FILE_EXPORT_SURFACE", "b", None): (2, ["l"], True)}


def test_silos_leaderboard_and_costs(spark):
    files = spark.createDataFrame([("s", 1, 4.0, 1.0), ("s", 2, 90.0, 90.0), ("t", 3, 1.0, 1.0)], "silo string, file int, complexity double, churn double")
    owners = spark.createDataFrame([(1, "o"), (1, "o"), (9, "p")], "file int, owner string")
    assert [tuple(r) for r in scores.silos(files, owners).collect()] == [("s", 1, 1, 69)]
    board = spark.createDataFrame([(1, 1, 10.0, 5.0, 1.0), (2, 2, None, 3.0, 0.0)], "file int, position int, complexity double, churn double, bugs double")
    people = spark.createDataFrame([("a", "Zed", 50), ("b", "Abe", 50), ("c", "Bob", 0)], "person string, name string, commits int")
    got = {r.person: r for r in scores.leaderboard(board, people, spark.createDataFrame([(2, "a"), (2, "a"), (7, "b")], "file int, person string")).collect()}
    # Abe and Bob own nothing and are measured by the first file.
    assert (got["a"].quality_month, got["a"].quality_sprint, got["a"].quality_quarter, got["a"].place) == (96, 101, 92, 1)
    assert (got["b"].quality_month, got["b"].velocity_month, got["b"].ownership_quarter, got["b"].place) == (58, 59, 52, 2) and (got["c"].quality_sprint, got["c"].velocity_quarter, got["c"].place) == (61, 1, 3)
    usage = spark.createDataFrame([("m", 1000, 10, 0, 1010), ("m", 1, 0, None, 1), ("n", 2000, 0, 3, 2003)], "model string, input long, output long, reasoning long, total long")
    by_model = scores.cost_by_model(usage, {"m": (0.01, 0.1, 0.0)}, (0.5, 0.5, 1.0))
    assert {r.model: (r.tokens, r.cost) for r in by_model.collect()} == {"m": (1011, 0.01101), "n": (2003, 1.003)} and scores.total_cost(by_model).first().cost == 1.01401
    with pytest.raises(ValueError):
        scores.record_cost({"m": (-1, 0, 0)}, (0, 0, 0))


def test_dates_and_redaction(spark):
    texts = ["2024-01-02T10:00:00Z", "2024-01-02", "2024-01-02T10:00:00.250+02:00", "2024-01-02T10:00:00", "soon", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    at = lambda *a: int(dt.datetime(2024, 1, 2, *a, tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert [r.ms for r in df.orderBy("i").select(source_code.date_millis(F.col("t")).alias("ms")).collect()] == [at(10), at(), at(8) + 250, at(10), -(2**63), -(2**63)]
    value = {"a": ["me@x.org", "fine", 3], "Email ": 7, "deep": {"token": {"x": 1}, "note": "mail a@b.c"}, "ok": True}
    row = spark.createDataFrame([(json.dumps(value),), ("nope",), ('"x@y.z"',), (None,)], "t string").select(source_code.redacted_json(F.col("t")).alias("j")).collect()
    assert json.loads(row[0].j) == {"a": ["[REDACTED]", "fine", 3], "Email ": "[REDACTED]", "deep": {"token": "[REDACTED]", "note": "[REDACTED]"}, "ok": True}
    assert [r.j for r in row[1:]] == [None, '"[REDACTED]"', None]


def test_rates_patterns_and_limits(spark):
    now = dt.datetime(2024, 1, 15)
    rows = [("r", "false_positive", now - dt.timedelta(hours=168 * (i % 2)), now) for i in range(10)] + [("r", "accepted", now, now)] * 2 + [(" ", "accepted", now, now), ("q", "accepted", now + dt.timedelta(days=3), now)]
    rates = insights.rule_rates(spark.createDataFrame(rows, "rule string, kind string, at timestamp, as_of timestamp"))
    assert {r.rule: (r.n, r.weight) for r in rates.collect()} == {"r": (12, 9.5), "q": (1, 1.0)}
    assert [tuple(r) for r in insights.false_positives(rates).collect()] == [("r", 0.789474, "DEACTIVATE_RULE")]
    assert {r.rule: (r.score, r.confidence) for r in insights.team_patterns(rates).collect()} == {"r": (-0.578947, 1.0), "q": (1.0, 0.2)}
    calls = spark.createDataFrame([(i, "k", dt.datetime(2024, 1, 1, 0, 0, s)) for i, s in enumerate((0, 10, 20, 59))], "id int, key string, at timestamp")
    assert [(r.admitted, r.retry_after) for r in insights.limited_calls(calls, 60, 2).orderBy("id").collect()] == [(True, None), (True, None), (False, 40), (False, 1)]


def test_coupling_of_bulk_commits(spark, monkeypatch):
    from collections import Counter
    from itertools import combinations

    from quillmine.operators import history

    rows = [(1, f, 5) for f in range(23)] + [(2, f, 7) for f in range(0, 23, 3)] + [(3, 4, 1), (2, 3, 9), (2, 3, 8)]
    df = spark.createDataFrame(rows, "commit int, file int, at int")
    sets = [{f for c, f, _ in rows if c == k} for k in (1, 2, 3)]
    want = Counter(p for s in sets for p in combinations(sorted(s), 2))
    for size in (history.BULK, 5):
        monkeypatch.setattr(history, "BULK", size)
        got = {(r.left, r.right): (r.shared, r.last_at) for r in history.temporal_coupling(df).collect()}
        assert {p: n for p, (n, _) in got.items()} == want and got[(3, 6)] == (2, 9) and got[(0, 3)] == (2, 7)


def test_running_sums_of_a_hot_key(spark):
    from itertools import accumulate

    from quillmine.operators import windows

    rows = [("hot", i, i % 5) for i in range(400)] + [(None, i, 1) for i in range(10)] + [(f"k{i}", 0, i) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, at int, v int").repartition(3)
    got = windows.running_sums(df, ["k"], ["at"], {"total": F.col("v"), "n": F.lit(1)}, ranges=6).collect()
    assert len(got) == len(rows)
    for key in {k for k, _, _ in rows}:
        mine = sorted((r.at, r.v, r.total, r.n) for r in got if r.k == key)
        assert [m[2] for m in mine] == list(accumulate(m[1] for m in mine)) and [m[3] for m in mine] == list(range(1, len(mine) + 1))
    assert windows.running_sums(df.where("false"), ["k"], ["at"], {"n": F.lit(1)}).count() == 0
