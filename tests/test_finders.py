"""Finders: nulls, open ranges, pages, and errors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillmine.operators import finders


def test_find(spark):
    rows = spark.createDataFrame([(1, "Ann", "x", 5.0), (2, None, "x", 7.0), (3, "BANNER", "y", None), (4, "bob", None, 9.0)], "id int, name string, kind string, v double")
    ids = lambda **k: sorted(r.id for r in finders.find(rows, **k).collect())
    assert ids() == [1, 2, 3, 4] and ids(equal={"kind": "x"}) == [1, 2] and ids(equal={"kind": None}) == [4]
    assert ids(among={"kind": ["x", "y"]}) == [1, 2, 3] and ids(among={"kind": []}) == [] and ids(among={"kind": None}) == [1, 2, 3, 4]
    assert ids(between={"v": (5, 7)}) == [1, 2] and ids(between={"v": (7, None)}) == [2, 4] and ids(between={"v": (None, None)}) == [1, 2, 3, 4]
    assert ids(text=" ANN ", within=["name"]) == [1, 3] and ids(text="  ", within=["name"]) == [1, 2, 3, 4] and ids(text="4", within=["name", "id"]) == [4] and ids(text="%", within=["name"]) == []
    assert [r.id for r in finders.find(rows, order=[F.desc("id")], offset=1, limit=2).collect()] == [3, 2] and finders.find(rows, order=["id"], offset=9).count() == 0
    for wrong in ({"limit": 1}, {"offset": -1, "order": ["id"]}):
        with pytest.raises(ValueError):
            finders.find(rows, **wrong)


def test_rules_nodes_and_edges(spark):
    rules = spark.createDataFrame([(1, True, "ts", ["Security", "x"], "file", "LOW"), (2, False, "ts", ["security"], "file", "LOW"), (3, True, None, None, "ccr", "HIGH")], "id int, is_global boolean, language string, categories array<string>, scope string, severity string")
    ids = lambda *a, **k: sorted(r.id for r in finders.library_rules(rules, *a, **k).collect())
    assert ids() == [1, 3] and ids(category=" SECURITY") == [1] and ids("ts", severity="HIGH") == [] and ids(scope="ccr") == [3]
    nodes = spark.createDataFrame([("a", "r", "m", "file", "p"), ("b", "r", "d", "class", "p"), ("c", "q", "m", "file", None)], "id string, repository string, branch string, type string, file_path string")
    assert [r.id for r in finders.graph_nodes(nodes, "r", types=["class", "file"]).collect()] == ["a", "b"] and [r.id for r in finders.graph_nodes(nodes, branch="m", path="p").collect()] == ["a"]
    edges = spark.createDataFrame([("a", "c", "CALLS"), ("c", "b", "CALLS"), ("c", "c", "CALLS"), ("a", "b", "IMPORTS"), ("a", "b", "IMPORTS")], "source string, target string, type string")
    told = lambda **k: [tuple(r) for r in finders.graph_edges(edges, nodes, **k).collect()]
    assert told(path="p") == [("a", "c", "CALLS"), ("a", "b", "IMPORTS"), ("c", "b", "CALLS")] and told(types=["CALLS"], target="b") == [("c", "b", "CALLS")]


def test_summaries(spark):
    scans = spark.createDataFrame([(2, "r", 1, 2, 3, 4.0, dt.datetime(2024, 1, 2)), (1, "r", 1, 2, 3, 6.0, dt.datetime(2024, 1, 2)), (9, "r", 0, 0, 0, 2.0, dt.datetime(2024, 1, 1))], "id int, repository string, files int, nodes int, edges int, duration double, completed_at timestamp")
    assert [tuple(r) for r in finders.scan_summary(scans).collect()] == [("r", 3, 2, 4, 6, 4.0, 1)]
    heat = spark.createDataFrame([("a", 2.0, {"LOW": 1.0, "HIGH": -3.0}, {"bug": 2.0}), ("a", None, {"LOW": 4.0}, None), ("b", -1.0, None, None)], "path string, total double, severities map<string, double>, categories map<string, double>")
    assert {r.path: (r.total, r.severities, r.categories) for r in finders.merged_heatmap(heat).collect()} == {"a": (2.0, {"LOW": 5.0, "HIGH": 0.0}, {"bug": 2.0}), "b": (0.0, {}, {})}
    issues = spark.createDataFrame([(1, 5, "s", "LOW", "p", "k"), (1, 4, "s", "HIGH", "p", "k"), (2, 1, "t", "odd", "p", "k"), (3, 2, "s", "HIGH", "out", "k")], "id int, ordinal int, source string, severity string, path string, kind string")
    scope = spark.createDataFrame([("p",)], "path string")
    assert [(r.id, r.severity) for r in finders.issues_in_scope(issues, scope, ["HIGH", "LOW"]).collect()] == [(1, "HIGH"), (2, "odd")]
    assert [r.id for r in finders.issues_in_scope(issues, None, ["HIGH", "LOW"], 2).collect()] == [3, 1]
    shares = spark.createDataFrame([], "file string, contributor string, lines double, share double")
    assert finders.ownership_summary(shares).first().asDict() == {"files": 0, "lines": 0.0, "primary_owners": 0, "secondary_owners": 0, "mean_owners": 0.0, "mean_top_share": 0.0, "contributors": 0}
