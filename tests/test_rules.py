"""Rules, payloads, blueprints and embeddings."""

import datetime as dt
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmine.functions import payloads
from quillmine.operators import rules
from quillmine.sources import blueprints

RULES = [("r1", "REGEX", "No TODO", r"TODO\b.*", "HIGH"), ("r2", "REGEX", "Block", r"\{[^}]*\}", "LOW"), ("r3", "AST", "Long", "3", "MEDIUM"), ("r4", "PROMPT", "Tone", "be kind", "LOW"), ("r5", "REGEX", "Empty", "x*", "LOW")]
RULE = "id string, type string, title string, rule string, severity string"


def test_dispatch(spark):
    def long_lines(path, content, rule):
        return [(i, i, f"over {rule}", line) for i, line in enumerate(content.split("\n"), 1) if len(line.split()) > int(rule)]

    text = "a TODO one\n{b\nc} xx {}\none two three four\nTODO"
    files = spark.createDataFrame([("p", text), ("q", " \n"), ("r", None), (None, "TODO")], "path string, content string")
    verdicts = spark.createDataFrame([("r4", "p", None, None, None, "rude", None), ("r4", "gone", 1, 1, "HIGH", "no", None), ("r1", "p", 1, 1, "HIGH", "not a prompt", None), ("r4", "q", 2, 3, "HIGH", " ", None)], "rule string, path string, line_start int, line_end int, severity string, message string, code string")
    got = sorted((r.rule, r.line_start, r.line_end, r.severity, r.code, r.weight) for r in rules.dispatch(files, spark.createDataFrame(RULES, RULE), long_lines, verdicts).collect())
    assert got == [("r1", 1, 1, "HIGH", "TODO one", 30), ("r1", 5, 5, "HIGH", "TODO", 30), ("r2", 2, 3, "LOW", "{b\nc}", 10), ("r2", 3, 3, "LOW", "{}", 10), ("r3", 4, 4, "MEDIUM", "one two three four", 20), ("r4", 1, 1, "LOW", None, 10), ("r5", 3, 3, "LOW", "xx", 10)]
    twice = spark.createDataFrame([("p", "TODO TODO\nx TODO")], "path string, content string")
    assert rules.dispatch(twice, spark.createDataFrame([("a", "REGEX", "t", "TODO", "LOW")], RULE)).count() == 2
    for wrong in (("b", "REGEX", "t", "(", "LOW"), ("b", "OTHER", "t", "x", "LOW"), ("b", "AST", "t", "x", "LOW")):
        with pytest.raises(ValueError, match="rule b"):
            rules.dispatch(twice, spark.createDataFrame([wrong], RULE))


def test_embedded_once_in_batches(spark, tmp_path):
    log = str(tmp_path / "asked")

    def embed(texts):
        with open(log, "a") as out:
            out.write(json.dumps(texts) + "\n")
        return [[float(len(t)), 1.0] for t in texts]

    rows = [(i, f"t{i % 7}", i) for i in range(40)] + [(99, None, 0)]
    got = {r.id: r.embedding for r in rules.embedded(spark.createDataFrame(rows, "id long, text string, n int"), embed, 3).collect()}
    assert got == {i: [2.0, 1.0] for i in range(40)} | {99: None}
    asked = [json.loads(x) for x in open(log)]
    assert Counter(t for a in asked for t in a) == Counter({f"t{i}": 1 for i in range(7)}) and max(map(len, asked)) <= 3
    df = spark.createDataFrame(rows, "id long, text string, n int")
    for wrong in (lambda t: [[1.0]], lambda t: [[] for _ in t], lambda t: [[float("nan")] for _ in t]):
        with pytest.raises(Exception, match="embedding"):
            rules.embedded(df, wrong, 5).collect()


def test_canonical(spark):
    texts = ['{"b": 1, "a": {"d": [1, {"z": null, "y": "é"}], "c": true}}', "[ 3,\n 1 ]", '"x"', "nope", None, "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: r.j for r in df.select("id", payloads.canonical(F.col("t")).alias("j")).collect()}
    want = {i: json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for i, t in enumerate(texts) if t and t != "nope"}
    assert got == want | {3: None, 4: None}


def test_dates_survive(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    kind = "struct<name: string, at: timestamp, inner: array<struct<on: timestamp, n: int>>, by: map<string, timestamp>>"
    at = dt.datetime(2024, 1, 2, 3, 4, 5, 678000)
    df = spark.createDataFrame([(("x", at, [(at, 1), (None, 2)], {"k": at}),), (("y", None, None, None),), (None,)], f"v {kind}")
    of = df.schema["v"].dataType
    rows = df.select("v", payloads.serialized(F.col("v"), of).alias("j"))
    texts = [r.j for r in rows.collect()]
    mark = {"$date": "2024-01-02T03:04:05.678Z"}
    assert json.loads(texts[0]) == {"name": "x", "at": mark, "inner": [{"on": mark, "n": 1}, {"n": 2}], "by": {"k": mark}} and json.loads(texts[1]) == {"name": "y"} and texts[2] is None
    assert [r.v for r in rows.select(payloads.deserialized(F.col("j"), of).alias("v")).collect()] == [r.v for r in df.collect()]


GOOD = {"version": 2, "layers": [{"name": " ui ", "allow": ["core", "core"]}, {"name": "core"}], "rules": [{"source": "ui", "target": "core", "mode": "allow"}], "modules": [{"name": "m", "layer": "ui", "paths": ["b\\x", "a", "a"]}], "owner": "me", "strict": True}


def test_blueprints(spark):
    def changed(**k):
        return json.dumps(GOOD | k)

    texts = {
        "good": json.dumps(GOOD), "empty": "  ", "list": "[1]", "broken": "{", "version": changed(version=1.5), "layers": changed(layers=[]), "rules": changed(rules=None),
        "twice": changed(layers=[*GOOD["layers"], {"name": "ui"}]), "allowed": changed(layers=[{"name": "ui", "allow": ["db"]}, {"name": "core"}]), "mode": changed(rules=[{"source": "ui", "target": "core", "mode": "maybe"}]),
        "layer": changed(rules=[{"source": "ui", "target": "db", "mode": "allow"}]), "same": changed(rules=GOOD["rules"] * 2), "path": changed(modules=[{"name": "m", "layer": "ui", "paths": ["a"]}, {"name": "n", "layer": "core", "paths": ["a"]}]),
        "module": changed(modules=[{"name": "m", "layer": "db", "paths": []}]), "meta": changed(extra={"a": 1}), "none": None,
    }
    got = blueprints.parse_blueprints(spark.createDataFrame(list(texts.items()), "id string, text string"))
    codes = {}
    for r in got.problems.collect():
        codes.setdefault(r.id, set()).add(r.code)
    assert codes == {
        "empty": {"EMPTY"}, "none": {"EMPTY"}, "list": {"INVALID_ROOT"}, "broken": {"INVALID_ROOT"}, "version": {"INVALID_VERSION"}, "rules": {"INVALID_RULES"}, "twice": {"DUPLICATE_LAYER_NAME"},
        "layers": {"INVALID_LAYERS", "UNKNOWN_RULE_LAYER", "UNKNOWN_MODULE_LAYER"}, "allowed": {"UNKNOWN_ALLOWED_LAYER"}, "mode": {"INVALID_RULE_MODE"}, "layer": {"UNKNOWN_RULE_LAYER"}, "same": {"DUPLICATE_RULE"},
        "path": {"DUPLICATE_MODULE_PATH"}, "module": {"INVALID_MODULE", "UNKNOWN_MODULE_LAYER"}, "meta": {"INVALID_METADATA"},
    }
    assert sorted(tuple(r) for r in got.layers.collect()) == [("good", "core", []), ("good", "ui", ["core"])]
    assert [tuple(r) for r in got.modules.collect()] == [("good", "m", "ui", ["a", "b/x"])] and got.rules.count() == 1
    assert sorted((r.key, r.value) for r in got.metadata.collect()) == [("owner", "me"), ("strict", "true")]


def test_yaml(spark):
    pytest.importorskip("yaml")
    text = "version: 1\nlayers:\n  - name: a\nrules:\n  - {source: a, target: a, mode: forbid}\n"
    got = blueprints.parse_blueprints(blueprints.yaml_as_json(spark.createDataFrame([(1, text), (2, "a: [")], "id long, text string")))
    assert [tuple(r) for r in got.rules.collect()] == [(1, "a", "a", "forbid")] and [r.code for r in got.problems.collect()] == ["INVALID_ROOT"]
