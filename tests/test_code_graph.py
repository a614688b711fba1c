"""Code graphs, file trees and scans of small hand-made inputs."""

import datetime as dt
import random
import re

import pytest

from quillmine.operators import code_graph, file_tree
from tests.test_streaming import replayed


def loc(first, last=None):
    return (first, last or first, 0, 0)


def parsed(path, imports=(), aliases=(), interfaces=(), enums=(), classes=(), functions=(), calls=()):
    return (path, "typescript", False, [(s, loc(1)) for s in imports], list(aliases), list(interfaces), list(enums), list(classes), list(functions), list(calls))


def function(name, first, last, parent=None):
    return (name, "function", True, False, parent, loc(first, last))


FILES = [
    parsed(
        "src/app.ts", imports=["./lib/base", "./types.ts", "./util", "left-pad", "../gone"],
        interfaces=[("Wide", True, ["Shape"], loc(2))],
        classes=[("App", True, ["Base<string>"], ["Shape", "Wide[]", "Base"], loc(5, 30)), ("Own", False, ["Only"], [], loc(40, 50))],
        functions=[function("run", 6, 20, "App"), function("run", 10, 12), function("stop", 21, 29, "App"), function("help", 60, 70), function("twin", 71, 72), function("twin", 73, 74)],
        calls=[("run", "this.stop", loc(7)), ("run", "help", loc(11)), ("run", "save", loc(13)), ("App.stop", "Base.load", loc(22)), ("help", "far", loc(99)), ("help", "twin", loc(61)), ("twin", "far", loc(99)), ("ghost", "help", loc(61)), (None, "help", loc(1)), ("help", "this.x", loc(62))],
    ),
    parsed("src/lib/base.ts", classes=[("Base", True, [], [], loc(1, 9))], functions=[function("load", 2, 3, "Base"), function("save", 20, 21)]),
    parsed("src/types.ts", interfaces=[("Shape", True, [], loc(1))], aliases=[("Alias", True, loc(4))], enums=[("Kind", True, ["A", "B"], loc(5))]),
    parsed("src/util/index.tsx", functions=[function("save", 1, 2), function("twin", 3, 4)]),
    parsed("other/only.ts", classes=[("Only", True, [], [], loc(1))], functions=[function("far", 2, 3)]),
    parsed(" other\\two.ts ", functions=[function("twin", 3, 4)]),
]


def test_nodes(spark):
    got = {r.id: r for r in code_graph.nodes(spark.createDataFrame(FILES, code_graph.FILES)).collect()}
    assert {"file:src/app.ts", "file:other/two.ts", "class:src/app.ts:App:5", "function:src/app.ts:App:run:6", "function:src/app.ts:global:run:10", "type:src/types.ts:type-alias:Alias:4", "type:src/types.ts:enum:Kind:5", "type:src/app.ts:interface:Wide:2"} <= set(got)
    assert len(got) == 6 + 4 + 12 + 4
    assert (got["function:src/app.ts:App:run:6"].name, got["file:src/util/index.tsx"].name) == ("App.run", "index.tsx")
    assert got["type:src/types.ts:enum:Kind:5"].metadata["memberCount"] == "2" and got["file:src/app.ts"].metadata["typeCount"] == "1"
    assert got["class:src/app.ts:App:5"].metadata["implementsCount"] == "3"
    with pytest.raises(Exception, match="occurs twice"):
        code_graph.nodes(spark.createDataFrame([FILES[1], FILES[1]], code_graph.FILES)).collect()
    with pytest.raises(Exception, match="path is empty"):
        code_graph.nodes(spark.createDataFrame([parsed("  ")], code_graph.FILES)).collect()


def test_edges(spark):
    df = spark.createDataFrame(FILES, code_graph.FILES)
    assert {tuple(r) for r in code_graph.import_targets(df).collect()} == {("src/app.ts", "src/lib/base.ts"), ("src/app.ts", "src/types.ts"), ("src/app.ts", "src/util/index.tsx")}
    app = "function:src/app.ts:"
    want = {("file:src/app.ts", f"file:src/{x}", "IMPORTS") for x in ("lib/base.ts", "types.ts", "util/index.tsx")}
    want |= {("class:src/app.ts:App:5", f"{app}App:run:6", "HAS_METHOD"), ("class:src/app.ts:App:5", f"{app}App:stop:21", "HAS_METHOD"), ("class:src/lib/base.ts:Base:1", "function:src/lib/base.ts:Base:load:2", "HAS_METHOD")}
    want |= {("class:src/app.ts:App:5", "class:src/lib/base.ts:Base:1", "EXTENDS"), ("class:src/app.ts:Own:40", "class:other/only.ts:Only:1", "EXTENDS"), ("type:src/app.ts:interface:Wide:2", "type:src/types.ts:interface:Shape:1", "EXTENDS")}
    want |= {("class:src/app.ts:App:5", "type:src/types.ts:interface:Shape:1", "IMPLEMENTS"), ("class:src/app.ts:App:5", "type:src/app.ts:interface:Wide:2", "IMPLEMENTS")}
    # The narrowest run around line 11 is the free one; a plain name means imported functions first, else those of the file, else the only one.
    want |= {(f"{app}App:run:6", f"{app}App:stop:21", "CALLS"), (f"{app}global:run:10", f"{app}global:help:60", "CALLS"), (f"{app}App:stop:21", "function:src/lib/base.ts:Base:load:2", "CALLS")}
    want |= {(f"{app}App:run:6", f"function:src/{x}", "CALLS") for x in ("lib/base.ts:global:save:20", "util/index.tsx:global:save:1")}
    want |= {(f"{app}global:help:60", "function:other/only.ts:global:far:2", "CALLS"), (f"{app}global:help:60", "function:src/util/index.tsx:global:twin:3", "CALLS")}
    assert {tuple(r) for r in code_graph.edges(df).collect()} == want
    assert code_graph.edges(df.where("false")).count() == 0
    with pytest.raises(Exception, match="no class Lost in"):
        code_graph.edges(spark.createDataFrame([parsed("x.ts", functions=[function("m", 1, 2, "Lost")])], code_graph.FILES)).collect()


def plain_tree(tree, ignores):
    """The rules one after another, each held against every part of the way."""
    rules = []
    for path, content in sorted(ignores, key=lambda f: (len([p for p in f[0].split("/") if p]), f[0])):
        base = path.rpartition("/")[0]
        for line in re.split(r"\r?\n", content):
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            line = line[1:] if line[:2] in ("\\#", "\\!") else line
            negated, line = line.startswith("!"), line.removeprefix("!").strip().replace("\\", "/")
            pattern = line.strip("/")
            if pattern:
                glob = re.escape(pattern).replace(r"\*\*", "\1").replace(r"\*", "[^/]*").replace(r"\?", "[^/]").replace("\1", ".*")
                rules.append((base, negated, line.endswith("/"), "/" in pattern, re.compile(glob)))
    kept = []
    for path, kind in tree:
        ignored = False
        for base, negated, folders, deep, glob in rules:
            if base and not path.startswith(base + "/"):
                continue
            parts = (path[len(base) + 1 :] if base else path).split("/")
            ways = [("/".join(parts[: i + 1]), parts[i], kind == "tree" or i + 1 < len(parts)) for i in range(len(parts))]
            if any((f or not folders) and glob.fullmatch(w if deep else n) for w, n, f in ways):
                ignored = not negated
        if not ignored:
            kept.append((path, kind))
    ups = {"/".join(p.split("/")[:i]) for p, _ in kept for i in range(1, p.count("/") + 1)}
    return sorted((p, k) for p, k in kept if k != "tree" or p in ups) if rules else sorted(tree)


def test_visible_tree(spark):
    rng = random.Random(3)
    names = ["src", "build", "a.log", "b.py", "deep", "x+y.js", "keep.log", "!odd"]
    blobs = {"/".join(rng.choice(names) for _ in range(rng.randrange(1, 5))) for _ in range(120)}
    trees = {"/".join(b.split("/")[:i]) for b in blobs for i in range(1, b.count("/") + 1)} | {"empty", "build/none"}
    tree = [(b, "blob") for b in sorted(blobs - trees)] + [(t, "tree") for t in sorted(trees)]
    df = spark.createDataFrame(tree, "path string, type string")
    cases = [
        [(".gitignore", "*.log\r\n# all logs\n!keep.log\n  \nbuild/\n/src/deep\n")],
        [(".gitignore", "**/deep/*.py\nx+y.js\n\\!odd\n?.py"), ("src/.gitignore", "build\n!b.py"), ("src/deep/.gitignore", "/src\n*\n!a.log\n")],
        [(".gitignore", "# nothing\n\n/\n")],
        [(".gitignore", "*")],
    ]
    for ignores in cases:
        got = sorted(tuple(r) for r in file_tree.visible_tree(df, spark.createDataFrame(ignores, "path string, content string")).collect())
        assert got == plain_tree(tree, ignores)


def test_scans(spark):
    head = [("r", "a.py", "import os\nclass A:\n  def b(self):\n\n    pass\nfrom x import y\n"), ("r", "b.ts", "import {x} from './x'\nclass C {}\nconst d = require('e')\n"), ("r", "same.go", "package p"), ("r", "note.txt", "class X"), ("r", "gone.py", None), ("q", "b.ts", "")]
    base = [("r", "a.py", "old"), ("r", "same.go", "package p"), ("q", "same.go", "other")]
    schema = "repository string, path string, text string"
    new = file_tree.changed_files(spark.createDataFrame(base, schema), spark.createDataFrame(head, schema))
    got = sorted(tuple(r) for r in file_tree.scanned(new).collect())
    assert got == [("q", "b.ts", "typescript", 0, 0, 0), ("r", "a.py", "python", 5, 2, 2), ("r", "b.ts", "typescript", 3, 2, 2)]
    assert ("r", "typescript", 1, 3, 2, 2) in [tuple(r) for r in file_tree.scan_totals(file_tree.scanned(new)).collect()]


def test_changed_stream(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    row = lambda path, digest, s, ref="main": ("r", ref, path, digest, at(s))
    parts = [[row("a", "1", 0), row("b", "1", 0), row("a", "1", 1), row("a", "2", 2)], [row("a", "2", 3), row("b", "2", 3), row("a", "1", 4), row("a", "1", 0, "dev")]]
    schema = "repository string, ref string, path string, digest string, at timestamp"
    got = replayed(spark, tmp_path, parts, schema, file_tree.changed_stream)
    assert sorted((r.ref, r.path, r.digest) for r in got.collect()) == [("dev", "a", "1"), ("main", "a", "1"), ("main", "a", "1"), ("main", "a", "2"), ("main", "b", "1"), ("main", "b", "2")]


def test_semantic_roles_and_languages(spark):
    from pyspark.sql import functions as F

    from quillmine.operators import graphs, review, source_code

    files = [
        parsed("src/tests/a.test.ts"), parsed("src/adapters/x.ts", imports=["axios"], classes=[("HttpClient", True, [], [], loc(1))]), parsed("src/utils/u.ts", functions=[function(f"f{i}", i, i) for i in range(1, 4)], calls=[("f1", "f2", loc(1))]),
        parsed("src/plain.ts"), parsed("src/domain/entity/e.ts", classes=[("E", False, [], [], loc(1))], functions=[function("m", 2, 3, "E")]),
    ]
    got = {r.file: (r.role, r.confidence) for r in code_graph.semantic_roles(spark.createDataFrame(files, code_graph.FILES)).collect()}
    assert got == {"src/tests/a.test.ts": ("TEST_MODULE", 0.63), "src/adapters/x.ts": ("INFRASTRUCTURE_ADAPTER", 1.0), "src/utils/u.ts": ("UTILITY_MODULE", 0.75), "src/plain.ts": ("UNKNOWN", 0.0), "src/domain/entity/e.ts": ("DOMAIN_MODEL", 0.88)}
    df = spark.createDataFrame([("a/Gemfile", ""), ("b.KT", ""), ("run", "#!/usr/bin/env ruby\nx"), ("odd", "x")], "path string, text string")
    assert [r.l for r in df.select(source_code.detected_language(F.col("path"), F.col("text")).alias("l")).collect()] == ["ruby", "kotlin", "ruby", None]
    with pytest.raises(Exception, match="no known language: odd"):
        df.select(source_code.detected_language(F.col("path"), F.col("text"), strict=True)).collect()
    rows = spark.createDataFrame([("python", 'x = 1 # a\n# b\n"""doc\nmore"""\n'), ("go", "x\n// c\n/* d\ne */ y\n"), (None, "x")], "language string, text string")
    assert [r.n for r in rows.select(source_code.code_lines(F.col("language"), F.col("text")).alias("n")).collect()] == [1, 2, None]
    files = spark.createDataFrame([(i, "x") for i in range(5)], "file int, fingerprint string")
    none = files.select("file").where("false")
    assert review.context_gate(files, none, 2).count() == 3 and review.context_gate(files, files.where("file < 3").select("file"), 2).count() == 2
    node, edge = spark.createDataFrame([(1, "n")], "id int, name string"), spark.createDataFrame([(1, 1)], "source int, target int")
    nodes, edges = graphs.federated_graphs({"a": (node, edge), "b": (node.drop("name"), edge)})
    assert sorted(tuple(r) for r in nodes.collect()) == [("a:1", "a", "1", "n"), ("b:1", "b", "1", None)] and edges.count() == 2
