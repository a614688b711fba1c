"""Cases of boundaries and stores that the tables don't show."""

import pytest
from pyspark.sql import functions as F

from quillmine.operators import boundaries
from quillmine.sources import stores


def test_ambiguous_module(spark):
    imports = spark.createDataFrame([("a/b/x", "c/y")], "source string, target string")
    with pytest.raises(Exception, match="more than one module"):
        boundaries.module_violations(imports, {"m": ["a/**"], "n": ["a/b/**"]}).collect()


def test_metadata_filter_errors_and_nulls(spark):
    rows = spark.createDataFrame([(1, ("x", None)), (2, ("y", 3)), (3, None)], "id int, m struct<a: string, b: int>")
    pick = lambda f: [r.id for r in rows.where(boundaries.metadata_filter(f)).orderBy("id").collect()]
    assert pick({"m": {"a": "x", "b": None}}) == [1]
    assert pick({"m": {"a": ["x", "y"]}, "id": [2, 3]}) == [2]
    assert pick({}) == [1, 2, 3]
    for bad in ({"id": []}, {" ": 1}, {"id": [1, "a"]}, {"id": [float("inf")]}, {"id": object()}):
        with pytest.raises(ValueError):
            boundaries.metadata_filter(bad)


def test_hash_of_surrogates_and_empty(spark):
    def want(text):
        h = 2166136261
        units = text.encode("utf-16-le")
        for i in range(0, len(units), 2):
            h = (h ^ int.from_bytes(units[i : i + 2], "little")) * 16777619 % 2**32
        return h

    texts = ["", "a", "naïve:1", "x😀y", "a:1:{}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", boundaries.seeded_bucket(F.col("t")).alias("h"))
    assert {r.t: r.h for r in df.collect()} == {t: want(t) for t in texts}


def test_filter_chain_budget(spark):
    rows = spark.createDataFrame([(i,) for i in range(8)], "k int")
    got = boundaries.filter_chain(rows, [("odd", F.col("k") % 2 == 1), ("low", F.col("k") > 2)], "k", 3)
    assert {r.k: r.discarded_by for r in got.collect()} == {0: "odd", 2: "odd", 4: "odd", 6: None, 1: None, 3: None, 5: None, 7: None}
    assert [r.k for r in got.where("discarded_by is null").orderBy("place").collect()] == [3, 5, 7, 6, 1]


def test_source_files_and_scopes(spark, tmp_path):
    for name in ("src/a.py", "src/deep/b.ts", "node_modules/c.py", "d.md"):
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text(name)
    got = stores.source_files(spark, str(tmp_path / "r"), ["py", "ts"], ["node_modules"])
    assert sorted((r.path, r.extension, r.text) for r in got.collect()) == [("src/a.py", "py", "src/a.py"), ("src/deep/b.ts", "ts", "src/deep/b.ts")]
    store = str(tmp_path / "s")
    graph = lambda *rows: spark.createDataFrame(rows, "node string, scope string")
    stores.save_scopes(graph(("x", "one"), ("y", "two")), store)
    stores.save_scopes(graph(("z", "one")), store)
    assert [r.node for r in stores.load_scope(spark, store, "one").collect()] == ["z"]
    assert [r.node for r in stores.load_scope(spark, store, "two").collect()] == ["y"]


def test_commit_predicates(spark):
    rows = spark.createDataFrame([(1, "a", "2024-01-01", ["x"]), (2, "b", "2024-01-02", ["x", "y"]), (3, "a", "2024-01-03", ["y"])], "id int, author string, at string, paths array<string>").withColumn("at", F.to_timestamp("at"))
    ids = lambda **k: [r.id for r in stores.commits(rows, **k).collect()]
    assert ids(author="a") == [1, 3] and ids(path="y", most=1) == [3] and ids(since="2024-01-02", until="2024-01-02") == [2]


def test_sources_by_language(spark, tmp_path):
    for name, text in (("src/b.py", "x"), ("src/Rakefile", "y"), ("a.ts", "z"), ("run", "#!/usr/bin/env node\n"), ("note.txt", "n"), ("node_modules/c.py", "c")):
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_text(text)
    root = str(tmp_path / "r")
    assert [(r.path, r.language) for r in stores.sources_of(spark, root, None, ["node_modules"]).collect()] == [("a.ts", "typescript"), ("run", "javascript"), ("src/Rakefile", "ruby"), ("src/b.py", "python")]
    assert [r.path for r in stores.sources_of(spark, root, ["python"], []).collect()] == ["node_modules/c.py", "src/b.py"]
    with pytest.raises(ValueError, match="no such language: cobol"):
        stores.sources_of(spark, root, ["cobol"], [])


def test_shared_state_of_ordered_parts(spark, tmp_path):
    """what an order's lines name is imported, under whole keys; symbols that two customers order are found."""
    from quillmine.plans import registry

    lines = [(1, 70_001, 3, "A"), (2, 70_001, 3, "N"), (2, 70_002, 3, "R"), (97, 5, 4, "A"), (3, 5, 4, "A"), (3, 6, 4, "N")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 10), (2, 11), (3, 12), (97, 13)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1,), (2,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = registry.queries()["a27_shared_state"](spark, str(tmp_path)).collect()
    assert sorted((r.file, r.symbol, r.consumers, r.mutators, r.severity) for r in got) == [(3, "s70001", 2, "setAll", "MEDIUM"), (4, "s5", 2, "setAll", "MEDIUM")]
