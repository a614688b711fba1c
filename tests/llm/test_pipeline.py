"""The pipeline on small tables with nulls, copies and clashing column names; SQL of the operators that have it."""

import os

import duckdb
import pytest

import corpus_pipeline
from quillmine.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    db = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            db.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    found = db.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    want = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect()) == want


def test_pipeline(spark, tmp_path):
    text = "one two three four five six seven eight nine ten mail a@b.example.com now"
    rows = [(i, f"{text} {i % 4} {'x y z ' * i}", None, f"s{i % 3}", None, i, "f") for i in range(24)]
    rows += [(100, rows[3][1], "en", "s0", 1, 1, "f"), (101, None, None, None, None, None, None), (None, None, None, None, None, None, None), (102, "", "en", "s1", 0, 0, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, fp string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (2, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(r.doc_id != 100 for r in got)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
