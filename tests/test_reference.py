"""Every registered query with SQL agrees with DuckDB; golden values of the survey hold."""

import os

import duckdb
import pytest

from quillmine.operators import history
from quillmine.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_agrees_with_sql(spark, name):
    df = registry.queries()[name](spark, SF)
    db = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            db.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    found = db.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in order]) for r in df.collect()) == want


def test_temporal_coupling_golden(spark):
    rows = [(n, f, 0) for n, files in enumerate(["abc", "ab", "ad", "z"]) for f in files]
    got = {(r["left"], r["right"]): (r["shared"], r["strength"]) for r in history.temporal_coupling(spark.createDataFrame(rows, "commit int, file string, at int")).collect()}
    assert got[("a", "b")] == (2, 0.6667)
    assert got[("b", "c")] == (1, 0.5)
    assert got[("a", "d")] == (1, 0.3333)
