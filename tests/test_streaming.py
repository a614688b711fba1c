"""Streams replayed from files agree with the batch forms."""

import datetime as dt

from quillmine.streaming import state


def replayed(spark, tmp_path, parts, schema, build):
    """Rows that a stream gives when the parts arrive one after another, the query restarting from its checkpoint in between."""
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(schema).parquet(source))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(out)


def test_paused(spark, tmp_path):
    rows = [(k, 100 * k + i, dt.datetime(2024, 1, 1, 0, i), kind, n) for k in (1, 2) for i, (kind, n) in enumerate([("trigger", 2), ("other", 9), ("trigger", 3), ("resume", 7), ("trigger", 4), ("trigger", 1)])]
    schema = "key long, id long, at timestamp, kind string, n long"
    want = {r.id: (r["count"], r.paused) for r in state.paused(spark.createDataFrame(rows, schema), 5).collect()}
    parts = [[r for r in rows if r[1] % 100 < 3], [r for r in rows if r[1] % 100 >= 3]]
    got = {r.id: (r["count"], r.paused) for r in replayed(spark, tmp_path, parts, schema, lambda s: state.paused_stream(s, 5)).collect()}
    assert got == want and want[102] == (5, True) and want[103] == (0, False) and want[105] == (5, True)


def test_limited(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, i, at(s)) for i, s in enumerate((10, 20, 30, 109, 110, 111))]
    got = replayed(spark, tmp_path, [rows[:2], rows[2:]], "key long, id long, at timestamp", lambda s: state.limited_stream(s, 100, 2)).orderBy("id").collect()
    assert [(r.admitted, r.retry_after) for r in got] == [(True, 0), (True, 0), (False, 80), (False, 1), (True, 0), (True, 0)]


def test_once(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    parts = [[("a", at(0)), ("b", at(1)), ("a", at(2))], [("b", at(3)), ("c", at(4))]]
    got = replayed(spark, tmp_path, parts, "id string, at timestamp", lambda s: state.once_stream(s, "id", "at", "1 hour"))
    assert sorted(r.id for r in got.collect()) == ["a", "b", "c"]


def test_once_for_ever(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d)
    parts = [[("c", "a", at(1)), ("c", "b", at(1)), ("d", "a", at(1))], [("c", "z", at(28))], [("c", "a", at(29)), ("e", "a", at(29))]]
    got = replayed(spark, tmp_path, parts, "consumer string, id string, at timestamp", lambda s: state.once_stream(s, ["consumer", "id"], "at"))
    assert sorted((r.consumer, r.id) for r in got.collect()) == [("c", "a"), ("c", "b"), ("c", "z"), ("d", "a"), ("e", "a")]


def test_throttled(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, i, at(s), b) for i, (s, b) in enumerate([(0, None), (1, None), (2, None), (3, 50), (10, None), (53, None), (101, None), (102, 0), (103, None)])]
    got = replayed(spark, tmp_path, [rows[:5], rows[5:]], "key long, id long, at timestamp, blocked int", lambda s: state.throttled_stream(s, 100, 2)).orderBy("id").collect()
    assert [(r.id, r.admitted, r.reason, r.retry_after) for r in got] == [(0, True, None, 0), (1, True, None, 0), (2, False, "QUOTA", 98), (4, False, "PROVIDER", 43), (5, False, "QUOTA", 47), (6, True, None, 0), (8, True, None, 0)]
