"""State over keyed events: batch forms as windows, stream forms with state of their own per key.

Stream forms take a streaming frame and give one with an append output; state lives in Spark's state store,
so that a restarted query goes on where its checkpoint ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def paused(events: DataFrame, threshold: int) -> DataFrame:
    """Events (key, id, at, kind, n) with count and paused after each: triggers add n, a resume starts again at 0."""
    order = Window.partitionBy("key").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("run", F.sum((F.col("kind") == "resume").cast("long")).over(order))
    within = Window.partitionBy("key", "run").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    count = F.sum(F.when(F.col("kind") == "trigger", F.col("n")).otherwise(F.lit(0))).over(within)
    return rows.withColumn("count", count.cast("long")).withColumn("paused", F.col("count") >= threshold).drop("run")


def paused_stream(events: DataFrame, threshold: int) -> DataFrame:
    """The same of a stream: (key, id, count, paused), each key's events of a batch in the order of (at, id)."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values(["at", "id"])
        counts = []
        for kind, n in zip(rows["kind"], rows["n"], strict=True):
            count = 0 if kind == "resume" else count + (int(n) if kind == "trigger" else 0)
            counts.append(count)
        state.update((count,))
        yield pd.DataFrame({"key": key[0], "id": rows["id"].to_numpy(), "count": counts, "paused": [c >= threshold for c in counts]})

    return events.groupBy("key").applyInPandasWithState(run, "key long, id long, count long, paused boolean", "count long", "append", GroupStateTimeout.NoTimeout)


def limited_stream(calls: DataFrame, seconds: int, limit: int) -> DataFrame:
    """(key, id, admitted, retry_after) of a stream of calls (key, id, at): a window opens at the first call after the last one ended, and admits so many."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values(["at", "id"])
        out = []
        for at in (rows["at"].astype("int64") if rows["at"].dtype.kind != "M" else rows["at"].astype("datetime64[s]").astype("int64")):
            if start is None or at >= start + seconds:
                start, used = int(at), 0
            used += 1
            out.append((used <= limit, 0 if used <= limit else start + seconds - int(at)))
        state.update((start, used))
        yield pd.DataFrame({"key": key[0], "id": rows["id"].to_numpy(), "admitted": [o[0] for o in out], "retry_after": [o[1] for o in out]})

    return calls.groupBy("key").applyInPandasWithState(run, "key long, id long, admitted boolean, retry_after long", "start long, used long", "append", GroupStateTimeout.NoTimeout)


def throttled_stream(calls: DataFrame, seconds: int, limit: int) -> DataFrame:
    """(key, id, admitted, reason, retry_after) of a stream of calls (key, id, at, blocked).

    As limited_stream(), and besides: a row with blocked, in seconds, is a provider's answer that it had too many
    calls; it is no call itself, and until that time no call of its key is admitted. Rows of a batch are taken in the
    order of (at, id); one that comes a batch late is taken then, in a window that may have moved on.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used, until = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(parts)).sort_values(["at", "id"])
        out = []
        for i, at, blocked in zip(rows["id"], rows["at"].astype("datetime64[s]").astype("int64"), rows["blocked"], strict=True):
            if not pd.isna(blocked):
                until = max(until, int(at) + int(blocked))
                continue
            if start is None or at >= start + seconds:
                start, used = int(at), 0
            if until > at:
                out.append((key[0], i, False, "PROVIDER", until - int(at)))
            elif used < limit:
                used += 1
                out.append((key[0], i, True, None, 0))
            else:
                out.append((key[0], i, False, "QUOTA", max(1, start + seconds - int(at))))
        state.update((start, used, until))
        yield pd.DataFrame(out, columns=["key", "id", "admitted", "reason", "retry_after"])

    return calls.groupBy("key").applyInPandasWithState(run, "key long, id long, admitted boolean, reason string, retry_after long", "start long, used long, until long", "append", GroupStateTimeout.NoTimeout)


def once_stream(messages: DataFrame, id_column: str | list[str], at: str, keep: str | None = None) -> DataFrame:
    """Messages of a stream whose id (one column or several) didn't come before: ever, or within the time keep that ids are kept.

    Without keep the answer is exact and the state holds every id there was.
    """
    ids = [id_column] if isinstance(id_column, str) else id_column
    return messages.dropDuplicates(ids) if keep is None else messages.withWatermark(at, keep).dropDuplicatesWithinWatermark(ids)


def dead_letters(events: DataFrame, attempts: int) -> DataFrame:
    """Of events (id, failed, attempts, job) the failed ones that were tried so often; those without a job are ignored."""
    return events.where(F.col("failed") & (F.col("attempts") >= attempts) & F.col("job").isNotNull())
