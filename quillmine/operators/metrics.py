"""File metrics, issues and feedback."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmine.functions.scalars import cosine, rounded


def correlate(files: DataFrame, quantile: float = 0.75) -> DataFrame:
    """Pearson r of complexity and churn, the thresholds of both, and how many files pass both."""
    facts = files.agg(F.corr("complexity", "churn").alias("r"), F.percentile("complexity", quantile).alias("c"), F.percentile("churn", quantile).alias("h"), F.count("*").alias("files"))
    # One row of facts.
    hot = files.crossJoin(F.broadcast(facts)).agg(F.sum(((F.col("complexity") >= F.col("c")) & (F.col("churn") >= F.col("h"))).cast("long")).alias("hotspots"))
    size = F.abs(F.col("r"))
    strength = F.when(size >= 0.7, "STRONG").when(size >= 0.4, "MODERATE").when(size >= 0.2, "WEAK").otherwise("NONE")
    return facts.crossJoin(hot).select("files", rounded(F.col("r")).alias("correlation"), rounded(F.col("c")).alias("complexity_threshold"), rounded(F.col("h")).alias("churn_threshold"), "hotspots", strength.alias("strength"))


def drift(imports: DataFrame) -> DataFrame:
    """Violations per import, by module."""
    return imports.groupBy("module").agg(F.count("*").alias("imports"), F.sum("violation").alias("violations"), rounded(F.sum("violation") / F.count("*"), 6).alias("score"))


def issue_summary(issues: DataFrame, severities: list[str]) -> DataFrame:
    """Issues per source, pivoted by severity."""
    return issues.groupBy("source").agg(F.count("*").alias("total"), *[F.sum((F.col("severity") == s).cast("long")).alias(f"s_{s[0]}") for s in severities], F.countDistinct("file").alias("files"))


def decayed_rates(feedback: DataFrame, half_life_hours: float = 168.0) -> DataFrame:
    """Positive rate per rule, a row's weight halving with its age; later rows than as_of weigh 1."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.col("as_of").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 3.6e9)
    weighed = feedback.withColumn("w", F.pow(F.lit(0.5), age / half_life_hours))
    return weighed.groupBy("rule").agg(F.count("*").alias("n"), rounded(F.sum("w"), 3).alias("weight"), rounded(F.sum(F.col("w") * F.col("positive")) / F.sum("w"), 6).alias("rate"))


def full_diff(before: DataFrame, after: DataFrame, key: str, metric: str) -> DataFrame:
    """Added, removed and changed keys between two snapshots."""
    both = before.select(key, F.col(metric).alias("before")).join(after.select(key, F.col(metric).alias("after")), key, "full_outer")
    state = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed").otherwise("same")
    return both.select(key, "before", "after", state.alias("state"), (F.col("after") - F.col("before")).alias("delta")).where("state <> 'same'")


def keep_first_of(rows: DataFrame, by: str, rank: str, tie: str) -> DataFrame:
    """Of rows alike in `by` the one of the highest rank, the first on a tie; kept or discarded."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(rank), tie))
    return rows.withColumn("kept", n == 1)


def top_per(rows: DataFrame, by: str, order: list, n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def nearest(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k most similar vectors (id, v) to one query vector (q): a top-k report."""
    q = query.limit(1)
    scored = vectors.crossJoin(F.broadcast(q)).select("id", rounded(cosine(F.col("v"), F.col("q")), 6).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "id").limit(k)


#: Vectors of a block, so that a task holds two blocks and their products.
BLOCK = 1024


def _blocks(vectors: DataFrame) -> DataFrame:
    """(ids, m): blocks of vectors (id, v) of equal length, scaled to length 1, as bytes; null and zero vectors are left out."""

    def run(batches):
        for batch in batches:
            ids, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(ids), BLOCK):
                full = [(i, x) for i, x in zip(ids[a : a + BLOCK], v[a : a + BLOCK], strict=True) if x and None not in x and any(x)]
                if full:
                    m = np.array([x for _, x in full])
                    m /= np.sqrt((m * m).sum(1))[:, None]
                    yield pa.RecordBatch.from_arrays([pa.array([np.array([i for i, _ in full], np.int64).tobytes()]), pa.array([m.tobytes()])], names=["ids", "m"])

    return vectors.select(F.col("id").cast("long"), "v").mapInArrow(run, "ids binary, m binary")


def nearest_each(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, id, similarity): the k most similar vectors (id, v) of each query (id, v), by matrix products of blocks.

    Every block of queries meets every block of vectors; a pair of blocks sends on k rows a query, and these
    are cut to k again per query.
    """

    def run(batches):
        for batch in batches:
            for q_ids, q, ids, m in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                q_ids, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                product = np.frombuffer(q).reshape(len(q_ids), -1) @ np.frombuffer(m).reshape(len(ids), -1).T
                near = np.floor(product * 1e5 + 0.5) / 1e5
                best = np.stack([np.lexsort((ids, -row))[:k] for row in near])
                rows = np.repeat(np.arange(len(q_ids)), best.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[rows]), pa.array(ids[best.ravel()]), pa.array(near[rows, best.ravel()])], names=["query_id", "id", "similarity"])

    pairs = _blocks(queries).toDF("q_ids", "q").crossJoin(_blocks(vectors))
    found = pairs.mapInArrow(run, "query_id long, id long, similarity double")
    return top_per(found, "query_id", [F.desc("similarity"), "id"], k).drop("rank")
