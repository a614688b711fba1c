"""Stores of files, commits, snapshots, vectors and queued jobs, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def source_files(spark: SparkSession, root: str, extensions: list[str], skipped: list[str]) -> DataFrame:
    """Files below root (path from root, extension, text) of these extensions, none in a skipped folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_extract("path", "^(?:[a-z0-9]+:/*)?(.*)$", 1)
    path = F.substr(base, F.lit(len(root.strip("/")) + 2)).alias("path")
    rows = found.select(path, "content").withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    return rows.where(F.col("extension").isin(extensions) & ~F.arrays_overlap(F.split("path", "/"), F.lit(skipped))).select("path", "extension", F.decode("content", "UTF-8").alias("text"))


def ref_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed files (path, digest) of two refs: added, removed or modified; equal ones don't appear."""
    b, a = before.select("path", F.col("digest").alias("b")), after.select("path", F.col("digest").alias("a"))
    status = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return b.join(a, "path", "full").select("path", status.alias("status")).where("status is not null")


def commits(history: DataFrame, author: str | None = None, since: str | None = None, until: str | None = None, path: str | None = None, most: int | None = None) -> DataFrame:
    """Commits (id, author, at, paths) that the given predicates keep, the newest so many if most is given."""
    at = F.col("at")
    tests: list[tuple[object, Column]] = [(author, F.col("author") == author), (since, at >= F.lit(since).cast("timestamp")), (until, at <= F.lit(until).cast("timestamp")), (path, F.array_contains("paths", path or ""))]
    for given, test in tests:
        history = history.where(test) if given is not None else history
    return history.orderBy(F.desc("at"), "id").limit(most) if most is not None else history


def blame(ranges: DataFrame, paths: DataFrame) -> DataFrame:
    """Single lines (path, line, author) of the ranges (path, first, last, author) of the paths asked for."""
    return ranges.join(paths.select("path").distinct(), "path", "left_semi").where("first <= last").select("path", F.explode(F.sequence("first", "last")).alias("line"), "author")


def upserted(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The stored rows with those given put in by key; of given rows with one key (version) the newest counts."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("version")))
    new = rows.withColumn("nth", newest).where("nth = 1").drop("nth", "version")
    return stored.join(new, key, "left_anti").unionByName(new)


def deleted(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return stored.join(ids.select(key), key, "left_anti")


def save_scopes(graph: DataFrame, path: str, scope: str = "scope") -> None:
    """Replaces the scopes that occur in graph and leaves the others of the store alone."""
    graph.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(scope).parquet(path)


def load_scope(spark: SparkSession, path: str, value: str, scope: str = "scope") -> DataFrame:
    return spark.read.parquet(path).where(F.col(scope) == value)


def dequeued(waiting: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n waiting jobs (job, priority: the least first, null last, at), and the queue without them."""
    taken = waiting.orderBy(F.asc_nulls_last("priority"), "at", "job").limit(n)
    return taken, waiting.join(taken.select("job"), "job", "left_anti")


def sources_of(spark: SparkSession, root: str, languages: list[str] | None, skipped: list[str]) -> DataFrame:
    """(path, language, text) of the files below root whose language is known, and among languages if these are given, in the order of path; none in a skipped folder."""
    from quillmine.operators.source_code import NAMES, EXTENSIONS, detected_language

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_extract("path", "^(?:[a-z0-9]+:/*)?(.*)$", 1)
    rows = found.select(F.substr(base, F.lit(len(root.strip("/")) + 2)).alias("path"), F.decode("content", "UTF-8").alias("text"))
    rows = rows.where(~F.arrays_overlap(F.split("path", "/"), F.lit(skipped)) if skipped else F.lit(True))
    unknown = set(languages or ()) - {*NAMES.values(), *EXTENSIONS.values()}
    if unknown:
        raise ValueError(f"no such language: {', '.join(sorted(unknown))}")
    rows = rows.withColumn("language", detected_language(F.col("path"), F.col("text"))).where("language is not null")
    rows = rows if languages is None else rows.where(F.col("language").isin(languages))
    return rows.select("path", "language", "text").orderBy("path")


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, line): a graph as JSON lines, nodes (id, label, other columns) before edges (source, target, type) when sorted; null values are left out."""
    rest = [c for c in nodes.columns if c not in ("id", "label")]
    node = F.to_json(F.struct(F.col("id"), F.coalesce("label", "id").alias("label"), *rest))
    edge = F.to_json(F.struct(F.concat_ws("|", "source", "type", "target").alias("id"), "source", "target", "type"))
    return nodes.select(F.lit(0).alias("kind"), node.alias("line")).unionByName(edges.distinct().select(F.lit(1).alias("kind"), edge.alias("line")))
