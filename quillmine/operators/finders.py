"""Finders: rows by equality, membership, range and text, ordered and paged; usage by chosen keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find(rows: DataFrame, equal: dict | None = None, among: dict[str, Sequence] | None = None, between: dict[str, tuple] | None = None, text: str | None = None, within: Sequence[str] = (), order: Sequence[Column | str] = (), offset: int = 0, limit: int | None = None) -> DataFrame:
    """The rows that all given criteria keep.

    equal: column -> value, None meaning null; among: column -> values; between: column -> (low, high), both included and
    either None for open; text occurs in any case in one of the columns within (blank text keeps all). offset and limit
    page the rows in order, which then must be given. A criterion that is None, as a whole or in its value's place in
    among or between, isn't held.
    """
    if (offset or limit is not None) and not order:
        raise ValueError("a page needs an order")
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("offset and limit must not be negative")
    for name, value in (equal or {}).items():
        rows = rows.where(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    for name, values in (among or {}).items():
        if values is not None:
            rows = rows.where(F.col(name).isin(list(values)))
    for name, (low, high) in (between or {}).items():
        rows = rows if low is None else rows.where(F.col(name) >= F.lit(low).cast(dict(rows.dtypes)[name]))
        rows = rows if high is None else rows.where(F.col(name) <= F.lit(high).cast(dict(rows.dtypes)[name]))
    if text and text.strip():
        needle = F.lit(text.strip().lower())
        rows = rows.where(reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), needle) for c in within], F.lit(False)))
    rows = rows.orderBy(*order) if order else rows
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def library_rules(rules: DataFrame, language: str | None = None, category: str | None = None, scope: str | None = None, severity: str | None = None) -> DataFrame:
    """Global rules (is_global, language, categories, scope, severity, ...) that match all given criteria; a category is one of a rule's, in any case."""
    equal = {k: v for k, v in (("language", language), ("scope", scope), ("severity", severity)) if v is not None}
    rows = find(rules.where("is_global"), equal)
    return rows if category is None else rows.where(F.exists("categories", lambda c: F.lower(c) == category.strip().lower()))


def graph_nodes(nodes: DataFrame, repository: str | None = None, branch: str | None = None, types: Sequence[str] | None = None, path: str | None = None) -> DataFrame:
    """Nodes (id, repository, branch, type, file_path) by any of these, in the order of id."""
    equal = {k: v for k, v in (("repository", repository), ("branch", branch), ("file_path", path)) if v is not None}
    return find(nodes, equal, {"type": types} if types is not None else None, order=["id"])


def graph_edges(edges: DataFrame, nodes: DataFrame, types: Sequence[str] | None = None, source: str | None = None, target: str | None = None, path: str | None = None) -> DataFrame:
    """Edges (source, target, type) by type and ends; path is that of the file of either end, looked up among nodes (id, file_path)."""
    equal = {k: v for k, v in (("source", source), ("target", target)) if v is not None}
    rows = find(edges, equal, {"type": types} if types is not None else None)
    if path is not None:
        there = nodes.where(F.col("file_path") == path).select("id").distinct()
        ends = [rows.join(there.withColumnRenamed("id", end), end, "left_semi") for end in ("source", "target")]
        rows = ends[0].unionByName(ends[1])
    return rows.distinct().orderBy("source", "type", "target")


def touching(imports: DataFrame, paths: DataFrame | None) -> DataFrame:
    """Imports (source, target, ...) with an end among paths (path); all of them if none are given."""
    if paths is None:
        return imports
    p = paths.select("path").distinct()
    of_source = imports.join(p.withColumnRenamed("path", "source"), "source", "left_semi")
    rest = imports.join(p.withColumnRenamed("path", "source"), "source", "left_anti")
    return of_source.unionByName(rest.join(p.withColumnRenamed("path", "target"), "target", "left_semi").select(imports.columns))


def usage_by(usage: DataFrame, keys: Sequence[str], measures: Sequence[str], at: str, since: str | None = None, until: str | None = None, by: str | None = None) -> DataFrame:
    """Rows and sums of measures for each value of keys, of the usage from since to until; the largest sum of by first, then by keys."""
    rows = find(usage, between={at: (since, until)}).groupBy(*keys).agg(F.count("*").alias("records"), *[F.sum(m).alias(m) for m in measures])
    return rows.orderBy(F.desc(by), *keys) if by else rows


def feedback_by_rule(feedback: DataFrame, kinds: Sequence[str], severities: Sequence[str] | None = None, teams: Sequence | None = None) -> DataFrame:
    """(rule, total, one count for each kind) of feedback (rule, kind, severity, team) of these severities and teams; rows without a rule don't count."""
    among = {k: v for k, v in (("severity", severities), ("team", teams)) if v is not None}
    rows = find(feedback.where(F.trim(F.col("rule").cast("string")) != ""), among=among)
    return rows.groupBy("rule").agg(F.count("*").alias("total"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def ownership_summary(shares: DataFrame, primary: float = 0.5, secondary: float = 0.2) -> DataFrame:
    """One row on shares (file, contributor, lines, share): files, contributors, lines, how many shares are primary or secondary, and the mean number and greatest share of a file's owners."""
    per = shares.groupBy("file").agg(F.count("*").alias("owners"), F.max("share").alias("top"), F.sum("lines").alias("lines"), F.count_if(F.col("share") >= primary).alias("p"), F.count_if((F.col("share") < primary) & (F.col("share") >= secondary)).alias("s"))
    mean = lambda c: F.floor(F.coalesce(F.avg(c), F.lit(0.0)) * 1e6 + 0.5) / 1e6
    one = per.agg(F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0.0)).alias("lines"), F.coalesce(F.sum("p"), F.lit(0)).alias("primary_owners"), F.coalesce(F.sum("s"), F.lit(0)).alias("secondary_owners"), mean("owners").alias("mean_owners"), mean("top").alias("mean_top_share"))
    return one.crossJoin(shares.agg(F.countDistinct("contributor").alias("contributors")))


def scan_summary(scans: DataFrame) -> DataFrame:
    """(repository, scans, files, nodes, edges, mean_duration, latest) of scans (id, repository, files, nodes, edges, duration, completed_at); of equal times the first id is the latest."""
    first = F.min(F.struct((-F.unix_micros(F.col("completed_at").cast("timestamp"))).alias("t"), "id"))
    return scans.groupBy("repository").agg(F.count("*").alias("scans"), *[F.sum(c).alias(c) for c in ("files", "nodes", "edges")], (F.floor(F.avg("duration") * 1e6 + 0.5) / 1e6).alias("mean_duration"), first.alias("f")).select("repository", "scans", "files", "nodes", "edges", "mean_duration", F.col("f.id").alias("latest"))


def merged_heatmap(entries: DataFrame) -> DataFrame:
    """(path, total, severities, categories) of heatmaps (path, total, severities, categories: maps of counts), added up; missing or negative counts are 0."""
    sound = lambda c: F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    total = entries.groupBy("path").agg(F.sum(sound(F.col("total"))).alias("total"))
    for name in ("severities", "categories"):
        each = entries.select("path", F.explode(name).alias("k", "v")).groupBy("path", "k").agg(F.sum(sound(F.col("v"))).alias("v"))
        # Levels and categories of one path are few.
        maps = each.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(name))
        total = total.join(maps, "path", "left").withColumn(name, F.coalesce(name, F.create_map().cast("map<string, double>")))
    return total


def issues_in_scope(issues: DataFrame, scope: DataFrame | None, levels: Sequence[str], most: int = 200) -> DataFrame:
    """The first issues (id, source, severity, path, kind): of paths in scope (path; all if none is given), each id once as it first came (ordinal), by severity, path, source, kind and id."""
    rows = issues if scope is None else issues.join(scope.select("path").distinct(), "path", "left_semi")
    columns = ["source", "severity", "path", "kind"]
    first = rows.groupBy("id").agg(F.min_by(F.struct(*columns), "ordinal").alias("f")).select("id", "f.*")
    rank = F.lit(len(levels))
    for i, level in reversed(list(enumerate(levels))):
        rank = F.when(F.col("severity") == level, i).otherwise(rank)
    return first.withColumn("rank", rank).orderBy("rank", "path", "source", "kind", "id").limit(most)
