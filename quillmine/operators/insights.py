"""History, metrics, reviews and graphs as whole results: figures per file, rolling means, ranked and discarded rows, trees, diffs."""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.functions.scalars import district, rounded
from quillmine.operators.graphs import degrees
from quillmine.operators.history import temporal_coupling

# Weights of severities and of categories.
SEVERITIES = {"INFO": 0, "LOW": 10, "MEDIUM": 20, "HIGH": 30, "CRITICAL": 50}
CATEGORIES = {
    "security": 20, "breaking-change": 18, "bug": 15, "architecture": 12, "performance": 10, "testing": 10, "maintainability": 8, "complexity": 8, "accessibility": 8, "best-practice": 5, "consistency": 5, "style": 3, "documentation": 2,
    "style-conventions": 3, "duplication-complexity": 8, "readability-refactor": 5, "error-handling": 12, "observability-logging": 3, "ui-robustness": 8, "api-conventions": 5, "module-architecture": 12, "security-hardening": 20,
    "performance-efficiency": 10, "dependency-supply-chain": 8, "secrets-credentials": 20, "config-environment": 3, "ci-cd-build-hygiene": 3, "container-docker-hygiene": 3, "infra-as-code": 3, "monorepo-hygiene": 5, "pr-hygiene": 5,
    "testing-quality": 10, "migrations-backward-compat": 10, "docs-adrs": 2, "repo-context-files": 2, "external-context-mcps": 2, "privacy-pii": 18, "accessibility-a11y": 8, "internationalization-i18n": 5, "database-query-performance": 10,
    "resilience-retries-idempotency": 12, "concurrency-safety": 12, "caching-strategy": 8, "api-contracts-versioning": 10, "compliance-gdpr": 15, "compliance-soc2-essentials": 15, "compliance-pci-dss": 18, "compliance-hipaa": 18,
    "web-static-assets": 2, "docstring": 2,
}


def severity_weight(c: Column) -> Column:
    """The weight of a severity in any case; unknown ones count as INFO."""
    known = F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.upper(F.trim(c))), F.lit(0))


def category_weight(c: Column) -> Column:
    """The weight of a category, however its words are joined; 0 for an unknown one."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9_]", "_"), "_+", "_")
    known = F.create_map(*[F.lit(x) for k, w in CATEGORIES.items() for x in (k.replace("-", "_"), w)])
    return F.coalesce(F.try_element_at(known, key), F.lit(0))


def coupling_of(changes: DataFrame, paths: DataFrame) -> DataFrame:
    """temporal_coupling() of the pairs with one of the files (file) at least; commits without any of them are left out of the pairs, not of the files' counts."""
    pairs = temporal_coupling(changes)
    asked = paths.select("file").distinct()
    one = pairs.join(asked.toDF("left"), "left", "left_semi")
    other = pairs.join(asked.toDF("left"), "left", "left_anti").join(asked.toDF("right"), "right", "left_semi")
    return one.unionByName(other)


def rolling_trends(points: DataFrame, windows: tuple[int, ...] = (3, 5, 8), accelerate: float = 0.15, decelerate: float = -0.15) -> DataFrame:
    """Per file of points (file, at, value): its samples, the latest value, means over the last rows for every window, and how the shortest compares with the longest.

    rolling lists (window, samples, average). Points of one time are taken in the order of value.
    """
    sizes = sorted(set(windows))
    n = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("at"), F.desc("value")))
    rows = points.withColumn("n", n)
    parts = [F.struct(F.lit(w).alias("window"), F.count_if(F.col("n") <= w).alias("samples"), rounded(F.avg(F.when(F.col("n") <= w, F.col("value"))), 6).alias("average")) for w in sizes]
    per = rows.groupBy("file").agg(F.count("*").alias("samples"), F.max(F.when(F.col("n") == 1, F.col("value"))).alias("latest"), F.array(*parts).alias("rolling"))
    per = per.withColumn("s", F.col("rolling")[0]["average"]).withColumn("l", F.col("rolling")[len(sizes) - 1]["average"]).withColumn("delta", rounded(F.col("s") - F.col("l"), 6))
    ratio = F.col("delta") / F.when(F.col("l") == 0, 1.0).otherwise(F.abs("l"))
    way = F.when(F.col("ratio") >= accelerate, "ACCELERATING").when(F.col("ratio") <= decelerate, "DECELERATING").otherwise("STABLE")
    per = per.withColumn("ratio", rounded(ratio, 6))
    return per.select("file", "samples", "latest", F.col("s").alias("short_mean"), F.col("l").alias("long_mean"), "delta", "ratio", way.alias("direction"), "rolling")


def correlated_points(files: DataFrame, quantile: float = 0.75) -> DataFrame:
    """files (file, complexity, churn) with both scaled to 0..1 (0 if all are equal), whether each is high, and whether both are.

    The thresholds are interpolated percentiles. They and the bounds are one row, which goes to every task.
    """
    facts = files.agg(*[f("complexity").alias(f"c_{n}") for n, f in (("low", F.min), ("high", F.max))], *[f("churn").alias(f"h_{n}") for n, f in (("low", F.min), ("high", F.max))], F.percentile("complexity", quantile).alias("c_at"), F.percentile("churn", quantile).alias("h_at"))
    rows = files.crossJoin(F.broadcast(facts))
    scaled = lambda c, k: rounded(F.when(F.col(f"{k}_high") > F.col(f"{k}_low"), (F.col(c) - F.col(f"{k}_low")) / (F.col(f"{k}_high") - F.col(f"{k}_low"))).otherwise(0.0), 6)
    rows = rows.withColumn("high_complexity", F.col("complexity") >= F.col("c_at")).withColumn("high_churn", F.col("churn") >= F.col("h_at"))
    return rows.select("file", "complexity", "churn", scaled("complexity", "c").alias("scaled_complexity"), scaled("churn", "h").alias("scaled_churn"), "high_complexity", "high_churn", (F.col("high_complexity") & F.col("high_churn")).alias("hotspot"))


def contributor_files(changes: DataFrame) -> DataFrame:
    """Per contributor and file of changes (commit, file, contributor, added, deleted, at): commits, lines and when it was last changed."""
    more = [rounded(F.sum(c), 6).alias(c) for c in ("added", "deleted")]
    per = changes.groupBy("contributor", "file").agg(F.countDistinct("commit").alias("commits"), *more, F.max("at").alias("last_at"))
    return per.withColumn("changes", rounded(F.col("added") + F.col("deleted"), 6))


def ranked_contributors(changes: DataFrame, most: int) -> DataFrame:
    """The first contributors by commits, then changed lines (both falling), then name: a top-k report."""
    per = changes.groupBy("contributor").agg(F.countDistinct("commit").alias("commits"), rounded(F.sum("added") + F.sum("deleted"), 6).alias("changes"))
    return per.orderBy(F.desc("commits"), F.desc("changes"), "contributor").limit(most)


def prioritized(suggestions: DataFrame, limit: int) -> DataFrame:
    """suggestions (ordinal, category, severity, ...) with score, place and, beyond the limit, the reason why they are discarded.

    Scores are sums of two weights, of which there are few; so places are counted per score and numbered within
    one, and no task ranks all rows.
    """
    rows = suggestions.withColumn("score", category_weight(F.col("category")) + severity_weight(F.col("severity")))
    sizes = rows.groupBy("score").agg(F.count("*").alias("n_"))
    before = sizes.select("score", (F.sum("n_").over(Window.orderBy(F.desc("score"))) - F.col("n_")).alias("before_"))
    nth = F.row_number().over(Window.partitionBy("score").orderBy("ordinal"))
    rows = rows.withColumn("nth_", nth).join(F.broadcast(before), "score").withColumn("place", F.col("before_") + F.col("nth_"))
    return rows.drop("nth_", "before_").withColumn("discarded", F.when(F.col("place") > limit, "low_priority"))


def severity_gate(suggestions: DataFrame, least: str, caps: dict[str, int]) -> DataFrame:
    """suggestions (ordinal, severity, ...) with discarded: the reason for those below a severity, or beyond its cap in the order of ordinal."""
    level = F.when(F.upper(F.trim("severity")).isin(*SEVERITIES), F.upper(F.trim("severity"))).otherwise("INFO")
    rows = suggestions.withColumn("level_", level)
    low = severity_weight(F.col("level_")) < SEVERITIES[least.strip().upper()]
    out = rows.where(low).withColumn("discarded", F.lit("below_threshold"))
    rest = rows.where(~low)
    # The last ordinal within its cap, one row per severity; each task passes on no more than cap rows.
    lasts = []
    for name, cap in caps.items():
        if cap > 0:
            first = rest.where(F.col("level_") == name).select("ordinal").orderBy("ordinal").limit(cap)
            lasts.append(first.agg(F.max("ordinal").alias("last_")).select(F.lit(name).alias("level_"), "last_"))
    if lasts:
        rest = rest.join(F.broadcast(reduce(DataFrame.unionByName, lasts)), "level_", "left")
    else:
        rest = rest.withColumn("last_", F.lit(None).cast(dict(rest.dtypes)["ordinal"]))
    none = [k for k, cap in caps.items() if cap <= 0]
    over = F.col("level_").isin(none) | F.coalesce(F.col("ordinal") > F.col("last_"), F.lit(False))
    rest = rest.withColumn("discarded", F.when(over, "below_threshold")).drop("last_")
    return rest.unionByName(out).drop("level_")


def path_tree(files: DataFrame, metrics: list[str]) -> DataFrame:
    """(path, parent, name, folder, files, folders, metrics): every file (path, metrics) and every folder above one, with '' as the root.

    A folder's metrics are sums over all files below; files and folders count what lies directly in it. Missing metrics count as 0.
    """
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    rows = files.select(F.array_join(parts, "/").alias("path"), *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in metrics]).where("path <> ''")
    rows = rows.groupBy("path").agg(*[F.sum(m).alias(m) for m in metrics])
    size = F.size(F.split("path", "/"))
    ups = rows.select(F.explode(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("up"), (size - 1).alias("depth"), *metrics)
    above = F.when(F.col("up") == "", 0).otherwise(F.size(F.split("up", "/")))
    folders = ups.groupBy(F.col("up").alias("path")).agg(F.count_if(F.col("depth") == above).alias("files"), *[F.sum(m).alias(m) for m in metrics])
    parent = F.when(F.col("path") == "", None).when(F.col("path").contains("/"), F.regexp_extract("path", "^(.*)/", 1)).otherwise("")
    inner = folders.where("path <> ''").groupBy(parent.alias("path")).agg(F.count("*").alias("folders"))
    folders = folders.join(inner, "path", "left").select("path", F.lit(True).alias("folder"), "files", F.coalesce("folders", F.lit(0)).alias("folders"), *metrics)
    leaves = rows.select("path", F.lit(False).alias("folder"), F.lit(0).cast("long").alias("files"), F.lit(0).cast("long").alias("folders"), *metrics)
    every = folders.unionByName(leaves)
    return every.select("path", parent.alias("parent"), F.substring_index("path", "/", -1).alias("name"), "folder", "files", "folders", *metrics)


def merged_configs(layers: DataFrame) -> DataFrame:
    """(scope, body): JSON objects of layers (scope, position, body) laid over each other; objects merge at any depth, all else, arrays too, is replaced.

    Layers are few for a scope. Null bodies and bodies that are no objects are skipped; keys come in order.
    """

    def over(low: dict, high: dict) -> dict:
        out = dict(low)
        for k, v in high.items():
            out[k] = over(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
        return out

    def merge(rows: pa.Table) -> pa.Table:
        done: dict = {}
        for body in rows.sort_by("position")["body"].to_pylist():
            try:
                value = json.loads(body) if body else None
            except ValueError:
                continue
            done = over(done, value) if isinstance(value, dict) else done
        return rows.slice(0, 1).select(["scope"]).append_column("body", pa.array([json.dumps(done, sort_keys=True, separators=(",", ":"), ensure_ascii=False)]))

    kind = dict(layers.dtypes)["scope"]
    return layers.select("scope", "position", "body").groupBy("scope").applyInArrow(merge, f"scope {kind}, body string")


def file_metric_rows(paths: DataFrame, metrics: DataFrame, heatmap: DataFrame, names: list[str]) -> DataFrame:
    """paths (path) with their metrics (path, names..., issue_count, coverage, last_review), missing or unsound ones 0; a heatmap's total (path, total) stands for issue_count.

    Where there is a coverage, last_review is left out.
    """
    sound = lambda c: F.when(c.isNotNull() & ~F.isnan(c.cast("double")) & (c >= 0) & (c < float("inf")), c.cast("double")).otherwise(0.0)
    rows = paths.select("path").join(metrics, "path", "left").join(heatmap.groupBy("path").agg(F.sum("total").alias("total")), "path", "left")
    shown = F.when(F.col("coverage").isNull(), F.col("last_review")).alias("last_review")
    return rows.select("path", *[sound(F.col(n)).alias(n) for n in names], sound(F.coalesce("total", "issue_count")).alias("issue_count"), "coverage", shown)


def metric_diff(before: DataFrame, after: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, state, before_, after_ and delta_ of every metric) of keys that came, went or changed; a delta is null where both sides are equal or none is there."""
    b = before.select(key, F.lit(True).alias("b_"), *[F.col(m).alias(f"before_{m}") for m in metrics])
    a = after.select(key, F.lit(True).alias("a_"), *[F.col(m).alias(f"after_{m}") for m in metrics])
    both = b.join(a, key, "full_outer")
    differs = reduce(lambda x, y: x | y, [~F.col(f"before_{m}").eqNullSafe(F.col(f"after_{m}")) for m in metrics])
    state = F.when(F.col("b_").isNull(), "added").when(F.col("a_").isNull(), "removed").when(differs, "changed")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    deltas = [F.when(~F.col(f"before_{m}").eqNullSafe(F.col(f"after_{m}")), zero(f"after_{m}") - zero(f"before_{m}")).alias(f"delta_{m}") for m in metrics]
    columns = [c for m in metrics for c in (f"before_{m}", f"after_{m}")]
    return both.withColumn("state", state).where("state is not null").select(key, "state", *columns, *deltas)


def graph_diff(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(kind, state, id, target, type): nodes (id, other columns) added, removed or changed in any column, and edges (source, target, type) added or removed."""
    columns = [c for c in before[0].columns if c != "id"]
    as_text = lambda df: df.select("id", F.to_json(F.struct(*[F.sort_array(F.map_entries(c)).alias(c) if dict(df.dtypes)[c].startswith("map") else F.col(c) for c in columns])).alias("v"))
    b, a = as_text(before[0]), as_text(after[0])
    both = b.withColumnRenamed("v", "b").join(a.withColumnRenamed("v", "a"), "id", "full_outer")
    state = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    none = F.lit(None).cast("string")
    nodes = both.select(F.lit("node").alias("kind"), state.alias("state"), F.col("id").cast("string").alias("id"), none.alias("target"), none.alias("type")).where("state is not null")
    ends = ["source", "target", "type"]
    x, y = (g[1].select(*ends).distinct().withColumn(n, F.lit(True)) for g, n in ((before, "b"), (after, "a")))
    edges = x.join(y, ends, "full_outer").where("a is null or b is null")
    return nodes.unionByName(edges.select(F.lit("edge").alias("kind"), F.when(F.col("b").isNull(), "added").otherwise("removed").alias("state"), F.col("source").cast("string").alias("id"), F.col("target").cast("string").alias("target"), "type"))


def resolved_references(uses: DataFrame, candidates: DataFrame, imports: DataFrame, imported: float, direct: float, least: float = 0.5, show: int = 5) -> DataFrame:
    """uses (use, file, symbol) with status, target, confidence, reason and candidates.

    candidates (symbol, target) are files that have the symbol, imports (file, target) what a file imports. One imported
    candidate wins, else the only one there is; else the symbol is not found or ambiguous, and a confidence below least
    isn't resolved either. Imported candidates are met by (symbol, target) and the others counted per symbol, so a
    popular symbol never meets all its uses.
    """
    c = candidates.select("symbol", "target").distinct()
    nth = F.row_number().over(Window.partitionBy("symbol").orderBy("target"))
    per = c.groupBy("symbol").agg(F.count("*").alias("n"), F.min("target").alias("any"))
    first = c.withColumn("nth", nth).where(F.col("nth") <= show).groupBy("symbol").agg(F.array_sort(F.collect_list("target")).alias("first"))
    near = uses.join(imports.select("file", "target").distinct(), "file").join(c, ["symbol", "target"]).groupBy("use").agg(F.count("*").alias("i"), F.min("target").alias("one"))
    rows = uses.join(per.join(first, "symbol"), "symbol", "left").join(near, "use", "left")
    way = F.when(F.col("i") == 1, F.struct(F.col("one").alias("target"), F.lit(imported).alias("confidence"))).when(F.col("n") == 1, F.struct(F.col("any").alias("target"), F.lit(direct).alias("confidence")))
    rows = rows.withColumn("way", way)
    sure = F.coalesce(F.col("way.confidence") >= least, F.lit(False))
    reason = F.when(sure, None).when(F.col("way").isNotNull(), "LOW_CONFIDENCE").when(F.col("n").isNull(), "SYMBOL_NOT_FOUND").otherwise("AMBIGUOUS_SYMBOL")
    shown = F.when(F.col("reason") == "AMBIGUOUS_SYMBOL", F.col("first"))
    rows = rows.withColumn("reason", reason)
    return rows.select("use", "file", "symbol", F.when(sure, "resolved").otherwise("unresolved").alias("status"), F.when(sure, F.col("way.target")).alias("target"), F.when(sure, F.col("way.confidence")).alias("confidence"), "reason", shown.alias("candidates"))


def breaking_changes(before: DataFrame, after: DataFrame, imports: DataFrame, most: int = 100) -> DataFrame:
    """(kind, file, symbol, total, importers, truncated) of exports (file, symbol) that before has and after hasn't.

    A file whose exports are all gone is one REMOVED_FILE_EXPORT_SURFACE with all its importers; else every symbol is a
    REMOVED_SYMBOL_EXPORT with those that name it, or name nothing. imports: (file: the importing one, target, symbols).
    importers are the first most of total.
    """
    b, a = (x.select("file", "symbol").distinct() for x in (before, after))
    kept = a.select("file").distinct().withColumn("kept", F.lit(True))
    lost = b.join(a, ["file", "symbol"], "left_anti").join(kept, "file", "left")
    whole = lost.where("kept is null").select("file").distinct().select(F.lit("REMOVED_FILE_EXPORT_SURFACE").alias("kind"), "file", F.lit(None).cast("string").alias("symbol"))
    single = lost.where("kept").select(F.lit("REMOVED_SYMBOL_EXPORT").alias("kind"), "file", "symbol")
    users = imports.select(F.col("file").alias("importer"), F.col("target").alias("file"), "symbols")
    by_file = whole.join(users, "file").select("kind", "file", "symbol", "importer")
    named = single.join(users.select("importer", "file", F.explode("symbols").alias("symbol")), ["file", "symbol"]).select("kind", "file", "symbol", "importer")
    every = single.join(users.where(F.size("symbols") == 0), "file").select("kind", "file", "symbol", "importer")
    used = by_file.unionByName(named).unionByName(every).distinct()
    key = ["kind", "file", "symbol"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("importer"))
    told = used.withColumn("nth", nth).groupBy(*key).agg(F.count("*").alias("total"), F.array_sort(F.collect_list(F.when(F.col("nth") <= most, F.col("importer")))).alias("importers"))
    changes = whole.unionByName(single).alias("c")
    same = (F.col("c.kind") == F.col("t.kind")) & (F.col("c.file") == F.col("t.file")) & F.col("c.symbol").eqNullSafe(F.col("t.symbol"))
    total = F.coalesce("total", F.lit(0)).cast("long")
    return changes.join(told.alias("t"), same, "left").select("c.kind", "c.file", "c.symbol", total.alias("total"), F.coalesce("importers", F.array().cast("array<string>")).alias("importers"), (total > most).alias("truncated"))


def bus_factors(files: DataFrame, ownership: DataFrame) -> DataFrame:
    """(district, bus_factor, files) of files (file, path) that someone owns (file, owner), by the folder of their path."""
    rows = files.select("file", district(F.col("path")).alias("district")).join(ownership.select("file", "owner").distinct(), "file")
    return rows.groupBy("district").agg(F.greatest(F.lit(1), F.countDistinct("owner")).alias("bus_factor"), F.countDistinct("file").alias("files"))


def rule_rates(feedback: DataFrame, half_life_hours: float = 168.0) -> DataFrame:
    """(rule, n, weight, accepted, rejected): rates of rows (rule, kind: accepted or false_positive or another, at, as_of), a row's weight halving with its age."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.col("as_of").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 3.6e9)
    rows = feedback.where(F.trim("rule") != "").withColumn("w", F.pow(F.lit(0.5), age / half_life_hours))
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("w"))), F.lit(0.0)) / F.sum("w")
    return rows.groupBy(F.trim("rule").alias("rule")).agg(F.count("*").alias("n"), F.sum("w").alias("weight"), part("accepted").alias("accepted"), part("false_positive").alias("rejected"))


def false_positives(rates: DataFrame, threshold: float = 0.5, deactivate: float = 0.7, least: int = 5, least_deactivate: int = 10) -> DataFrame:
    """(rule, rate, recommendation) of rule_rates() whose weighted rate of false positives is above the threshold, from least rows on."""
    rows = rates.where((F.col("rejected") > threshold) & (F.col("n") >= least))
    off = (F.col("rejected") >= deactivate) & (F.col("n") >= least_deactivate)
    return rows.select("rule", rounded(F.col("rejected"), 6).alias("rate"), F.when(off, "DEACTIVATE_RULE").otherwise("MONITOR").alias("recommendation"))


def team_patterns(rates: DataFrame, least: int = 5) -> DataFrame:
    """(rule, score, confidence): the weighted rate of acceptance less that of false positives, and how near the rows are to least."""
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("accepted") - F.col("rejected")))
    return rates.select("rule", rounded(score, 6).alias("score"), rounded(F.least(F.lit(1.0), F.col("n") / least), 6).alias("confidence"))


def top_hubs(edges: DataFrame, most: int = 10) -> DataFrame:
    """The nodes with most edges (source, target), then by name: a top-k report."""
    return degrees(edges.select("source", "target").distinct()).orderBy(F.desc("total"), "node").limit(most)


def structural_patterns(edges: DataFrame, nodes: DataFrame, cycles: DataFrame, fan_in: int = 3, fan_out: int = 3, spread: int = 3, cycle: int = 3, most: int = 10) -> DataFrame:
    """(type, name, score): the first patterns of each type by score, then name: hubs of edges (source, target), files of nodes (file, type) with many types, and cyclic components (component, size)."""
    e = edges.where("source <> target").select("source", "target").distinct()
    found = {
        "CIRCULAR_DEPENDENCY": cycles.where(F.col("size") >= cycle).select(F.col("component").alias("name"), F.col("size").alias("score")),
        "HIGH_FAN_IN": e.groupBy(F.col("target").alias("name")).agg(F.count("*").alias("score")).where(F.col("score") >= fan_in),
        "HIGH_FAN_OUT": e.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("score")).where(F.col("score") >= fan_out),
        "MIXED_ABSTRACTION": nodes.groupBy(F.col("file").alias("name")).agg(F.countDistinct("type").alias("score")).where(F.col("score") >= spread),
    }
    parts = [df.orderBy(F.desc("score"), "name").limit(most).select(F.lit(kind).alias("type"), "name", F.col("score").cast("long").alias("score")) for kind, df in found.items()]
    return reduce(DataFrame.unionByName, parts)


def limited_calls(calls: DataFrame, seconds: int, limit: int) -> DataFrame:
    """calls (id, key, at) in windows aligned to the epoch: (id, key, window, admitted, retry_after: seconds until the window ends, for rejected ones)."""
    rows = calls.withColumn("window", F.floor(F.unix_seconds(F.col("at").cast("timestamp")) / seconds) * seconds)
    n = F.row_number().over(Window.partitionBy("key", "window").orderBy("at", "id"))
    rows = rows.withColumn("admitted", n <= limit)
    wait = F.when(~F.col("admitted"), F.col("window") + seconds - F.unix_seconds(F.col("at").cast("timestamp")))
    return rows.select("id", "key", "window", "admitted", wait.alias("retry_after"))
