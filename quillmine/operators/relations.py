"""Joins and rules between files, symbols, layers and contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.sources.tables import rewritten


def tightest_container(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Of the functions (file, function, first, last) that hold a call (id, file, line), the one of the least span.

    Equal ranges of a file count once, as do its called lines. Ranges whose spans have the same number of bits lie in
    one or two cells of that size, and a line meets the ranges of its own cell of every size that its file has; so a
    line doesn't meet the functions elsewhere in its file, and the calls themselves meet only what their lines have found.
    """
    ranges = functions.where("first <= last").groupBy("file", "first", "last").agg(F.min("function").alias("function"))
    from_, to = F.floor("first").cast("long"), F.floor("last").cast("long")
    ranges = ranges.withColumn("bits", F.length(F.bin(to - from_))).withColumn("from", from_).withColumn("to", to)
    sizes = ranges.select("file", "bits").distinct()
    cells = ranges.withColumn("cell", F.explode(F.array_distinct(F.array(F.expr("shiftright(`from`, bits)"), F.expr("shiftright(`to`, bits)")))))
    lines = calls.select("file", "line").distinct()
    asked = lines.join(sizes, "file").withColumn("cell", F.expr("shiftright(cast(floor(line) as long), bits)"))
    met = asked.join(cells, ["file", "bits", "cell"]).where(F.col("line").between(F.col("first"), F.col("last")))
    least = F.min(F.struct((F.col("last") - F.col("first")).alias("span"), "first", "function"))
    found = rewritten(met.groupBy("file", "line").agg(least.alias("f")))
    return calls.select("id", "file", "line").join(found, ["file", "line"]).groupBy("id").agg(F.min("f").alias("f")).select("id", "f.function", "f.span")


def first_existing(rows: DataFrame, candidates: Column, targets: DataFrame) -> DataFrame:
    """For each row (id) the first of its candidates that is among targets (target); rows without one go."""
    tried = rows.select("id", F.posexplode(candidates).alias("pos", "target"))
    return tried.join(targets.select("target").distinct(), "target", "left_semi").groupBy("id").agg(F.min(F.struct("pos", "target")).alias("m")).select("id", "m.pos", "m.target")


def shared_symbols(uses: DataFrame, least: int) -> DataFrame:
    """Pairs of repositories (repo, symbol) with at least so many symbols in common, the first of them standing for all."""
    u = uses.select("repo", "symbol").distinct()
    a, b = u.alias("a"), u.alias("b")
    met = a.join(b, (F.col("a.symbol") == F.col("b.symbol")) & (F.col("a.repo") < F.col("b.repo")))
    pairs = met.groupBy(F.col("a.repo").alias("left"), F.col("b.repo").alias("right")).agg(F.count("*").alias("shared"), F.min("a.symbol").alias("symbol"))
    return pairs.where(F.col("shared") >= least)


def layer_verdict(mode: Column, allowed: Column) -> Column:
    """An explicit rule decides; without one the layer's allow-list does."""
    return F.when(mode == "forbid", "forbidden").when(mode == "allow", "ok").when(F.coalesce(allowed, F.lit(False)), "ok").otherwise("not allowed")


def surface_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Symbols (symbol, kinds: sorted array) removed, added or changed, with a severity."""
    both = before.select("symbol", F.col("kinds").alias("b")).join(after.select("symbol", F.col("kinds").alias("a")), "symbol", "full_outer")
    change = F.when(F.col("a").isNull(), "REMOVED").when(F.col("b").isNull(), "ADDED").when(F.col("a") != F.col("b"), "CHANGED")
    severity = F.when(F.col("change") == "REMOVED", "HIGH").when(F.col("change") == "CHANGED", "MEDIUM").otherwise("LOW")
    return both.select("symbol", change.alias("change")).where("change is not null").withColumn("severity", severity)


def breaking(removed: DataFrame, imports: DataFrame, report: int = 100) -> DataFrame:
    """Importers (symbol, importer) of removed symbols: how many, and the first of them as a report."""
    users = imports.join(removed.select("symbol").distinct(), "symbol", "left_semi").select("symbol", "importer").distinct()
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("importer"))
    first = users.withColumn("n", n).where(F.col("n") <= report).groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_list("importer")), ",").alias("importers"))
    return users.groupBy("symbol").agg(F.count("*").alias("total")).join(first, "symbol")


def contract_issues(names: DataFrame, contracts: DataFrame) -> DataFrame:
    """Names that no contract, or more than one, answers to."""
    n = contracts.groupBy("name").agg(F.count("*").alias("n"))
    found = names.select("name").distinct().join(n, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))
    return found.where("n <> 1").withColumn("issue", F.when(F.col("n") == 0, "MISSING").otherwise("AMBIGUOUS"))


def first_per_severity(rows: DataFrame, severity: str, ordinal: str, cap: int) -> DataFrame:
    """Marks the first rows of every severity; each task passes on no more than cap rows of one.

    Ordinals are unique; the join's other side has one row per severity.
    """
    n = F.row_number().over(Window.partitionBy(severity).orderBy(ordinal))
    last = rows.select(severity, ordinal).withColumn("n", n).where(F.col("n") <= cap).groupBy(severity).agg(F.max(ordinal).alias("_last"))
    return rows.join(last, severity).withColumn("kept", F.col(ordinal) <= F.col("_last")).drop("_last")


def line_matches(files: DataFrame, pattern: str) -> DataFrame:
    """Matches of a pattern, line by line: (id, line from 1, nth in its line from 1, match); empty matches are skipped."""
    lines = files.select("id", F.posexplode(F.split("text", "\n", -1)).alias("at", "body"))
    found = lines.select("id", (F.col("at") + 1).alias("line"), F.posexplode(F.regexp_extract_all("body", F.lit(pattern), F.lit(0))).alias("i", "match"))
    return found.where("match <> ''").select("id", "line", (F.col("i") + 1).alias("nth"), "match")


def ancestors(path: Column) -> Column:
    """Directories above a path, nearest last."""
    parts = F.split(path, "/", -1)
    return F.transform(F.slice(F.sequence(F.lit(0), F.size(parts) - 1), 2, F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def admitted(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Calls (id, key, at) in windows aligned to the epoch; those beyond the limit are rejected."""
    rows = events.withColumn("window", F.floor(F.unix_seconds("at") / seconds) * seconds)
    n = F.row_number().over(Window.partitionBy("key", "window").orderBy("at", "id"))
    return rows.select("id", "key", "window", (n <= limit).alias("admitted"))
