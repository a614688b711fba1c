"""Rules, suggestions and settings of reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.operators import alike
from quillmine.sources.tables import rewritten


def resolved_rules(layers: DataFrame) -> DataFrame:
    """Enabled rules of layers (rule, layer, position, enabled): the last layer that names a rule decides; the first place it was named orders."""
    last = F.max_by("enabled", F.struct("layer", "position"))
    rows = layers.groupBy("rule").agg(last.alias("enabled"), F.min(F.struct("layer", "position")).alias("f"))
    return rows.where("enabled").select("rule", F.col("f.layer").alias("layer"), F.col("f.position").alias("position"))


def merged_settings(layers: DataFrame, by: str) -> DataFrame:
    """Settings (by, key, layer, value) where the last layer that sets a key wins; keys are dotted paths, so that nested ones merge."""
    return layers.groupBy(by, "key").agg(F.max_by("value", "layer").alias("value"))


def already_done(suggestions: DataFrame, patches: DataFrame) -> DataFrame:
    """Suggestions (id, file, code) with keep: false where the code, not blank, occurs in the file's patch (file, patch)."""
    rows = suggestions.join(patches, "file", "left")
    done = (F.trim(F.coalesce("code", F.lit(""))) != "") & F.coalesce(F.contains(F.col("patch"), F.trim("code")), F.lit(False))
    return rows.groupBy("id", "file").agg((~F.max(done)).alias("keep"))


def grounded(suggestions: DataFrame, patches: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Suggestions (id, file, code) with keep: true without a patch of the file or if the code is in it; else the verdict (id, real) decides, true if there is none."""
    rows = suggestions.join(patches, "file", "left").join(verdicts, "id", "left")
    found = F.col("patch").isNull() | F.coalesce(F.contains(F.col("patch"), F.trim("code")), F.lit(False))
    return rows.groupBy("id", "file").agg(F.max(found | F.coalesce("real", F.lit(True))).alias("keep"))


def with_both_ends(nodes: DataFrame, edges: DataFrame, part: str) -> DataFrame:
    """Edges between nodes (node, name) whose names hold the text, in any case."""
    kept = nodes.where(F.contains(F.lower("name"), F.lit(part.lower()))).select("node")
    return edges.join(kept.withColumnRenamed("node", "source"), "source", "left_semi").join(kept.withColumnRenamed("node", "target"), "target", "left_semi")


def in_scope(rows: DataFrame, scope: str, user: int, team: list[int], repositories: list[int]) -> DataFrame:
    """Rows (owner, repository) of a user, of the user's team (with the user), or of repositories."""
    if scope == "mine":
        return rows.where(F.col("owner") == user)
    if scope == "team":
        return rows.where(F.col("owner").isin(user, *team))
    return rows.where(F.col("repository").isin(*repositories))


def batches(files: DataFrame, size: int) -> DataFrame:
    """(fingerprint, batch, files): files (file, fingerprint) of one fingerprint in their order, so many a batch."""
    n = F.row_number().over(Window.partitionBy("fingerprint").orderBy("file")) - 1
    rows = files.withColumn("batch", F.floor(n / size).cast("long"))
    return rows.groupBy("fingerprint", "batch").agg(F.array_sort(F.collect_list("file")).alias("files"))


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the ranges [a, b] and [c, d], ends included, share a line."""
    return (a <= d) & (c <= b)


def combined_issues(issues: DataFrame, levels: list[str], cap: int) -> DataFrame:
    """Issues (id, source, severity, path, kind): the first source of an id, in the order of severity, path, source, kind and id, cut at the cap."""
    first = issues.groupBy("id").agg(F.min_by(F.struct("source", "severity", "path", "kind"), "source").alias("i")).select("id", "i.*")
    rank = F.array_position(F.array(*map(F.lit, levels)), F.col("severity"))
    return first.withColumn("rank", F.when(rank == 0, len(levels) + 1).otherwise(rank)).orderBy("rank", "path", "source", "kind", "id").limit(cap)


def merged_heatmap(counts: DataFrame) -> DataFrame:
    """(file, total, severities): issue counts (file, severity, n) of several sources, added up."""
    per = counts.groupBy("file", "severity").agg(F.sum("n").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("severity", "n")))
    return per.groupBy("file").agg(F.sum("n").alias("total"), F.to_json(F.map_from_entries(pairs)).alias("severities"))


def metric_rows(files: DataFrame, metrics: dict[str, DataFrame]) -> DataFrame:
    """files (path and other columns, repeats kept) with each metric (path, value); missing, NaN, infinite and negative ones are 0."""
    for name, values in metrics.items():
        v = F.col("v_")
        sound = v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))
        files = files.join(values.select("path", F.col("value").cast("double").alias("v_")), "path", "left")
        files = files.withColumn(name, F.when(sound, v).otherwise(0.0)).drop("v_")
    return files


def similar_files(features: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity): files, a < b, whose sets of features (file, feature) are alike at Jaccard least or more.

    Files meet on the features that a file's prefix holds, the rarest first: sets so alike share one of the
    first n - ceil(least * n) + 1 features, so that frequent features join nothing. They are compared where they meet on
    the first feature they share. Files of a feature that few have are joined; others meet in packed blocks, of which
    a task holds two.
    """
    f = features.where("file is not null and feature is not null").select("file", "feature").distinct()
    often = f.groupBy("feature").agg(F.count("*").alias("often"))
    sized = f.join(often, "feature").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("often", "feature"))).alias("s"))
    sized = sized.select("file", F.transform("s", lambda x: x["feature"]).alias("s"))
    n = F.size("s")
    prefix = rewritten(sized.select("file", "s", F.posexplode(F.slice("s", F.lit(1), (n - F.ceil(F.lit(least) * n) + 1).cast("int"))).alias("at", "feature")))
    sizes = rewritten(prefix.groupBy("feature").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / alike.BLOCK)))
    few = prefix.join(sizes.where(F.col("n") <= alike.FEW), "feature").select("feature", "file", "s")
    a, b = few.toDF("feature", "a", "x"), few.toDF("feature", "b", "y")
    met = a.join(b, "feature").where("a < b").withColumn("both", F.array_intersect("x", "y")).where("both[0] = feature")
    similarity = F.size("both") / (F.size("x") + F.size("y") - F.size("both"))
    found = met.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= least)
    many = sizes.where(F.col("n") > alike.FEW)
    meetings = many.agg(F.sum(F.expr("blocks * (blocks + 1) / 2"))).first()[0]
    if not meetings:
        return found
    dealt = prefix.join(many, "feature").withColumn("block", F.pmod(F.xxhash64("file"), F.col("blocks"))).select("feature", "blocks", "block", "file", "at", "s")
    kinds = dict(dealt.dtypes)
    blocks = rewritten(dealt.groupBy("feature", "blocks", "block").applyInArrow(alike.pack, f"feature {kinds['feature']}, blocks long, block long, held binary"))
    parts = int(min(alike.MOST_PARTS, meetings))
    x = blocks.select("feature", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("deal"), F.col("held").alias("x"), F.col("block").alias("own")).repartition(parts, "feature", "deal")
    y = blocks.select("feature", F.col("block").alias("deal"), F.col("held").alias("y")).repartition(parts, "feature", "deal")
    met = x.join(y.hint("merge"), ["feature", "deal"]).select("x", "y", (F.col("own") == F.col("deal")).alias("same"))
    large = met.mapInArrow(alike.compare(least), f"a {kinds['file']}, b {kinds['file']}, similarity double")
    return found.unionByName(large.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity"))


def resolved_symbols(uses: DataFrame, candidates: DataFrame, show: int = 3) -> DataFrame:
    """uses (use, symbol) with status and target, from candidates (symbol, target, imported): one imported target wins, else the only one; more are ambiguous."""
    c = candidates.groupBy("symbol").agg(
        F.count_if("imported").alias("i"), F.count("*").alias("n"), F.min(F.when(F.col("imported"), F.col("target"))).alias("one"), F.min("target").alias("any"),
        F.slice(F.array_sort(F.collect_set("target")), 1, show).alias("all"),
    )
    rows = uses.join(c, "symbol", "left")
    status = F.when(F.col("n").isNull(), "SYMBOL_NOT_FOUND").when((F.col("i") == 1) | (F.col("n") == 1), "RESOLVED").otherwise("AMBIGUOUS")
    target = F.when(F.col("i") == 1, F.col("one")).when(F.col("n") == 1, F.col("any"))
    return rows.select("use", "symbol", status.alias("status"), target.alias("target"), F.when((F.col("n") > 1) & (F.col("i") != 1), F.array_join(F.col("all").cast("array<string>"), ",")).alias("candidates"))


def context_gate(files: DataFrame, context: DataFrame, size: int) -> DataFrame:
    """batches() of the files (file, fingerprint) that are among context (file); of all of them if context is empty."""
    kept = files if context.isEmpty() else files.join(context.select("file").distinct(), "file", "left_semi")
    return batches(kept, size)
