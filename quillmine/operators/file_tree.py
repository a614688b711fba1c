"""File trees under ignore files, and scans of what changed between two states of a tree."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmine.operators.source_code import language_of
from quillmine.sources.tables import rewritten


def _path(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit("\\"), F.lit("/"))


def _glob(c: Column) -> Column:
    """The pattern of a glob: ** crosses folders, * and ? stay within one, all else is itself."""
    quoted = F.regexp_replace(c, r"([-/\\^$+.()|\[\]{}])", r"\\$1")
    marked = F.replace(F.replace(quoted, F.lit("?"), F.lit("[^/]")), F.lit("**"), F.lit("\u0001"))
    return F.concat(F.lit("^"), F.replace(F.replace(marked, F.lit("*"), F.lit("[^/]*")), F.lit("\u0001"), F.lit(".*")), F.lit("$"))


def ignore_rules(files: DataFrame) -> DataFrame:
    """(base, place, negated, folders, deep, pattern) of the lines of ignore files (path, content).

    A rule holds below its file's folder, base. place orders all rules: files nearer the root first, then by path and
    line. folders: for folders only; deep: the pattern holds a slash and is held against the path below base, not
    against single names.
    """
    path = _path(F.col("path"))
    depth = F.size(F.filter(F.split(path, "/"), lambda p: p != ""))
    base = F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/", 1)).otherwise("")
    lines = files.select(base.alias("base"), depth.alias("depth"), path.alias("file"), F.posexplode(F.split("content", r"\r?\n")).alias("line", "text"))
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    lines = lines.withColumn("text", text).where("text <> '' and not startswith(text, '#')")
    plain = F.regexp_replace("text", r"^\\(?=[#!])", "")
    lines = lines.withColumn("text", plain).withColumn("negated", F.col("text").startswith("!"))
    lines = lines.withColumn("text", _path(F.when(F.col("negated"), F.substr("text", F.lit(2))).otherwise(F.col("text"))))
    rules = lines.withColumn("folders", F.col("text").endswith("/")).withColumn("pattern", F.regexp_replace("text", "^/+|/+$", "")).where("pattern <> ''")
    place = F.struct("depth", "file", "line").alias("place")
    return rules.select("base", place, "negated", "folders", F.col("pattern").contains("/").alias("deep"), "pattern")


def visible_tree(tree: DataFrame, ignore_files: DataFrame) -> DataFrame:
    """The nodes (path, type: tree or blob, other columns) that ignore files (path, content) leave; the last rule that matches decides.

    A rule matches a path if it matches any of the folders on the way to it. Folders without a node that is left go
    as well, unless there are no rules at all. Every path meets the rules of the folders above it only: those
    without wildcards by name, the others one by one.
    """
    rules = rewritten(ignore_rules(ignore_files))
    if rules.isEmpty():
        return tree
    rows = rewritten(tree.select(F.col("path").alias("given"), _path(F.col("path")).alias("path"), (F.col("type") == "tree").alias("folder")).distinct())
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    rows = rows.withColumn("parts", parts)
    # Every folder above, and below it every part of the way: what a rule of that folder is held against.
    above = rows.withColumn("up", F.explode(F.sequence(F.lit(0), F.size("parts") - 1)))
    above = above.withColumn("base", F.array_join(F.slice("parts", F.lit(1), F.col("up")), "/"))
    above = above.join(rules.select("base").distinct(), "base", "left_semi")
    ways = above.withColumn("to", F.explode(F.sequence(F.col("up") + 1, F.size("parts"))))
    below = F.array_join(F.slice("parts", F.col("up") + 1, F.col("to") - F.col("up")), "/")
    ways = ways.select("given", "base", below.alias("below"), F.element_at("parts", F.col("to")).alias("name"), (F.col("folder") | (F.col("to") < F.size("parts"))).alias("is_folder"))
    rules = rules.withColumn("wild", F.col("pattern").rlike(r"[*?]"))
    literal = rules.where("not wild").select("base", "place", "negated", "folders", "deep", F.col("pattern").alias("text"))
    held = ways.select("given", "base", "is_folder", F.explode(F.array(F.struct(F.lit(True).alias("deep"), F.col("below").alias("text")), F.struct(F.lit(False).alias("deep"), F.col("name").alias("text")))).alias("w")).select("given", "base", "is_folder", "w.*")
    wild = rules.where("wild").select("base", "place", "negated", "folders", "deep", _glob(F.col("pattern")).alias("glob"))
    met = held.join(literal, ["base", "deep", "text"]).select("given", "is_folder", "place", "negated", "folders")
    tried = held.join(wild, ["base", "deep"]).where(F.expr("text rlike glob"))
    met = met.unionByName(tried.select("given", "is_folder", "place", "negated", "folders")).where("is_folder or not folders")
    last = met.groupBy("given").agg(F.max(F.struct("place", "negated")).alias("m")).where("not m.negated").select("given")
    kept = rewritten(rows.join(last, "given", "left_anti"))
    ups = kept.where(F.size("parts") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.array_join(F.slice("parts", F.lit(1), i), "/"))).alias("path")).distinct()
    left = kept.where("not folder").select("given", "folder").unionByName(kept.where("folder").join(ups, "path", "left_semi").select("given", "folder"))
    same = (tree["path"] == left["given"]) & ((tree["type"] == "tree") == left["folder"])
    return tree.join(left, same, "left_semi")


def changed_files(base: DataFrame, head: DataFrame) -> DataFrame:
    """Of the files (repository, path, text) of two states the ones of head that base hasn't with the same text."""
    digest = F.sha2("text", 256)
    before = base.select("repository", "path", digest.alias("digest"))
    return head.withColumn("digest", digest).join(before, ["repository", "path", "digest"], "left_anti").drop("digest")


_TYPED_CALL = r"\b(public|private|protected|internal)?\s*(static\s+)?[A-Za-z0-9_<>, ?\[\]]+\s+[A-Za-z0-9_]+\s*\("
#: What counts as a declaration, and as a dependency, in a language's text (None: in any other language's).
DECLARED = {
    "python": (r"(?m)^\s*class\s+[A-Za-z0-9_]+", r"(?m)^\s*def\s+[A-Za-z0-9_]+\s*\("),
    "go": (r"\btype\s+[A-Za-z0-9_]+\s+(struct|interface)\b", r"\bfunc\s+(\([^)]+\)\s*)?[A-Za-z0-9_]+\s*\("),
    "java": (r"\b(class|interface|object)\s+[A-Za-z0-9_]+", _TYPED_CALL),
    "kotlin": (r"\b(class|interface|object)\s+[A-Za-z0-9_]+", _TYPED_CALL),
    "ruby": (r"(?m)^\s*class\s+[A-Za-z0-9_:]+", r"(?m)^\s*module\s+[A-Za-z0-9_:]+", r"(?m)^\s*def\s+[A-Za-z0-9_?!]+"),
    "rust": (r"\b(struct|trait|enum)\s+[A-Za-z0-9_]+", r"\bfn\s+[A-Za-z0-9_]+\s*\("),
    "php": (r"\b(class|interface|trait)\s+[A-Za-z0-9_]+", r"\bfunction\s+[A-Za-z0-9_]+\s*\("),
    "csharp": (r"\b(class|interface|record|struct)\s+[A-Za-z0-9_]+", _TYPED_CALL),
    None: (r"\b(class|interface|type)\s+[A-Za-z0-9_]+", r"\b(function|const|let|var)\s+[A-Za-z0-9_]+"),
}
NEEDED = {
    "python": (r"(?m)^\s*import\s+[A-Za-z0-9_.]+", r"(?m)^\s*from\s+[A-Za-z0-9_.]+\s+import\s+"),
    "go": (r'\bimport\s*(\(|")',),
    "java": (r"(?m)^\s*import\s+[A-Za-z0-9_.]+\s*;",),
    None: (r"""\bimport\s+[^;]+from\s+["'][^"']+["']""", r"""\brequire\(\s*["'][^"']+["']\s*\)"""),
}


def _counted(text: Column, language: Column, patterns: dict) -> Column:
    count = lambda given: sum((F.regexp_count(text, F.lit(p)) for p in given[1:]), F.regexp_count(text, F.lit(given[0])))
    found = count(patterns[None])
    for name, given in patterns.items():
        if name:
            found = F.when(language == name, count(given)).otherwise(found)
    return found.cast("long")


def scanned(files: DataFrame) -> DataFrame:
    """(repository, path, language, loc, nodes, edges) of the files (repository, path, text) whose language is known; missing texts are left out.

    loc are lines that aren't blank, nodes the declarations and edges the dependencies that patterns find.
    """
    language = language_of(F.col("path"), F.coalesce("text", F.lit("")))
    rows = files.where("text is not null").withColumn("language", language).where("language is not null")
    loc = F.size(F.filter(F.split("text", r"\r?\n"), lambda x: x.rlike(r"\S"))).cast("long")
    return rows.select("repository", "path", "language", loc.alias("loc"), _counted(F.col("text"), F.col("language"), DECLARED).alias("nodes"), _counted(F.col("text"), F.col("language"), NEEDED).alias("edges"))


def scan_totals(stats: DataFrame) -> DataFrame:
    """(repository, language, files, loc, nodes, edges) of scanned()."""
    return stats.groupBy("repository", "language").agg(F.count("*").alias("files"), *[F.sum(c).alias(c) for c in ("loc", "nodes", "edges")])


def changed_stream(files: DataFrame) -> DataFrame:
    """Of a stream of files (repository, ref, path, digest, at) the ones whose digest is another than the last one seen of that file.

    The state, one digest a file, is kept with the stream's checkpoint, so a restart scans nothing twice. Files of
    one batch are taken in the order of at, then digest; a digest that comes back after another counts as changed.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["at", "digest"])
        new = []
        for digest, at in zip(rows["digest"], rows["at"], strict=True):
            if digest != known:
                new.append((*key, digest, at))
                known = digest
        state.update((known,))
        yield pd.DataFrame(new, columns=["repository", "ref", "path", "digest", "at"])

    return files.groupBy("repository", "ref", "path").applyInPandasWithState(run, "repository string, ref string, path string, digest string, at timestamp", "digest string", "append", GroupStateTimeout.NoTimeout)
