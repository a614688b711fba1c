"""Repositories as tables: commits, blamed line ranges and differences of refs, read by Spark's Python data sources.

The repository (option path) lies in a folder that driver and executors share, and git is installed on both. The
driver only lists what is to be read and deals it out; partitions read their part themselves. Register with
register(spark); options: ref (default HEAD), slice (commits, files or paths of a partition).

Filters on author_name, committed_at and path are handed to the source if
spark.sql.python.filterPushdown.enabled is true, and then thin what is listed, not what is read.
"""

from __future__ import annotations

import datetime as dt
import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

COMMITS = "sha string, message string, author_name string, author_email string, committed_at timestamp, files_changed array<string>"
BLAME = "path string, line_start int, line_end int, sha string, author_name string, author_email string, committed_at timestamp"
DIFF = "path string, status string, old_path string, additions long, deletions long, changes long, patch string, hunks array<string>"
# Names of git's letters.
STATUS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "added", "T": "modified"}


def git(repository: str, *arguments: str, given: str | None = None) -> str:
    """What a git command prints; its complaint is the error."""
    done = subprocess.run(["git", "-c", "core.quotepath=off", "-C", repository, *arguments], input=given, capture_output=True, text=True, encoding="utf-8", errors="replace", check=False)
    if done.returncode:
        raise ValueError(f"git {arguments[0]}: {done.stderr.strip()}")
    return done.stdout


@dataclass
class Slice(InputPartition):
    items: tuple


def _dealt(items: list, size: int) -> list[Slice]:
    return [Slice(tuple(items[i : i + size])) for i in range(0, len(items), size)] or [Slice(())]


def _utc(seconds: str) -> dt.datetime:
    return dt.datetime.fromtimestamp(int(seconds), dt.timezone.utc)


class _Reader(DataSourceReader):
    size = 500

    def __init__(self, options: dict):
        self.root = options["path"]
        self.ref = options.get("ref", "HEAD").strip()
        self.options = options
        self.slice = int(options.get("slice", self.size))
        if not self.ref or self.ref.startswith("-"):
            raise ValueError("ref must name a commit")


class CommitReader(_Reader):
    """Lists the commits that pushed filters may leave, and reads message and files of each slice."""

    size = 2000

    def __init__(self, options: dict):
        super().__init__(options)
        self.pushed: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        # Spark holds what git leaves against the filters once more, as git's own tests are wider.
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if name == "author_name" and isinstance(f, EqualTo) and f.value:
                self.pushed += ["--fixed-strings", f"--author={f.value}"]
            elif name == "committed_at" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.pushed.append(f"--since={int(f.value.timestamp()) - 1}")
            elif name == "committed_at" and isinstance(f, (LessThan, LessThanOrEqual)):
                self.pushed.append(f"--until={int(f.value.timestamp()) + 1}")
            yield f

    def partitions(self) -> list[InputPartition]:
        paths = ["--", *self.options["paths"].split("\n")] if self.options.get("paths") else []
        return _dealt(git(self.root, "rev-list", *self.pushed, self.ref, *paths).split(), self.slice)

    def read(self, part: Slice) -> Iterator[tuple]:
        if not part.items:
            return
        told = git(self.root, "log", "--no-walk=unsorted", "--stdin", "--name-only", "-m", "--first-parent", "--format=%x1e%H%x1f%B%x1f%an%x1f%ae%x1f%at%x1f", given="\n".join(part.items))
        for block in told.split("\x1e")[1:]:
            sha, message, name, mail, at, files = block.split("\x1f")
            yield sha, message.rstrip("\n"), name, mail, _utc(at), [f for f in files.split("\n") if f]


class BlameReader(_Reader):
    """Blames the paths asked for (option paths, one a line; all files of the ref without it) in slices."""

    size = 50

    def __init__(self, options: dict):
        super().__init__(options)
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("path",) and isinstance(f, (EqualTo, In)):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = names if self.only is None else self.only & names
            yield f

    def partitions(self) -> list[InputPartition]:
        there = git(self.root, "ls-tree", "-r", "-z", "--name-only", self.ref).split("\0")
        asked = set(self.options["paths"].split("\n")) if self.options.get("paths") else None
        return _dealt([p for p in there if p and (asked is None or p in asked) and (self.only is None or p in self.only)], self.slice)

    def read(self, part: Slice) -> Iterator[tuple]:
        for path in part.items:
            known: dict[str, dict[str, str]] = {}
            run: list | None = None
            sha, line = "", 0
            for row in git(self.root, "blame", "--line-porcelain", self.ref, "--", path).split("\n"):
                if head := re.fullmatch(r"([0-9a-f]{40,64}) \d+ (\d+)(?: \d+)?", row):
                    sha, line = head[1], int(head[2])
                    known.setdefault(sha, {})
                elif row.startswith("\t"):
                    if run and run[2] == sha and run[1] == line - 1:
                        run[1] = line
                        continue
                    if run:
                        yield self._row(path, run, known)
                    run = [line, line, sha]
                elif " " in row and sha:
                    key, _, value = row.partition(" ")
                    known[sha][key] = value
            if run:
                yield self._row(path, run, known)

    def _row(self, path: str, run: list, known: dict) -> tuple:
        said = known[run[2]]
        return path, run[0], run[1], run[2], said["author"], said["author-mail"].strip("<>"), _utc(said["author-time"])


class DiffReader(_Reader):
    """Lists the files that differ from option base to ref (from their last common commit on), renames found, and reads their patches in slices."""

    size = 200

    def partitions(self) -> list[InputPartition]:
        told = git(self.root, "diff", "--name-status", "-z", "-M", f"{self.options['base']}...{self.ref}").split("\0")
        found, at = [], 0
        while at < len(told) and told[at]:
            letter = told[at][0]
            both = letter in "RC"
            found.append((letter, told[at + 1] if both else None, told[at + 1 + both]))
            at += 2 + both
        return _dealt(found, self.slice)

    def read(self, part: Slice) -> Iterator[tuple]:
        for letter, old, path in part.items:
            patch = git(self.root, "diff", "-M", f"{self.options['base']}...{self.ref}", "--", *([old] if old else []), path)
            at = re.search(r"(?m)^@@ ", patch)
            body = patch[at.start() :] if at else ""
            hunks = [h.rstrip("\n") for h in re.split(r"(?m)^(?=@@ )", body) if h]
            marks = [x[:1] for h in hunks for x in h.split("\n")[1:]]
            more, less = marks.count("+"), marks.count("-")
            yield path, STATUS.get(letter, "modified"), old if letter == "R" else None, more, less, more + less, body.rstrip("\n"), hunks


def _source(short: str, columns: str, reads: type[_Reader]) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return short

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> DataSourceReader:
            return reads(dict(self.options))

    return Source


def register(spark: SparkSession) -> None:
    """Makes the formats git_commits, git_blame and git_diff known to a session."""
    for source in (_source("git_commits", COMMITS, CommitReader), _source("git_blame", BLAME, BlameReader), _source("git_diff", DIFF, DiffReader)):
        spark.dataSource.register(source)


def commit_history(spark: SparkSession, repository: str, ref: str = "HEAD", author: str | None = None, since: dt.datetime | None = None, until: dt.datetime | None = None, path: str | None = None, most: int | None = None) -> DataFrame:
    """Commits that lead to ref, the newest first if most is given; author is part of a name or address, path a file or folder."""
    rows = spark.read.format("git_commits").option("path", repository).option("ref", ref)
    rows = (rows.option("paths", path) if path else rows).load()
    if author is not None:
        rows = rows.where(F.contains("author_name", F.lit(author)) | F.contains("author_email", F.lit(author)))
    if since is not None:
        rows = rows.where(F.col("committed_at") >= F.lit(since))
    if until is not None:
        rows = rows.where(F.col("committed_at") <= F.lit(until))
    return rows if most is None else rows.orderBy(F.desc("committed_at"), "sha").limit(most)


def blame(spark: SparkSession, repository: str, paths: list[str] | None = None, ref: str = "HEAD") -> DataFrame:
    """Ranges of lines last changed together, of the paths given (one or many), or of all files."""
    rows = spark.read.format("git_blame").option("path", repository).option("ref", ref)
    return (rows if paths is None else rows.option("paths", "\n".join(paths))).load()


def ref_diff(spark: SparkSession, repository: str, base: str, head: str) -> DataFrame:
    """Files that differ from base to head, with status, old path, counts, patch and hunks."""
    return spark.read.format("git_diff").option("path", repository).option("base", base).option("ref", head).load()


def diff_summary(files: DataFrame) -> DataFrame:
    """One row of totals of ref_diff()."""
    kinds = [F.count_if(F.col("status") == k).alias(f"{k}_files") for k in ("added", "modified", "deleted", "renamed")]
    return files.agg(F.count("*").alias("changed_files"), *kinds, *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("additions", "deletions", "changes")])
