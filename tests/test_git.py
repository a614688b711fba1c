"""Commits, blame and differences of a repository made here."""

import datetime as dt
import subprocess

import pytest
from pyspark.sql import functions as F

from quillmine.sources import git


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repository")

    def run(*arguments, day=1, who="Ann Lee"):
        env = {"GIT_AUTHOR_NAME": who, "GIT_AUTHOR_EMAIL": f"{who[:3].lower()}@x.org", "GIT_COMMITTER_NAME": "c", "GIT_COMMITTER_EMAIL": "c@x.org", "HOME": str(root), "PATH": "/usr/bin:/bin:/usr/local/bin"}
        env |= {k: f"2024-01-{day:02d}T12:00:00+00:00" for k in ("GIT_AUTHOR_DATE", "GIT_COMMITTER_DATE")}
        subprocess.run(["git", "-C", str(root), *arguments], env=env, check=True, capture_output=True)

    def write(name, text):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)

    run("init", "-q", "-b", "main")
    write("a.py", "one\ntwo\nthree\n")
    write("src/née.ts", "x\n" * 9)
    run("add", "-A")
    run("commit", "-qm", "first\n\nwith a body", day=1)
    write("a.py", "one\nTWO\nthree\nfour\n")
    run("commit", "-qam", "second", day=2, who="Bo Ray")
    run("tag", "old")
    run("mv", "src/née.ts", "src/new.ts")
    write("b.go", "package b\n")
    run("add", "-A")
    run("commit", "-qm", "third", day=3)
    run("rm", "-q", "a.py")
    run("commit", "-qm", "fourth", day=4, who="Bo Ray")
    return str(root)


@pytest.fixture(autouse=True)
def registered(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    git.register(spark)


def test_commits(spark, repository):
    rows = git.commit_history(spark, repository).orderBy("committed_at").collect()
    assert [(r.message, r.author_name, r.author_email) for r in rows] == [("first\n\nwith a body", "Ann Lee", "ann@x.org"), ("second", "Bo Ray", "bo @x.org"), ("third", "Ann Lee", "ann@x.org"), ("fourth", "Bo Ray", "bo @x.org")]
    assert sorted(rows[0].files_changed) == ["a.py", "src/née.ts"] and sorted(rows[2].files_changed) == ["b.go", "src/new.ts"]
    day = lambda n: dt.datetime(2024, 1, n, 12, tzinfo=dt.timezone.utc)
    names = lambda **k: [r.message.split("\n")[0] for r in git.commit_history(spark, repository, **k).orderBy("committed_at").collect()]
    assert names(since=day(2), until=day(3)) == ["second", "third"]
    assert names(author="Bo") == ["second", "fourth"] and names(author="Bo", most=1) == ["fourth"]
    assert names(path="src") == ["first", "third"] and names(ref="old") == ["first", "second"]


def test_predicates_thin_the_listing(repository):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

    reader = git.CommitReader({"path": repository, "slice": "1"})
    given = [EqualTo(("author_name",), "Bo Ray"), GreaterThanOrEqual(("committed_at",), dt.datetime(2024, 1, 3, tzinfo=dt.timezone.utc)), EqualTo(("message",), "x")]
    assert list(reader.pushFilters(given)) == given
    parts = reader.partitions()
    assert len(parts) == 1 and next(iter(reader.read(parts[0])))[1] == "fourth"
    assert len(git.CommitReader({"path": repository, "slice": "1"}).partitions()) == 4


def test_pushed_filters_give_the_same_rows(spark, repository):
    rows = spark.read.format("git_commits").option("path", repository).load()
    assert [r.message for r in rows.where("author_name = 'Bo Ray' and committed_at >= timestamp'2024-01-03 00:00:00'").collect()] == ["fourth"]
    assert rows.where("author_name = 'Bo'").count() == 0


def test_blame(spark, repository):
    got = [tuple(r)[:3] + (r.author_name, r.committed_at.day) for r in git.blame(spark, repository, ["a.py"], "old").orderBy("line_start").collect()]
    assert got == [("a.py", 1, 1, "Ann Lee", 1), ("a.py", 2, 2, "Bo Ray", 2), ("a.py", 3, 3, "Ann Lee", 1), ("a.py", 4, 4, "Bo Ray", 2)]
    batch = git.blame(spark, repository, ref="old").where(F.col("path").isin("src/née.ts", "gone")).collect()
    assert [(r.path, r.line_start, r.line_end) for r in batch] == [("src/née.ts", 1, 9)]


def test_diff(spark, repository):
    files = git.ref_diff(spark, repository, "old", "main")
    got = {r.path: r for r in files.collect()}
    assert {p: (r.status, r.old_path, r.additions, r.deletions) for p, r in got.items()} == {"a.py": ("deleted", None, 0, 4), "b.go": ("added", None, 1, 0), "src/new.ts": ("renamed", "src/née.ts", 0, 0)}
    assert got["a.py"].hunks == ["@@ -1,4 +0,0 @@\n-one\n-TWO\n-three\n-four"]
    assert git.diff_summary(files).first().asDict() == {"changed_files": 3, "added_files": 1, "modified_files": 0, "deleted_files": 1, "renamed_files": 1, "additions": 1, "deletions": 4, "changes": 5}


def test_errors_and_empty_ranges(spark, repository):
    assert git.ref_diff(spark, repository, "main", "main").count() == 0
    assert git.blame(spark, repository, ["gone"]).count() == 0
    with pytest.raises(Exception, match="git rev-list"):
        git.commit_history(spark, repository, ref="nowhere").collect()
