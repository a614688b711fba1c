"""Custom rules over files: patterns, injected checks and verdicts of a model, dispatched by a table function; embeddings by an injected function."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules at most; they go to every task.
MOST_RULES = 10_000
#: Weights of severities.
WEIGHTS = {"INFO": 0, "LOW": 10, "MEDIUM": 20, "HIGH": 30, "CRITICAL": 50}
FOUND = "rule string, line_start int, line_end int, severity string, message string, code string, match_id string"
#: A check of a rule's text on a file: (path, content, rule text) -> (first line, last line, message, code) of each match.
Check = Callable[[str, str, str], Iterable[tuple[int, int, str, str]]]


def rule_table(spark: SparkSession, rules: DataFrame, check: Check | None = None, name: str = "apply_rules") -> None:
    """Registers a table function name(path, content), to be called laterally, that gives what rules (id, type, title, rule, severity) find in a file.

    REGEX rules give every match that isn't empty, AST rules what check finds; PROMPT rules are joined as
    verdicts by dispatch(). A pattern that can't be compiled, a type that isn't known, or an AST rule without a check
    is an error here, before any file is read.
    """
    rows = [r.asDict() for r in rules.select("id", "type", "title", "rule", "severity").limit(MOST_RULES + 1).collect()]
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    for r in rows:
        if r["type"] not in ("REGEX", "AST", "PROMPT"):
            raise ValueError(f"rule {r['id']}: type {r['type']}")
        if r["type"] == "AST" and check is None:
            raise ValueError(f"rule {r['id']}: no check for AST rules was given")
        if r["type"] == "REGEX":
            try:
                re.compile(r["rule"])
            except re.error as wrong:
                raise ValueError(f"rule {r['id']}: {wrong}") from wrong

    class Found:
        def __init__(self):
            self.rules = [(r, re.compile(r["rule"]) if r["type"] == "REGEX" else None) for r in rows if r["type"] != "PROMPT"]

        def eval(self, path: str, content: str) -> Iterator[tuple]:
            if not path or not content or not content.strip():
                return
            for r, pattern in self.rules:
                if pattern is None:
                    for first, last, message, code in check(path, content, r["rule"]):
                        yield r["id"], first, last, r["severity"], f"{r['title']}: {message}", code, None
                    continue
                line = at = 0
                for m in pattern.finditer(content):
                    if m.group():
                        line, at = line + content.count("\n", at, m.start()), m.start()
                        last = line + m.group().count("\n")
                        digest = hashlib.sha256(f"{path}|{m.start()}|{m.group()}".encode()).hexdigest()
                        yield r["id"], line + 1, last + 1, r["severity"], f"{r['title']}: {r['rule']}", m.group().strip(), f"{r['id']}:regex:{digest}"

    spark.udtf.register(name, F.udtf(Found, returnType=FOUND))


def dispatch(files: DataFrame, rules: DataFrame, check: Check | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """What rules find in files (path, content): path, rule, line_start, line_end, severity, message, code, match_id, weight.

    verdicts (rule, path, line_start, line_end, severity, message, code) are what a model said on PROMPT rules; of
    other rules and of files that aren't there they don't count. Findings alike in path, lines and message appear once.
    """
    spark = files.sparkSession
    rule_table(spark, rules, check)
    found = spark.sql("SELECT f.path, r.* FROM {files} f, LATERAL apply_rules(f.path, f.content) r", files=files.select("path", "content"))
    if verdicts is not None:
        prompts = rules.where("type = 'PROMPT'").select(F.col("id").alias("rule"), F.col("severity").alias("usual"), "title")
        said = verdicts.join(F.broadcast(prompts), "rule").join(files.select("path").distinct(), "path", "left_semi").where(F.trim(F.coalesce("message", F.lit(""))) != "")
        said = said.select("path", "rule", F.coalesce("line_start", F.lit(1)).cast("int").alias("line_start"), F.coalesce("line_end", "line_start", F.lit(1)).cast("int").alias("line_end"), F.coalesce("severity", "usual").alias("severity"), "message", "code", F.lit(None).cast("string").alias("match_id"))
        found = found.unionByName(said)
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    found = found.withColumn("weight", F.coalesce(F.try_element_at(weight, F.upper("severity")), F.lit(0)))
    # Of findings alike, the first by rule and place.
    by = ["path", "line_start", "line_end", "message"]
    rest = [c for c in found.columns if c not in by]
    return found.groupBy(*by).agg(F.min(F.struct(*rest)).alias("least_")).select(*by, "least_.*")


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """chunks (text and other columns) with embedding: embed is asked once for every different text, batch texts at a time.

    A wrong number of vectors, an empty one, one with a value that is no finite number, or one of another length than the
    others of its batch is an error. Null texts have no embedding.
    """
    if batch < 1:
        raise ValueError("batch must be positive")
    keyed = chunks.withColumn("_digest", F.sha2("text", 256))
    texts = keyed.where("text is not null").groupBy("_digest").agg(F.first("text").alias("text"))

    def ask(digests: list[str], given: list[str]) -> pa.RecordBatch:
        vectors = [[float(x) for x in v] for v in embed(given)]
        if len(vectors) != len(given):
            raise ValueError(f"{len(vectors)} embeddings for {len(given)} texts")
        if any(not v or len(v) != len(vectors[0]) or any(x != x or abs(x) == float("inf") for x in v) for v in vectors):
            raise ValueError("an embedding must be finite numbers, as many as any other's")
        return pa.RecordBatch.from_arrays([pa.array(digests), pa.array(vectors, pa.list_(pa.float64()))], names=["_digest", "embedding"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, given = [], []
        for rows in batches:
            for d, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                digests.append(d)
                given.append(t)
                if len(given) == batch:
                    yield ask(digests, given)
                    digests, given = [], []
        if given:
            yield ask(digests, given)

    return keyed.join(texts.mapInArrow(work, "_digest string, embedding array<double>"), "_digest", "left").drop("_digest")
