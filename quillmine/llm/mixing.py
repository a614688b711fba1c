"""Mixing sources to target weights.

Every document gets a hash-random key; within a source the keys are dealt to ranges, sorted there, and
prefix sums of the range totals turn the local running sums into running sums of the whole source. A
source is cut at its exact budget; a budget beyond the source's size repeats whole epochs first.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own
and comes last; repeated rows count each; ties of the key are ordered by doc_id, then by text digest;
an empty table gives no rows; other columns are ignored by mix() and carried by apply_mix().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from quillmine.llm.common import WORD, materialize, power_of_two, unused

#: Weights of the sources in code-point order, repeated as often as needed.
WEIGHTS = (1, 2, 3)
#: A source is taken at most so many times.
MAX_EPOCHS = 3
#: Rows that one key range of a source holds on average, at most.
RANGE_ROWS = 50_000
#: Ranges per source at least; keys are uniform, so ranges are even whatever the source's share.
LEAST_RANGES = 256


def sized(docs: DataFrame) -> DataFrame:
    """Adds size (words of the text) and the hash-random key k."""
    return docs.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.concat_ws("/", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long").alias("k"),
        F.xxhash64("text").alias("tie"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target): budgets of each source by capped proportional shares.

    A cap binds where cap / weight is at most the level that the uncapped sources share; in the order of
    that ratio the level is known from running sums, so no iteration is needed. One row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    by = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before, after, whole = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    per = per.withColumn("free", F.col("cap") / F.col("weight") > F.col("level"))
    # The first free source in that order sets the level of all free ones.
    first = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * first), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted)."""
    rows = materialize(sized(docs), "mix-sizes")
    ranges = power_of_two(rows.count() / RANGE_ROWS, LEAST_RANGES)
    rows = rows.withColumn("r", (F.col("k") / F.lit((1 << 48) // ranges)).cast("int"))
    goal = targets(rows, weights, max_epochs)
    local = Window.partitionBy("source", "r").orderBy("k", F.col("doc_id").asc_nulls_last(), "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(local), F.lit(0)))
    totals = rows.groupBy("source", "r").agg(F.sum("size").alias("n"))
    offset = totals.select("source", "r", (F.sum("n").over(Window.partitionBy("source").orderBy("r")) - F.col("n")).alias("offset"))
    plan = offset.alias("o").join(goal.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source"))).select("o.source", "r", "offset", "source_size", "target")
    joined = rows.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.r") == F.col("p.r")))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("offset")))
    return joined.select("doc_id", "d.source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), "k", "tie")


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, the one at a budget's cut with its first words only.

    Columns are those of docs; n_chars, if there, is that of the text returned. Documents of size 0 go.
    """
    chosen = mix(docs, weights, max_epochs).where("taken > 0")
    # Repeated rows of one id, source and text share a key: their counts are added up and dealt out evenly among them.
    chosen = chosen.groupBy("doc_id", "source", "tie").agg(F.max("size").alias("size"), F.sum("taken").alias("taken")).alias("c")
    x_, n_, of_, texts_, one_, left_ = (unused(docs, n) for n in ("x_", "n_", "of_", "texts_", "one_", "left_"))
    out = docs.withColumn(x_, F.xxhash64("text")).alias("d").join(
        chosen, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col(f"d.{x_}") == F.col("c.tie"))
    )
    out = out.select("d.*", F.col("c.size").alias(of_), F.col("c.taken").alias(n_))
    same = Window.partitionBy("doc_id", "source", x_)
    # Rows alike in these are ordered by all their columns, so that reruns agree.
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    nth, rows = F.row_number().over(same.orderBy(F.xxhash64(*hashed))) - 1, F.count(F.lit(1)).over(same)
    mine = F.floor(F.col(n_) / rows) + F.when(nth < F.col(n_) % rows, 1).otherwise(0)
    out = out.withColumn(left_, mine.cast("long"))
    copies = F.floor(F.col(left_) / F.col(of_)).cast("int")
    left = (F.col(left_) - copies * F.col(of_)).cast("int")
    words = F.expr(r"regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0)")
    cut = F.array_join(F.slice(words, 1, F.greatest(left, F.lit(1))), "")
    out = out.withColumn(texts_, F.concat(F.array_repeat(F.col("text"), copies), F.when(left > 0, F.array(cut)).otherwise(F.array().cast("array<string>"))))
    out = out.withColumn(one_, F.explode(texts_))
    value = {"text": F.col(one_), "n_chars": F.length(one_).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*[value[c].alias(c) if c in value else F.col(f"`{c}`") for c in docs.columns])


#: DuckDB SQL for the query op4_mixing.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight
  FROM d GROUP BY source),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c),
f AS (SELECT arg_min(level, (cap / weight, source)) AS level FROM l WHERE cap / weight > level),
t AS (
  SELECT l.source, source_size, coalesce(least(cap, weight * f.level), cap) AS target,
         CAST(floor(coalesce(least(cap, weight * f.level), cap) + 0.5) AS BIGINT) AS budget
  FROM l, f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.budget,
         CASE WHEN t.source_size > 0 THEN t.budget // t.source_size ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM p
"""
