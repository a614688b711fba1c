"""Document fingerprints: bottom-k sketches of shingle hashes, by DataFrame functions only.

A sketch is the k smallest distinct hashes of a text's shingles of five words, ascending. Sketches of
parts merge to the sketch of the whole, and estimate resemblance, containment and distinct shingles.

Defined cases: a null text is empty; a text of fewer than five words is one shingle of all its words, and
one without words is the shingle of no words; equal texts have equal sketches; rows that share a doc_id
follow each other by text hash, null ids come first (rows alike in both are alike in every result); an
empty table gives no rows; a single document's next document is itself; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.llm.common import power_of_two

K = 128
SHINGLE = 5
#: Rows of a range of neighbouring ids on average.
RANGE_ROWS = 4096
#: Ranges at least and at most; beyond, ranges hold more rows.
LEAST_RANGES, MAX_RANGES = 64, 1 << 17
#: Quantiles of doc_id that bound the ranges; each is split evenly where more ranges are needed.
QUANTILES = 512


def _sketched(df: DataFrame, text: str, out: str, k: int, shingle: int) -> DataFrame:
    """Adds out: the sketch of text. One column per step, so that no step is evaluated twice."""
    words = F.expr(rf"filter(split({text}, '[\\x20\\x09-\\x0D]+', -1), w -> w <> '')")
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    last = F.greatest(F.size("_h") - (shingle - 1), F.lit(1))
    grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("_h", i, shingle)))
    return df.withColumn(out, F.slice(F.array_sort(F.array_distinct(grams)), 1, k)).drop("_h")


def sketch(df: DataFrame, text: str = "text", out: str = "sketch", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    return _sketched(df.withColumn("_x", F.coalesce(F.col(text), F.lit(""))), "_x", out, k, shingle).drop("_x")


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, by: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per group; every task passes on at most k hashes of a group."""
    rows = df.select(*by, F.explode(sketch).alias("h")).distinct()
    least = rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("n") <= k)
    return least.groupBy(*by).agg(F.array_sort(F.collect_list("h")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's k least hashes that both sketches hold."""
    whole = merge(a, b, k)
    return F.size(F.array_intersect(F.array_intersect(whole, a), b)).cast("double") / F.greatest(F.size(whole), F.lit(1))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k, else (k - 1) over the k-th hash's place in the range of hashes."""
    place = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of the first's shingles that the second holds, from resemblance and the two counts."""
    j, n, m = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.least(F.lit(1.0), j / (1 + j) * (n + m) / n)


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _bounds(ids: DataFrame) -> tuple[list[int], list[int], int]:
    """Bounds of the doc_id ranges, the number of tie ranges of each, and that of the null ids.

    The bounds are quantiles; one that stands for several quantiles is a hot id, whose rows are split by their tie.
    """
    facts = ids.agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("none"), F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)], 10_000).alias("q")).first()
    times = Counter(facts["q"] or [0])
    wanted = min(MAX_RANGES, power_of_two(facts["n"] / RANGE_ROWS, LEAST_RANGES))
    per = max(1, wanted // QUANTILES)
    return sorted(times), [per * times[b] for b in sorted(times)], max(1, round(wanted * facts["none"] / max(1, facts["n"])))


def _ranged(rows: DataFrame, bounds: list[int], parts: list[int], none: int) -> DataFrame:
    """Adds r_: the number of the row's range in the order of (doc_id, tie), nulls first."""

    def find(a: int, b: int) -> Column:
        """Position among the bounds, by binary search over literals."""
        if b - a == 1:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(F.col("doc_id") >= bounds[m], find(m, b)).otherwise(find(a, m))

    place = (F.col("tie_").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    slot = lambda share, n: F.greatest(F.lit(0), F.least(n - 1, F.floor(share * n))).cast("long")
    rows = rows.withColumn("q_", find(0, len(bounds)) + 1)  # a column of its own, so that it is computed once
    at = F.col("q_")
    widths = [max(1, b - a) for a, b in zip(bounds, bounds[1:] + [bounds[-1] + 1], strict=True)]
    # Ranges of a bound: its own id, split by tie, then the ids above it up to the next bound.
    first = [none + 2 * sum(parts[:i]) for i in range(len(bounds))]
    low, width, n, base = (F.element_at(F.lit(x), at) for x in (bounds, widths, parts, first))
    inner = F.when(F.col("doc_id") <= low, slot(place, n)).otherwise(n + slot((F.col("doc_id") - low) / width, n))
    return rows.withColumn("r_", F.when(F.col("doc_id").isNull(), slot(place, F.lit(none))).otherwise(base + inner)).drop("q_")


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the document with the next id, after the last that of the first.

    A pass over the ids finds the first row of every range; then texts move once, to their range, which also
    gets a copy of the first row of the range after it. There are at most MAX_RANGES ranges, so that the
    table of firsts that is broadcast has at most as many rows; ranges grow beyond.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("tie_", F.xxhash64("text"))
    rows = _ranged(base, *_bounds(base.select("doc_id")))
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie_")
    order = Window.orderBy("r_")
    # One row per range, so one task holds at most MAX_RANGES rows.
    firsts = rows.groupBy("r_").agg(F.min(key).alias("f")).select(
        F.coalesce(F.lag("r_").over(order), F.max("r_").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to_"), F.col("r_").alias("from_"), F.col("f.doc_id").alias("id_"), F.col("f.tie_").alias("t_")
    )
    found = rows.join(F.broadcast(firsts), (F.col("r_") == F.col("from_")) & F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("tie_") == F.col("t_")), "left")
    mine = F.struct(F.col("r_").alias("to"), F.lit(False).alias("head"))
    head = F.struct(F.col("to_").alias("to"), F.lit(True).alias("head"))
    both = found.select("doc_id", "text", "tie_", F.explode(F.when(F.col("to_").isNull(), F.array(mine)).otherwise(F.array(mine, head))).alias("p_"))
    both = both.select("doc_id", "text", "tie_", F.col("p_.to").alias("r_"), F.col("p_.head").alias("head_"))
    within = Window.partitionBy("r_").orderBy("head_", F.col("doc_id").asc_nulls_first(), "tie_")
    return both.withColumn("next_text", F.lead("text").over(within)).where("not head_").select("doc_id", "text", "next_text")


def compare_edited(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Each document's sketch beside those of its edited text and of the next document.

    near_edited and near_next are resemblances; contained_edited is the part of the document's shingles that
    its edited text holds, n_distinct the estimate of its distinct shingles.
    """
    rows = neighbours(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = (F.col("n_chars") - half).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), kept), F.substring("next_text", F.lit(1), half)))
    for text, out in (("text", "sketch"), ("edited", "edited_sketch"), ("next_text", "next_sketch")):
        rows = _sketched(rows, text, out, k, shingle)
    a, b = F.col("sketch"), F.col("edited_sketch")
    rows = rows.withColumn("near_edited", resemblance(a, b, k)).withColumn("near_next", resemblance(a, F.col("next_sketch"), k))
    return rows.withColumn("contained_edited", containment(a, b, k)).withColumn("n_distinct", distinct_shingles(a, k))
