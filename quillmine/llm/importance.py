"""Importance resampling towards a target distribution, by hashed word n-grams.

Every chunk of documents maps its different words to integer ids; n-grams are tuples of ids, a tuple being the
number of its first words' tuple and one more word. Each different tuple's bytes are hashed once (the hash of
the first words is carried on over the last), and the buckets are joined back to the documents. Buckets are
counted over all texts of both sides; a bucket's gain is the log ratio of its shares, a document's weight the
mean gain, and the documents with the highest weight plus Gumbel noise, a function of the id, are drawn.

Defined cases: a null or empty text has no features, weight 0 and, if least_words is above 0, no part in the
draw; texts of any length are taken whole; equal and null ids (noise as for an empty id, ranked last among
ties) are rows of their own; an empty table gives no rows; an empty target gives gains that grow with a
bucket's rarity; other columns are ignored by weigh() and draw() and carried by resample().
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.llm.common import mapped, materialize, power_of_two, unused

BUCKETS = 10_000
ORDERS = 2
PERCENT = 25
LEAST_WORDS = 20
SEED = 7
#: Rows that one range of the draw's order holds on average, at most.
RANGE_ROWS = 50_000
#: ASCII but letters and digits parts words; A-Z are lower-cased.
_PARTS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_PARTS).split() if text else []


def hashed(texts: list[str | None], orders: int = ORDERS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, features, buckets): the numbers of words and features of each text, and its features' buckets, text by text."""
    cut = [words(t) for t in texts]
    n = np.array([len(c) for c in cut], np.int64)
    coded = pa.array([w for c in cut for w in c], pa.binary()).dictionary_encode()
    spelt, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    follows = [b" " + w for w in spelt]
    per = np.array([np.maximum(n - k, 0) for k in range(orders)], np.int64).reshape(orders, len(n))
    features = per.sum(0)
    start = np.cumsum(features) - features
    out = np.zeros(int(features.sum()), np.int64)
    first_word = np.cumsum(n) - n
    for k in range(orders):
        # Where each n-gram of this order begins, document by document.
        of = np.repeat(np.arange(len(n)), per[k])
        nth = np.arange(len(of)) - np.repeat(np.cumsum(per[k]) - per[k], per[k])
        begin = first_word[of] + nth
        if k == 0:
            tuples, crcs = ids, [zlib.crc32(w) for w in spelt]
        else:
            # A tuple: that of its first words, found at the same place one order before, and its last word.
            known, inverse = np.unique(tuples[begin] * max(1, len(spelt)) + ids[begin + k], return_inverse=True)
            before, last = np.divmod(known, max(1, len(spelt)))
            crcs = [zlib.crc32(follows[w], crcs[p]) for p, w in zip(before.tolist(), last.tolist(), strict=True)]
            tuples = np.zeros(len(ids), np.int64)
            tuples[begin] = inverse
        found = np.array(crcs, np.int64) % buckets
        out[start[of] + per[:k, of].sum(0) + nth] = found[tuples[begin]]
    return n, features, out


def features(docs: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, key, n_words, n_features, buckets): a hash of the text, and the buckets of all features as little-endian numbers of 16 bits, 32 where there are more than 65,536."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sizes, found = hashed(batch.column(1).to_pylist(), orders, buckets)
            data, width = found.astype(kind).tobytes(), kind.itemsize
            ends = (np.cumsum(sizes) * width).tolist()
            parts = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(sizes), pa.array(parts, pa.binary())], names=["doc_id", "key", "n_words", "n_features", "buckets"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    return mapped(rows, work, "doc_id long, key long, n_words long, n_features long, buckets binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all rows of features(); a task passes on a row per bucket at most."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_py(), kind), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    return mapped(found.select("buckets"), work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, from the counts (bucket, n) of both sides; both have a row per bucket at most."""
    sides = source.select("bucket", F.col("n").alias("s")).join(target.select("bucket", F.col("n").alias("t")), "bucket", "full")
    every = target.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(sides, "bucket", "left")
    zero = F.lit(0).cast("long")
    totals = every.agg(F.coalesce(F.sum("s"), zero).alias("all_s"), F.coalesce(F.sum("t"), zero).alias("all_t"))
    s, t = (F.coalesce(c, zero).cast("double") for c in ("s", "t"))
    ratio = ((t + 1) * (F.col("all_s").cast("double") + buckets)) / ((s + 1) * (F.col("all_t").cast("double") + buckets))
    # One row of totals.
    return every.crossJoin(F.broadcast(totals)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, a function of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weigh(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, key (a hash of its text), n_words, n_features, weight, score; target has the column text."""
    found = materialize(features(docs, orders, buckets), "importance-features")
    wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), orders, buckets)
    # BUCKETS rows, whatever the corpus.
    rows = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets), buckets).collect()
    gain = np.zeros(buckets, np.int64)
    gain[[r["bucket"] for r in rows]] = [r["gain"] for r in rows]
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mean = [int(gain[np.frombuffer(x.as_py(), kind)].sum()) // max(1, len(x.as_py()) // kind.itemsize) for x in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(mean, pa.int64())], names=["doc_id", "key", "n_words", "n_features", "weight"])

    weighed = mapped(found, work, "doc_id long, key long, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds rank: 1, 2, 3... for the highest scores of the documents with least_words words, null for those not drawn.

    Rows are dealt to ranges of (score, doc_id), numbered there, and the ranges' sizes give the numbers before.
    """
    rows = materialize(weighed, "importance-weights")
    able = rows.where(F.col("n_words") >= least_words)
    n = able.count()
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    dealt = materialize(able.repartitionByRange(power_of_two(n / RANGE_ROWS, 8), *order).withColumn("range", F.spark_partition_id()), "importance-ranges")
    sizes = {r["range"]: r["n"] for r in dealt.groupBy("range").agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for r in sorted(sizes):
        starts.append((r, before))
        before += sizes[r]
    # One row per range.
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "range int, before long"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order, "key")) + F.col("before")
    ranked = dealt.join(offsets, "range").withColumn("rank", place)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= n * percent // 100, F.col("rank")).cast("long")).drop("range", "before")
    return ranked.unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents drawn, with all their columns; of rows alike in id and text any ones, if only some are drawn."""
    key = unused(docs, "x_")
    ranked = draw(weigh(docs, target), percent, least_words)
    per = materialize(ranked.groupBy("doc_id", "key").agg(F.count("rank").alias("taken"), F.count("*").alias("rows")).where("taken > 0"), "importance-drawn")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("w.doc_id")) & (F.col(f"d.{key}") == F.col("w.key"))
    out = keyed.alias("d").join(per.where("taken = rows").alias("w"), same, "left_semi")
    # Rows alike stand together in the draw's order, so its end cuts one such group at most.
    for r in per.where("taken < rows").collect():
        out = out.unionByName(keyed.where(F.col("doc_id").cast("long").eqNullSafe(F.lit(r["doc_id"])) & (F.col(key) == r["key"])).limit(r["taken"]))
    return out.drop(key)


#: DuckDB SQL for the query op12_importance: the checksum is computed from its polynomial, byte by byte.
SQL = r"""
WITH RECURSIVE crc_steps AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS v FROM crc_steps WHERE k = 8),
texts AS (
  SELECT row_number() OVER () AS r, 0 AS side, doc_id, text FROM documents
  UNION ALL SELECT row_number() OVER (), 1, NULL, text FROM benchmark),
worded AS (
  SELECT r, side, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM texts),
grams AS (
  SELECT r, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM worded),
counted AS (SELECT r, side, g, count(*) AS n FROM grams GROUP BY ALL),
spelt AS (SELECT g, hex(encode(g)) AS h FROM counted GROUP BY g),
hashed AS (
  SELECT g, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT),
                            lambda c, b: xor(c >> 8, v[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM spelt, crc_table),
bucketed AS (SELECT r, side, bucket, sum(n) AS n FROM counted JOIN hashed USING (g) GROUP BY ALL),
per AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM bucketed GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM per),
gain AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln(((t::DOUBLE + 1) * (ss::DOUBLE + 10000)) / ((s::DOUBLE + 1) * (tt::DOUBLE + 10000)))) AS gain
  FROM per, totals),
weights AS (SELECT r, sum(n) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM bucketed JOIN gain USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (
  SELECT w.doc_id, len(w.w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || sha256('7:' || coalesce(w.doc_id::VARCHAR, ''))[1:8])::BIGINT::DOUBLE + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM worded w LEFT JOIN weights USING (r) WHERE w.side = 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
         count(*) FILTER (n_words >= 20) OVER () AS able
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * able // 100 THEN place END AS rank FROM ordered
"""
