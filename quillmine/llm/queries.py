"""The queries of this folder's operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.llm import alignment, fingerprints, importance, language, media, mixing, packing, pii, sharding, simhash, substrings, toxicity, warc
from quillmine.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL["op4_mixing"] = mixing.SQL


@_query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@_query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest_rows(warc.captures(table(spark, sf_dir, "pages"), payload=False))


ORACLE_SQL["op8_warc"] = warc.SQL


@_query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.compare_edited(table(spark, sf_dir, "documents"))
    sketches = [fingerprints.as_text(F.col("sketch")).alias("fingerprint"), fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint")]
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *sketches, "near_edited", "near_next", "contained_edited", "n_distinct")


@_query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@_query
def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL["op9_substrings"] = substrings.SQL


@_query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pii.find(docs, pii.fit(docs))
    base = F.filter("pii_spans", lambda s: s["base"])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(spans, kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    kinds = [count(base, k) for k in pii.KINDS]
    added = [count("pii_spans", k) for k in pii.ADDED]
    added.append(F.size("pii_spans").cast("long").alias("n_found"))
    return rows.select("doc_id", *kinds, *added, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("pii_spans")).alias("spans"))


@_query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = language.classify(docs.select("doc_id", "text"), language.fit(docs))
    return rows.select("doc_id", (language.fold(F.col("doc_id")) == language.HELD_OUT).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"], rounds=toxicity.ROUNDS)
    held = (toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT).alias("held_out")
    return rows.select("doc_id", held, F.col("toxic_score").alias("score"), (F.col("toxic_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@_query
def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited copies of every 20th vector's image, searched among the images of all."""
    vectors = table(spark, sf_dir, "embeddings")
    return media.copies(media.render(vectors.where("vec_id % 20 = 0"), edited=True), media.render(vectors))


@_query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


@_query
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = importance.weigh(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return importance.draw(weighed).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE_SQL["op12_importance"] = importance.SQL


@_query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.manifest(table(spark, sf_dir, "documents"))
    law = [F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")]
    return rows.select("doc_id", "size", "text_crc32", *law, "shard", "slot", "virtual_slot", "map_version")
