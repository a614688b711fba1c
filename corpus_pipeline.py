"""A training corpus from raw documents: toxicity, near duplicates, personal data, mixing, packing.

Every stage gets what its predecessor kept, as Parquet reread; all but the last return the columns of
documents. Rows with null ids stay, and of those with null texts or texts without words one, until mixing,
where texts without words are taken zero times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.llm import mixing, packing, pii, simhash, toxicity
from quillmine.llm.common import materialize, table, unused


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score as toxic; those without words, and all if labels tell no two classes, stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    if model.weights is None:
        return docs
    score = unused(docs, "toxic_score")
    wordless = F.col("text").isNull() | ~F.col("text").rlike(r"(?U)\w")
    return toxicity.score(docs, model, score).where((F.col(score) < toxicity.THRESHOLD) | wordless).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the least id of every group of near duplicates."""
    return simhash.near_dedup(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the names of its kinds."""
    spans, clean = unused(docs, "pii_spans"), unused(docs, "pii_redacted")
    found = pii.find(docs, pii.fit(docs), spans, clean).withColumn("text", F.col(clean))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return found.select(*[f"`{c}`" for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes of every source what its target weight asks for."""
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mixed texts into windows of tokens; the rows hold the token ids."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("pii", personal_data), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Scores, spans and tokens are not SQL's to express.
ORACLE_SQL = None
