"""Language identification by compression.

Each language has a zstandard raw-content dictionary of its training texts. A text is compressed, in
chunks, with every dictionary; the language of the smallest total is chosen, and rejected where the
runner-up is hardly larger.

Defined cases: a null text or one without a letter is `und` with score 0, as is any text where no language
was learned; a tie goes to the language that sorts first; very long texts are compressed whole, chunk by
chunk; repeated rows are judged each; an empty table gives no rows; other columns pass through, those of the results' names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from quillmine.llm.common import mapped, materialize

FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"
#: The fit takes, of each language, at most so many documents (of the least hashes) and so many bytes.
FIT_DOCUMENTS, FIT_BYTES = 256, 112 << 10
#: Ranges of hashes in which the documents of a language are ranked first.
SPLITS = 64
BROADCAST_ROWS = 200_000
CHUNK = 2048
LEVEL = 3
#: A choice is rejected if the runner-up is larger by less than this part.
MARGIN = 0.01
#: Relative difference of sizes that counts as one unit of evidence.
UNIT = 0.02


def fold(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS).cast("int")


def fit(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary content per language, from the documents outside the held-out fold.

    Hashes are ranked without texts; a group of one language in one range of hashes sends on at most
    FIT_DOCUMENTS of them. Only the texts chosen, FIT_BYTES of each at most, reach the driver.
    """
    rows = docs.where("lang is not null and text is not null").where(fold(F.col("doc_id")) != HELD_OUT).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    ids = rows.select("lang", "h", F.pmod("h", F.lit(SPLITS)).alias("s"))
    order = Window.partitionBy("lang", "s").orderBy("h")
    ids = ids.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= FIT_DOCUMENTS)
    ids = ids.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= FIT_DOCUMENTS).select("lang", "h", "n")
    ids = materialize(ids, "language-fit")
    # At most FIT_DOCUMENTS rows of each language; broadcast unless there are very many languages.
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    chosen = rows.join(ids, ["lang", "h"]).select("lang", "n", F.expr(f"substring(text, 1, {FIT_BYTES})").alias("text"))
    chosen = chosen.dropDuplicates(["lang", "n"]).withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    found: dict[str, list[bytes]] = {}
    for r in sorted(chosen.where(F.col("before") < FIT_BYTES).collect(), key=lambda r: (r["lang"], r["n"])):
        found.setdefault(r["lang"], []).append(r["text"].encode("utf-8", "surrogatepass"))
    return {lang: b"\n".join(parts)[:FIT_BYTES] for lang, parts in found.items()}


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        self.langs = sorted(content)
        self.coders = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the choice stands."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        raw = text.encode("utf-8", "surrogatepass")
        parts = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
        sizes = np.array([sum(len(c.compress(p)) for p in parts) for c in self.coders], float)
        best = int(sizes.argmin())
        share = np.exp(-(sizes - sizes[best]) / (UNIT * sizes[best]))
        rest = np.delete(sizes, best)
        stands = not len(rest) or rest.min() >= sizes[best] * (1 + MARGIN)
        return self.langs[best], float(1 / share.sum()), bool(stands)


def classify(docs: DataFrame, content: dict[str, bytes]) -> DataFrame:
    """The documents with lang_pred, score and accepted (false where the margin is narrow or the text is `und`)."""
    docs = docs.drop("lang_pred", "lang_score", "lang_accepted")
    shipped = docs.sparkSession.sparkContext.broadcast(content)
    at = docs.columns.index("text")
    kinds = [("lang_pred", StringType()), ("lang_score", DoubleType()), ("lang_accepted", BooleanType())]
    schema = StructType([*docs.schema.fields, *[StructField(n, k) for n, k in kinds]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose = Classifier(shipped.value)
        for batch in batches:
            found = [choose(t.as_py()) for t in batch.column(at)]
            new = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *[n for n, _ in kinds]])

    return mapped(docs, run, schema)
