"""What the operators of this folder share: table access, shared storage, connected components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Bounds of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20


def prepare(spark: SparkSession) -> None:
    """Arrow batches of the session end at BATCH_BYTES or BATCH_ROWS, whichever comes first; a longer row is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(df: DataFrame, f, schema: StructType | str) -> DataFrame:
    """df.mapInArrow() with bounded batches."""
    prepare(df.sparkSession)
    return df.mapInArrow(f, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one (tests) gets a local one, a cluster none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "/tmp/checkpoints/quillmine"


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    where, system = _hadoop(spark, path)
    system.deleteOnExit(where)
    return path


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Cuts lineage: writes the rows to the shared folder, with options of the writer, and reads them again, so that a lost executor loses nothing."""
    spark = df.sparkSession
    prepare(spark)
    path = fresh_path(spark, tag)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """What runs within leaves no shuffle files, so that steps that write and read again don't pile them up."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(df: DataFrame) -> None:
    """Deletes the files of a frame that materialize() made and nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where, system = _hadoop(df.sparkSession, path)
        system.delete(where, True)


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as no column of df has (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def power_of_two(least: float, floor: int = 1) -> int:
    n = floor
    while n < least:
        n *= 2
    return n


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), component being the least node.

    Alternates large-star and small-star steps; every step is a grouped minimum with
    map-side combine and a join back on the node, so a hub of any degree is split by
    adaptive skew joins. Rows without an edge don't appear; null ends and loops are ignored.
    """
    spark = edges.sparkSession
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, tag)
    last = None
    while True:
        both = e.union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, tag)
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == last:
            break
        last = state
    hubs = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(hubs.select("node", F.col("node").alias("component")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
