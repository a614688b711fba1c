"""Loading of the parquet tables of a folder, and rewriting of intermediate ones."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that all executors share (a local one where none is named, as in tests), deleted when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{(shared or '/tmp/checkpoints/quillmine').rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def rewritten(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes the rows to the folder that all executors share and reads them again."""
    path = fresh_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
