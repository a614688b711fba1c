"""Running sums that no hot key holds up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.sources.tables import rewritten


def running_sums(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """rows with the running sum of every column of sums, within equal values of by and in that order, each row's own included.

    Rows are dealt to ranges of (by, order) by Spark's sampled bounds, so a key of any size is many ranges' share; a
    range sums up what is in it, and the sums of the ranges before are added. Rows alike in by and order all get the
    sum of an order among them that is not stated.
    """
    taken = [f"v{i}_" for i in range(len(sums))]
    held = rows.withColumns(dict(zip(taken, sums.values(), strict=True)))
    dealt = held.repartitionByRange(*([ranges] if ranges else []), *by, *order).withColumn("range_", F.spark_partition_id())
    dealt = rewritten(dealt)
    # A row for each range that a key has rows in.
    totals = dealt.groupBy(*by, "range_").agg(*[F.sum(v).alias(v) for v in taken])
    before = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"{c}_of") for c in by], F.col("range_").alias("range_of"), *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"b{i}_") for i, v in enumerate(taken)])
    local = Window.partitionBy("range_", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("range_") == F.col("range_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    out = dealt.withColumns({f"l{i}_": F.sum(v).over(local) for i, v in enumerate(taken)}).join(offsets, same)
    return out.select(*rows.columns, *[(F.col(f"l{i}_") + F.col(f"b{i}_")).alias(name) for i, name in enumerate(sums)])
