"""Global positions in a sorted order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from murmurlens.runtime import stage

SAMPLE_POINTS = 800


def with_global_index(df: DataFrame, *order: str | Column) -> DataFrame:
    """Add ``index``, the 0-based place of each row in ``order`` (which must be total).

    Rows are range-partitioned and sorted, and written with their partition and place, so that
    later jobs agree on both; one count per partition then gives the offsets.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)))
    )
    placed = stage(placed, "placed")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("part")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    )
    return (
        placed.join(F.broadcast(offsets), "part")
        .withColumn("index", F.col("offset") + F.col("place"))
        .drop("part", "place", "offset")
    )


def systematic_sample(points: DataFrame, key: str = "post_id", wanted: int = SAMPLE_POINTS) -> DataFrame:
    """Every ``ceil(n / wanted)``-th row in key order, starting with the first."""
    indexed = with_global_index(points, key)
    step = max(1, -(-indexed.count() // wanted))
    return indexed.filter(F.col("index") % step == 0).drop("index")


def value_at_quantile(df: DataFrame, value: str, tie: str, quantile: float) -> float | None:
    """The value at place ``floor(quantile * (n - 1))`` of the sorted values. Exact."""
    indexed = with_global_index(df.select(value, tie), value, tie)
    place = int(quantile * (indexed.count() - 1))
    row = indexed.filter(F.col("index") == place).select(value).first()
    return None if row is None else row[0]
