"""Joins and first-row selection that hold up when one key carries a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HEAVY_KEYS = 10_000
MIN_HEAVY_ROWS = 200_000
MAX_BROADCAST_ROWS = 1_000_000


def heavy_keys(
    counts: DataFrame,
    key: str,
    count: str,
    max_keys: int = MAX_HEAVY_KEYS,
    min_rows: int = MIN_HEAVY_ROWS,
) -> DataFrame | None:
    """Keys that hold more than ``1/max_keys`` of all rows, with the number of salts each needs.

    At most ``max_keys`` keys can pass that test whatever the data, so the list is fetched once and
    is always small enough to broadcast. ``None`` when no key is that heavy. ``counts`` has one row
    per key.
    """
    seen = counts.agg(F.sum(count).alias("total"), F.max(count).alias("top")).first()
    if seen["total"] is None:
        return None
    share = max(-(-seen["total"] // max_keys), min_rows)
    if seen["top"] <= share:
        return None
    found = counts.filter((F.col(count) > share) & F.col(key).isNotNull()).select(
        key, F.ceil(F.col(count) / share).cast("int").alias("fan")
    )
    return counts.sparkSession.createDataFrame(found.collect(), found.schema)


def with_salt(df: DataFrame, key: str, heavy: DataFrame, spread: Column) -> DataFrame:
    """Add ``salt``: 0 for ordinary keys, ``hash(spread) mod fan`` for heavy ones. No shuffle."""
    salted = F.pmod(F.xxhash64(spread), F.col("fan")).cast("int")
    return (
        df.join(F.broadcast(heavy), key, "left")
        .withColumn("salt", F.coalesce(salted, F.lit(0)))
        .drop("fan")
    )


def with_fan(df: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """Repeat the rows of heavy keys once per salt; ordinary rows stay single. No shuffle."""
    return (
        df.join(F.broadcast(heavy), key, "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("fan", F.lit(1)) - 1)))
        .drop("fan")
    )


def spread_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread: str,
    how: str = "inner",
    max_keys: int = MAX_HEAVY_KEYS,
    min_rows: int = MIN_HEAVY_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Equi-join where ``left`` may be skewed on ``key`` (inner, left, left_semi, left_anti).

    Rows of a heavy key are dealt over several tasks by ``spread``; only the few matching rows of
    ``right`` are repeated. Without heavy keys this is the plain join. ``rows`` is the size of
    ``left`` where known; too few rows to make a heavy key save the count per key.
    """
    if rows is not None and rows <= min_rows:
        return left.join(right, key, how)
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("rows_per_key"))
    heavy = heavy_keys(counts, key, "rows_per_key", max_keys, min_rows)
    if heavy is None:
        return left.join(right, key, how)
    return (
        with_salt(left, key, heavy, F.col(spread))
        .join(with_fan(right, key, heavy), [key, "salt"], how)
        .drop("salt")
    )


def first_wins(df: DataFrame, key: str, position: str, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Keep, for every ``key``, the row with the smallest ``position`` (unique over ``df``). Rows
    without a key repeat nothing and are all kept.

    Only (key, position) is aggregated, with map-side combine, so a key repeated billions of times
    costs one row per task. Full rows are not shuffled when the list of repeated keys is short;
    otherwise they are matched on ``position``, which is unique and therefore even.
    Call it on a stored table: the narrow columns are read twice.
    """
    firsts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(position).alias("first_position"), F.count(F.lit(1)).alias("copies")
    )
    repeated = firsts.filter("copies > 1").select(key, "first_position")
    if repeated.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        return (
            df.join(F.broadcast(repeated), key, "left")
            .filter(F.col("first_position").isNull() | (F.col("first_position") == F.col(position)))
            .drop("first_position")
        )
    keep = firsts.select(F.col("first_position").alias(position))
    return df.join(keep, position, "left_semi").unionByName(df.filter(F.col(key).isNull()))
