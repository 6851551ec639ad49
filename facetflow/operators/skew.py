"""Joins of many rows with one row a key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 100_000  # at most so many keys are split, so the table of them may be broadcast


def parts_of(sizes: DataFrame, key: str, size: str, least: int) -> DataFrame | None:
    """(key, parts) of the hot keys of sizes (key, size): those of more than `least` rows and more than the HOT_KEYS-th part of all, fewer than HOT_KEYS by arithmetic. None if no key is hot."""
    total, most = sizes.agg(F.sum(size), F.max(size)).first()
    limit = max(least, -(-(total or 0) // HOT_KEYS))
    if (most or 0) <= limit:
        return None
    return F.broadcast(sizes.where(F.col(size) > limit).select(key, F.ceil(F.col(size) / limit).cast("int").alias("parts")))


def dealt(rows: DataFrame, hot: DataFrame | None, key: str, by: str) -> DataFrame:
    """rows with `part`: those of a hot key are dealt out by a hash of column `by`."""
    if hot is None:
        return rows.withColumn("part", F.lit(0))
    return rows.join(hot, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(by), F.col("parts")).cast("int"), F.lit(0))).drop("parts")


def copied(rows: DataFrame, hot: DataFrame | None, key: str) -> DataFrame:
    """rows with `part`, once for each part of a hot key."""
    if hot is None:
        return rows.withColumn("part", F.lit(0))
    return rows.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def met(rows: DataFrame, single: DataFrame, hot: DataFrame | None, key: str, by: str) -> DataFrame:
    """The inner join of rows with single (one row a key), hot keys in parts."""
    if hot is None:
        return rows.join(single, key)
    return dealt(rows, hot, key, by).join(copied(single, hot, key), [key, "part"]).drop("part")
