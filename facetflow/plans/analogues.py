"""Stand-ins for pixels, faces and frames: the provided tables read as such, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as pixels (mesh, view, f, raw, nx, ny, nz): a fifth of them is noise, some have no label or no face."""
    f = (F.col("l_partkey") % 200).cast("int")
    raw = F.when(F.col("l_quantity") == 50, 0).when(F.col("l_discount") > 0.08, 1 + F.col("l_suppkey") % 8).otherwise(1 + F.expr("(l_partkey % 200 + l_linenumber) div 25"))
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 3).cast("int").alias("mesh"), F.col("l_linenumber").alias("view"), F.when(F.col("l_quantity") == 49, -1).otherwise(f).alias("f"), raw.cast("int").alias("raw"),
        (F.col("l_discount") - 0.05).alias("nx"), (F.col("l_tax") - 0.04).alias("ny"), F.lit(0.1).alias("nz"),
    )


PIXELS_SQL = """px AS (SELECT (l_orderkey % 3)::INT AS mesh, l_linenumber AS view, CASE WHEN l_quantity = 49 THEN -1 ELSE (l_partkey % 200)::INT END AS f,
  (CASE WHEN l_quantity = 50 THEN 0 WHEN l_discount > 0.08 THEN 1 + l_suppkey % 8 ELSE 1 + (l_partkey % 200 + l_linenumber) // 25 END)::INT AS raw,
  l_discount - 0.05 AS nx, l_tax - 0.04 AS ny, 0.1 AS nz FROM lineitem)"""


def poses(spark: SparkSession) -> DataFrame:
    """One pose a view, 1 to 7."""
    v = F.col("id").cast("double")
    return spark.range(1, 8).select(F.col("id").cast("int").alias("view"), F.array(*[F.lit(0.0)] * 2, v / 10, *[F.lit(0.0)] * 3, 1 - v / 10, *[F.lit(0.0)] * 3, F.lit(0.5), *[F.lit(0.0)] * 4, F.lit(1.0)).alias("pose"))


#: The third column of poses(), applied to a normal.
FACING_SQL = "abs(nx * (view / 10.0::DOUBLE) + ny * (1 - view / 10.0::DOUBLE) + nz * 0.5) > 0.05"


def numbered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Numbers of made images and meshes, four suppliers each, so that they grow with the tables; three on the smallest.

    Dealt out to a fixed number of partitions, as far more rows are made of them than there are numbers."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf_dir, "supplier").select(F.expr("cast(s_suppkey div 4 as int)").alias(name)).repartition(parts, name).distinct()


def each(rows: DataFrame, name: str, first: int, last: int) -> DataFrame:
    """rows once for each number from first to last. A join, as the planner takes what explode makes for as small as the rows before it, and would broadcast tables of any size that are made of it."""
    return rows.crossJoin(F.broadcast(rows.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias(name))))


#: The same numbers.
NUMBERS_SQL = "(SELECT DISTINCT (s_suppkey // 4)::INT FROM supplier)"
