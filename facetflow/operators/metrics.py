"""Agreement of two labellings of the same faces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contingency(labels: DataFrame, by=("mesh",)) -> DataFrame:
    """(by, est, ref, n) for labels (by, est, ref), one row a face."""
    return labels.groupBy(*by, "est", "ref").agg(F.count("*").alias("n"))


def margins(labels: DataFrame, by=("mesh",)) -> DataFrame:
    """(by, est, ref, level, n): cells (level 0), sums by est (1) and by ref (2), and all (3), in one pass."""
    keys = [F.col(c) for c in (*by, "est", "ref")]
    sets = [[*by, "est", "ref"], [*by, "est"], [*by, "ref"], list(by)]
    level = F.grouping("est") * 2 + F.grouping("ref")
    grouped = labels.groupingSets([[F.col(c) for c in s] for s in sets], *keys)
    return grouped.agg(level.cast("int").alias("mask"), F.count("*").alias("n")).select(*by, "est", "ref", F.when(F.col("mask") == 0, 0).when(F.col("mask") == 1, 1).when(F.col("mask") == 2, 2).otherwise(3).alias("level"), "n")


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def agreement(labels: DataFrame, by=("mesh",)) -> DataFrame:
    """(by, n, hamming_rm, hamming_rf, hamming, inverse_rand, gce, lce): region errors, 1 - Rand index, global and local consistency errors."""
    cells = contingency(labels, by)
    est = cells.groupBy(*by, "est").agg(F.sum("n").alias("e"), F.max("n").alias("e_max"))
    ref = cells.groupBy(*by, "ref").agg(F.sum("n").alias("r"), F.max("n").alias("r_max"))
    own = cells.join(est, [*by, "est"]).join(ref, [*by, "ref"])
    e1, e2 = F.col("n") * (F.col("e") - F.col("n")) / F.col("e"), F.col("n") * (F.col("r") - F.col("n")) / F.col("r")
    sums = own.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(_pairs(F.col("n"))).alias("both"), F.sum(e1).alias("g1"), F.sum(e2).alias("g2"), F.sum(F.least(e1, e2)).alias("l"))
    by_est = est.groupBy(*by).agg(F.sum(F.col("e") - F.col("e_max")).alias("miss_e"), F.sum(_pairs(F.col("e"))).alias("pe"))
    by_ref = ref.groupBy(*by).agg(F.sum(F.col("r") - F.col("r_max")).alias("miss_r"), F.sum(_pairs(F.col("r"))).alias("pr"))
    n, all_pairs = F.col("n"), _pairs(F.col("n"))
    return (
        sums.join(by_est, list(by)).join(by_ref, list(by))
        .select(*by, "n", (F.col("miss_r") / n).alias("hamming_rm"), (F.col("miss_e") / n).alias("hamming_rf"), ((F.col("miss_e") + F.col("miss_r")) / (2 * n)).alias("hamming"),
                F.when(n > 1, (F.col("pe") + F.col("pr") - 2 * F.col("both")) / all_pairs).otherwise(F.lit(0.0)).alias("inverse_rand"),
                (F.least("g1", "g2") / n).alias("gce"), (F.col("l") / n).alias("lce"))
    )


def bounds(scores: DataFrame) -> DataFrame:
    """Rows of agreement() that break a bound: all errors within [0, 1], lce at most gce."""
    errors = [c for c in ("hamming_rm", "hamming_rf", "hamming", "inverse_rand", "gce", "lce") if c in scores.columns]
    bad = F.lit(False)
    for c in errors:
        bad = bad | ~F.col(c).between(0.0, 1.0)
    return scores.where(bad | (F.col("lce") > F.col("gce") + 1e-12))


def by_category(scores: DataFrame, values: list[str], category: str = "category") -> DataFrame:
    """(category, pairs, averages): of each category and, with a null category, of all; nulls count for nothing."""
    return scores.rollup(category).agg(F.count("*").alias("pairs"), *[F.avg(v).alias(v) for v in values])


def category_of(item: Column, size: int = 20) -> Column:
    """Items come in categories of `size`, numbered from 1."""
    return (F.floor((item - 1) / size) + 1).cast("int")


def mean_ranks(answers: DataFrame, methods: DataFrame) -> DataFrame:
    """(method, answers, mean_rank, deviation): answers (item, letters), where the letter at a place is its rank from a; methods (item, place, method)."""
    letters = answers.select("item", F.posexplode(F.split("letters", "")).alias("place", "letter")).where(F.col("letter") != "")
    ranked = letters.join(methods, ["item", "place"]).withColumn("rank", F.ascii("letter") - 96)
    return ranked.groupBy("method").agg(F.count("*").alias("answers"), F.avg("rank").alias("mean_rank"), F.stddev_pop("rank").alias("deviation"))


def blind_order(items: DataFrame, path: str, pattern: str, seed: str) -> DataFrame:
    """(item, positions map<method, position>): a seeded permutation of each item's methods; a method is what the pattern finds in its path."""
    from pyspark.sql import Window

    named = items.select("item", F.regexp_extract(path, pattern, 1).alias("method")).distinct()
    order = Window.partitionBy("item").orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("item").cast("string"), "method")))
    placed = named.withColumn("position", F.row_number().over(order) - 1)
    return placed.groupBy("item").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "position")))).alias("positions"))
