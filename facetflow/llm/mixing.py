"""Mixing sources to target weights: temperature, budgets, and block permutations."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetflow.operators.skew import met, parts_of
from facetflow.session import cut

SOURCES, BLOCKS = 100_000, 200_000  # rows up to which a table of sources or blocks is broadcast; beyond that hot sources are dealt out
HOT, STEPS = 100_000, 64
BLOCK_TOKENS = 65_536


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x09-\\x0D ]+")), F.lit(0)).cast("long")


def name_of(source: Column) -> Column:
    """A null source is a source of its own."""
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source.cast("string")))


def digest(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts]))


def exponent(measures: Callable[[list[float]], list[float]], limit: float, rising: bool) -> float:
    """To a millionth: rising=False: the least exponent in [0, 1] whose measure (falling) is at most limit; rising=True: the greatest whose measure (falling) is at least limit. Of each interval STEPS - 1 points are measured at once, as many steps of a bisection."""
    good = (lambda v: v >= limit) if rising else (lambda v: v <= limit)
    best, other = (1.0, 0.0) if not rising else (0.0, 1.0)
    if good(measures([other])[0]):
        return other
    for _ in range(8):
        points = [other + (best - other) * i / STEPS for i in range(1, STEPS)]
        found = next((i for i, v in enumerate(measures(points)) if good(v)), len(points))
        best, other = points[found] if found < len(points) else best, points[found - 1] if found else other
    return (math.floor if rising else math.ceil)(best * 1e6) / 1e6


def powers(some: DataFrame, whole: int, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent the sum over sources of their share to it, and of that times the share's logarithm: decimal sums, the same in whatever order."""
    share = F.col("tokens") / F.lit(float(whole))
    rows = some.select(share.alias("share"), F.posexplode(F.array(*map(F.lit, exponents))).alias("i", "a")).withColumn("p", F.pow("share", "a"))
    exact = lambda c: F.sum(c.cast("decimal(28,20)")).cast("double")
    found = {r["i"]: (r["power"], r["mass"]) for r in rows.groupBy("i").agg(exact(F.col("p")).alias("power"), exact(F.col("p") * F.log("share")).alias("mass")).collect()}
    return [found[i] for i in range(len(exponents))]


def weights(totals: DataFrame, repetition: float | None, entropy: float | None, cover: bool) -> tuple[float, float, float]:
    """(exponent, sum of powers of the shares, budget in tokens) for totals (name, tokens)."""
    some = totals.where("tokens > 0")
    whole, top, low = some.agg(F.sum("tokens"), F.max("tokens"), F.min("tokens")).first()
    if not whole:
        return 1.0, 1.0, 0.0
    if entropy is not None:
        a = exponent(lambda e: [math.log(p) - a * m / p for a, (p, m) in zip(e, powers(some, whole, e), strict=True)], entropy, True)
    elif cover:
        a = exponent(lambda e: [(low / top) ** (a - 1) for a in e], repetition, False)
    else:
        a = exponent(lambda e: [(low / whole) ** (a - 1) / p for a, (p, _) in zip(e, powers(some, whole, e), strict=True)], repetition, False)
    z = powers(some, whole, [a])[0][0]
    return a, z, (top / ((top / whole) ** a / z) if cover else float(whole))


def block_of(n_blocks: Column, seed: str) -> Column:
    return F.conv(F.substring(digest(seed, "part", F.col("id")), 1, 12), 16, 10).cast("long") % n_blocks


def running(rows: DataFrame, keys: list[str], order: str, tie: str, value: str) -> DataFrame:
    """rows with rank (from 0) and before (sum of the value over the rows before) by order (a hexadecimal digest), then tie, within keys; a key's rows are dealt out by their order's first digits."""
    own = rows.withColumn("_p", F.substring(order, 1, 3))
    sizes = own.groupBy(*keys, "_p").agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s"))
    w = Window.partitionBy(*keys, "_p").orderBy(order, tie)
    own = own.withColumn("rank", F.row_number().over(w) - 1).withColumn("before", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    return own.join(sizes, [*keys, "_p"]).withColumn("rank", F.col("rank") + F.col("_n")).withColumn("before", F.col("before") + F.col("_s")).drop("_p", "_n", "_s")


def planned(slim: DataFrame, repetition: float | None, entropy: float | None, cover: bool, seed: str) -> DataFrame:
    """The plan, one row per block of a source and epoch that has a place, for slim (name, id, tokens): name, n_blocks, block, epoch, rank, cutoff (greatest order digest that is in, null: all)."""
    totals = cut(slim.groupBy("name").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")))
    a, z, budget = weights(totals, repetition, entropy, cover)
    whole = totals.agg(F.sum("tokens")).first()[0] or 1
    share = F.col("tokens") / F.lit(whole)
    own = F.floor(F.lit(budget) * F.pow(share, F.lit(a)) / F.lit(z) + F.lit(1e-6)).cast("long")
    sources = totals.withColumn("budget", F.when(F.col("tokens") > 0, own).otherwise(F.lit(0))).select(
        "name",
        F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("int").alias("epochs"),
        F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(F.lit(0)).alias("rest"),
        F.greatest(F.lit(1), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("long").alias("n_blocks"), "rows",
    )
    sources = cut(sources)
    by = of_source(slim, sources.select("name", "epochs", "rest", "n_blocks"), sources).withColumn("block", block_of(F.col("n_blocks"), seed))
    blocks = by.groupBy("name", "block").agg(F.sum("tokens").alias("tokens"), F.first("epochs").alias("epochs"), F.first("rest").alias("rest"), F.first("n_blocks").alias("n_blocks"))
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs")))).withColumn("order", digest(seed, "block", F.col("name"), F.col("epoch").cast("string"), F.col("block").cast("string")))
    blocks = running(blocks, ["name", "epoch"], "order", "block", "tokens").where((F.col("epoch") < F.col("epochs")) | (F.col("before") < F.col("rest")))
    left = F.when((F.col("epoch") == F.col("epochs")) & (F.col("before") + F.col("tokens") > F.col("rest")), F.col("rest") - F.col("before"))
    blocks = cut(blocks.select("name", "n_blocks", "block", "epoch", "rank", left.alias("left")))
    # at most one block of a source is cut, after the row that fills the budget
    edge = small(blocks.where(F.col("left").isNotNull()).select("name", "block", "epoch", "left"), SOURCES)
    keys = by.select("name", "block", "id", "tokens").join(edge, ["name", "block"]).groupBy("name", "left", digest(seed, "row", F.col("epoch").cast("string"), F.col("id")).alias("key")).agg(F.sum("tokens").alias("tokens"), F.min("id").alias("id"))
    cutoffs = running(keys, ["name", "left"], "key", "id", "tokens").where("before < left").groupBy("name").agg(F.max("key").alias("cutoff"))
    kept = blocks.join(cutoffs, "name", "left").select("name", "n_blocks", "block", "epoch", "rank", F.when(F.col("left").isNotNull(), F.col("cutoff")).alias("cutoff"))
    return cut(kept.join(small(sources.select("name", "rows"), SOURCES), "name"))


def of_source(rows: DataFrame, sources: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows joined with one row a source, broadcast if there are few; else rows of hot sources, by sizes (name, rows), are dealt out in parts."""
    if sources.limit(SOURCES + 1).count() <= SOURCES:
        return rows.join(F.broadcast(sources), "name")
    return met(rows, sources, parts_of(sizes.select("name", "rows"), "name", "rows", HOT), "name", "id")


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dealt(slim: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """slim's rows, once for each epoch in which each has a place, with epoch, rank and order_key."""
    counts = plan.groupBy("name").agg(F.first("n_blocks").alias("n_blocks"), F.first("rows").alias("rows"))
    at = of_source(slim, counts.drop("rows"), counts).withColumn("block", block_of(F.col("n_blocks"), seed)).drop("n_blocks")
    rows = at.join(small(plan.drop("n_blocks", "rows"), BLOCKS), ["name", "block"]).withColumn("order_key", digest(seed, "row", F.col("epoch").cast("string"), F.col("id")))
    return rows.where(F.col("cutoff").isNull() | (F.col("order_key") <= F.col("cutoff")))


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", repetition: float | None = 4.0, entropy: float | None = None, cover: bool = False, seed: str = "mix") -> DataFrame:
    """One row per document and epoch in which it has a place: key, source, epoch, block_rank, order_key, tokens.

    Shares of the sources (in words between white space) are raised to one exponent in [0, 1] and normalised. The exponent is found by
    bisection: the least one at which no source is repeated more than `repetition` times, or the greatest at which the
    weights' entropy (nats) is at least `entropy`. The budget is the corpus's words; with cover=True as many as the largest
    source needs to be used once, so that nothing is left out. A source whose budget is e times its words and a rest gets
    e whole epochs and one part epoch. Rows of a source are split into blocks of about 65,536 words
    by a digest of the key; each epoch has a seeded permutation of its own of the blocks, and of the rows of a block (by
    block_rank, then order_key); the part epoch is cut after the row that fills the budget.

    A null source is a source of its own; null and empty texts have 0 words and are dealt like others, but a source without
    words gets nothing. Rows that repeat a key have the same places; texts of any length count whole. An empty table gives an empty result. Other columns are ignored.
    """
    slim = cut(docs.select(name_of(F.col(source)).alias("name"), F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("id"), F.col(key).alias("_key"), F.col(source).alias("_source"), words(F.col(text)).alias("tokens")))
    plan = planned(slim.select("name", "id", "tokens"), repetition, entropy, cover, seed)
    rows = dealt(slim, plan, seed)
    return rows.select(F.col("_key").alias(key), F.col("_source").alias(source), "epoch", F.col("rank").cast("int").alias("block_rank"), "order_key", "tokens")


def repeated(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", repetition: float = 2.0, seed: str = "mix") -> DataFrame:
    """docs with each row once for each epoch in which it has a place, at least once where its source has words; the columns of docs."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name_of(F.col(source)).alias("name"), F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("id"), words(F.col(text)).alias("tokens"))
    plan = planned(cut(named.select("name", "id", "tokens")), repetition, None, True, seed)
    return dealt(named.drop("tokens"), plan, seed).select("row.*")


MIX_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS name, coalesce(doc_id::VARCHAR, 'null') AS id,
  coalesce(len(regexp_extract_all(text, '[^\\x09-\\x0D ]+')), 0)::BIGINT AS tokens FROM documents),
t AS (SELECT name, sum(tokens)::BIGINT AS tokens FROM w GROUP BY name),
a AS (SELECT sum(tokens)::DOUBLE AS whole, min(tokens) FILTER (tokens > 0)::DOUBLE AS low FROM t),
p AS (SELECT tokens / whole AS share FROM t, a WHERE tokens > 0),
f0 AS (SELECT (SELECT 1 / (low / whole) FROM a) / (SELECT count(*) FROM p) AS f),
b AS (SELECT 0 AS i, 1.0::DOUBLE AS best, 0.0::DOUBLE AS other
  UNION ALL SELECT i + 1, CASE WHEN ok THEN mid ELSE best END, CASE WHEN ok THEN other ELSE mid END FROM
  (SELECT i, best, other, (best + other) / 2 AS mid, (SELECT pow(low / whole, (b.best + b.other) / 2 - 1) FROM a) / (SELECT sum(pow(share, (b.best + b.other) / 2)) FROM p) <= 4 AS ok FROM b WHERE i < 48)),
e AS (SELECT CASE WHEN (SELECT f FROM f0) <= 4 THEN 0.0 ELSE ceil(best * 1e6) / 1e6 END AS alpha FROM b WHERE i = 48),
z AS (SELECT sum(pow(share, alpha)) AS z FROM p, e),
s0 AS (SELECT name, tokens, CASE WHEN tokens > 0 THEN floor(whole * pow(tokens / whole, alpha) / z + 1e-6)::BIGINT ELSE 0 END AS budget FROM t, a, e, z),
s AS (SELECT name, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END::BIGINT AS epochs, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest, greatest(1, ceil(tokens / 65536))::BIGINT AS n_blocks FROM s0),
d0 AS (SELECT w.*, s.epochs, s.rest, ('0x' || substr(md5('mix|part|' || id), 1, 12))::BIGINT % n_blocks AS block FROM w JOIN s USING (name)),
d1 AS (SELECT *, unnest(range(epochs + 1)) AS epoch FROM d0), d AS (SELECT *, md5('mix|row|' || epoch || '|' || id) AS order_key FROM d1),
k0 AS (SELECT name, epoch, block, sum(tokens) AS tokens, any_value(epochs) AS epochs, any_value(rest) AS rest, md5('mix|block|' || name || '|' || epoch || '|' || block) AS o FROM d GROUP BY name, epoch, block),
k AS (SELECT *, row_number() OVER (PARTITION BY name, epoch ORDER BY o, block) - 1 AS rank, sum(tokens) OVER (PARTITION BY name, epoch ORDER BY o, block ROWS UNBOUNDED PRECEDING) - tokens AS before FROM k0),
g AS (SELECT name, epoch, block, rank, CASE WHEN epoch = epochs AND before + tokens > rest THEN rest - before END AS left_over FROM k WHERE epoch < epochs OR before < rest),
c0 AS (SELECT d.name, order_key, any_value(left_over) AS left_over, sum(tokens) AS tokens FROM d JOIN g ON d.name = g.name AND d.epoch = g.epoch AND d.block = g.block WHERE left_over IS NOT NULL GROUP BY d.name, order_key),
c1 AS (SELECT *, sum(tokens) OVER (PARTITION BY name ORDER BY order_key ROWS UNBOUNDED PRECEDING) - tokens AS before FROM c0),
c AS (SELECT name, max(order_key) AS cutoff FROM c1 WHERE before < left_over GROUP BY name)
SELECT doc_id, source, d.epoch::INT AS epoch, rank::INT AS block_rank, order_key, tokens FROM d JOIN g ON d.name = g.name AND d.epoch = g.epoch AND d.block = g.block LEFT JOIN c ON d.name = c.name WHERE left_over IS NULL OR order_key <= cutoff
"""
