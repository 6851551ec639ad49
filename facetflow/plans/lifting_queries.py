"""Queries of label lifting and segmentation quality, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.operators import lifting, metrics
from facetflow.plans.analogues import FACING_SQL, PIXELS_SQL, pixels, poses, table

VOTE, PAIR = 1, 2


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front-facing pixels with labels that are unique over views."""
    px = pixels(spark, sf_dir)
    ids = lifting.label_ids(px)
    seen = px.join(F.broadcast(poses(spark)), "view").where(lifting.front_facing(F.col("nx"), F.col("ny"), F.col("nz"), F.col("pose"), 0.05))
    return seen.join(ids, ["mesh", "view", "raw"]).select("mesh", "view", "f", "label")


def _steps(spark: SparkSession, sf_dir: str) -> lifting.Lift:
    return lifting.Lift(_labelled(spark, sf_dir), vote=VOTE, pair=PAIR)


STEPS_SQL = f"""WITH RECURSIVE {PIXELS_SQL},
lab AS (SELECT DISTINCT mesh, view, raw FROM px WHERE raw <> 0),
ids AS (SELECT *, row_number() OVER (PARTITION BY mesh ORDER BY view, raw) AS label FROM lab),
pix AS (SELECT mesh, view, f, label FROM px JOIN ids USING (mesh, view, raw) WHERE {FACING_SQL}),
votes AS (SELECT mesh, view, f, label, count(*) AS n FROM pix WHERE f <> -1 GROUP BY ALL HAVING count(*) > {VOTE}),
win AS (SELECT mesh, view, f, label FROM (SELECT *, row_number() OVER (PARTITION BY mesh, view, f ORDER BY n DESC, label) AS r FROM votes) WHERE r = 1),
ov AS (SELECT a.mesh, a.label AS l1, b.label AS l2, count(*) AS n FROM win a JOIN win b ON a.mesh = b.mesh AND a.f = b.f AND a.view < b.view GROUP BY ALL),
both_ways AS (SELECT mesh, l1, l2, n FROM ov WHERE n > {PAIR} UNION ALL SELECT mesh, l2, l1, n FROM ov WHERE n > {PAIR}),
rat AS (SELECT *, n / sum(n) OVER (PARTITION BY mesh, l1) AS ratio FROM both_ways),
met AS (SELECT mesh, l1 AS label FROM ov UNION SELECT mesh, l2 FROM ov),
deg AS (SELECT met.mesh, met.label, count(rat.l2) AS degree FROM met LEFT JOIN rat ON met.mesh = rat.mesh AND met.label = rat.l1 GROUP BY ALL),
lim AS (SELECT mesh, greatest(quantile_cont(degree, 0.95), 16.0) AS lim FROM deg GROUP BY mesh),
prom AS (SELECT mesh, label FROM deg JOIN lim USING (mesh) WHERE degree > lim),
lft AS (SELECT * FROM rat r WHERE NOT EXISTS (SELECT 1 FROM prom p WHERE p.mesh = r.mesh AND p.label IN (r.l1, r.l2))),
bins AS (SELECT mesh, floor(ratio * 100)::BIGINT AS bin, count(*) AS c FROM lft GROUP BY ALL),
walk AS (SELECT mesh, bin, sum(c) OVER (PARTITION BY mesh ORDER BY bin) AS cum, sum(c) OVER (PARTITION BY mesh) AS total FROM bins),
thr AS (SELECT mesh, greatest((min(bin) + 1) / 100.0::DOUBLE, 0.075) AS threshold FROM walk WHERE cum >= 0.125 * total GROUP BY mesh),
strong AS (SELECT mesh, l1, l2 FROM lft JOIN thr USING (mesh) WHERE ratio > threshold),
mut AS (SELECT a.* FROM strong a JOIN strong b ON a.mesh = b.mesh AND a.l1 = b.l2 AND a.l2 = b.l1),
reach AS (SELECT mesh, l1 AS label, l1 AS hook FROM mut UNION SELECT mut.mesh, mut.l2, reach.hook FROM reach JOIN mut ON mut.mesh = reach.mesh AND mut.l1 = reach.label),
hooks AS (SELECT mesh, label, min(hook) AS hook FROM reach GROUP BY ALL)
"""


def _step(name: str):
    return lambda spark, sf_dir: getattr(_steps(spark, sf_dir), name)


def label_ids(spark, sf_dir):
    return lifting.label_ids(pixels(spark, sf_dir))


def front_facing(spark, sf_dir):
    px = pixels(spark, sf_dir).join(F.broadcast(poses(spark)), "view")
    return px.where(lifting.front_facing(F.col("nx"), F.col("ny"), F.col("nz"), F.col("pose"), 0.05)).groupBy("mesh", "view").agg(F.count("*").alias("n"))


def promiscuous_labels(spark, sf_dir):
    return lifting.promiscuous(_steps(spark, sf_dir).degrees, 0.5, 2.0)


def label_degrees(spark, sf_dir):
    return _steps(spark, sf_dir).degrees


def label_hooks(spark, sf_dir):
    return _steps(spark, sf_dir).hooks


def lifted_labels(spark, sf_dir):
    return _steps(spark, sf_dir).lifted()


def lifted_labels_sum(spark, sf_dir):
    return _steps(spark, sf_dir).lifted(merge="sum")


def lifted_statistics(spark, sf_dir):
    return lifting.label_statistics(lifted_labels(spark, sf_dir))


LAST_SQL = STEPS_SQL + """, lastw AS (SELECT mesh, f, label FROM (SELECT *, row_number() OVER (PARTITION BY mesh, f ORDER BY view DESC) AS r FROM win) WHERE r = 1),
lifted AS (SELECT lastw.mesh, f, coalesce(hook, lastw.label) AS label FROM lastw LEFT JOIN hooks ON lastw.mesh = hooks.mesh AND lastw.label = hooks.label)"""


# --- quality ------------------------------------------------------------------------------------

def _pairs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_linenumber")).alias("mesh"), F.col("l_returnflag").alias("est"), F.concat("l_linestatus", (F.col("l_suppkey") % 2).cast("string")).alias("ref"))


PAIRS_SQL = "WITH p AS (SELECT l_linenumber AS mesh, l_returnflag AS est, l_linestatus || (l_suppkey % 2)::VARCHAR AS ref FROM lineitem)"


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def contingency(spark, sf_dir):
    return metrics.contingency(_pairs(spark, sf_dir))


def contingency_margins(spark, sf_dir):
    return metrics.margins(_pairs(spark, sf_dir))


def segmentation_agreement(spark, sf_dir):
    return rounded(metrics.agreement(_pairs(spark, sf_dir)))


AGREE_SQL = PAIRS_SQL + """, c AS (SELECT mesh, est, ref, count(*) AS n FROM p GROUP BY ALL),
e AS (SELECT mesh, est, sum(n) AS e, max(n) AS m FROM c GROUP BY ALL), r AS (SELECT mesh, ref, sum(n) AS r, max(n) AS m FROM c GROUP BY ALL),
t AS (SELECT mesh, sum(n) AS n FROM c GROUP BY ALL),
x AS (SELECT c.mesh, sum(c.n * (c.n - 1) / 2) AS both_in, sum(c.n * (e.e - c.n) / e.e) AS g1, sum(c.n * (r.r - c.n) / r.r) AS g2, sum(least(c.n * (e.e - c.n) / e.e, c.n * (r.r - c.n) / r.r)) AS l
  FROM c JOIN e USING (mesh, est) JOIN r ON c.mesh = r.mesh AND c.ref = r.ref GROUP BY c.mesh),
a AS (SELECT t.mesh, t.n::BIGINT AS n, (SELECT sum(r - m) FROM r WHERE r.mesh = t.mesh) / t.n AS hamming_rm, (SELECT sum(e - m) FROM e WHERE e.mesh = t.mesh) / t.n AS hamming_rf,
  ((SELECT sum(e * (e - 1) / 2) FROM e WHERE e.mesh = t.mesh) + (SELECT sum(r * (r - 1) / 2) FROM r WHERE r.mesh = t.mesh) - 2 * both_in) / (t.n * (t.n - 1) / 2) AS inverse_rand, least(g1, g2) / t.n AS gce, l / t.n AS lce
  FROM t JOIN x ON t.mesh = x.mesh)"""
AGREE_COLUMNS = "round(hamming_rm, 9) AS hamming_rm, round(hamming_rf, 9) AS hamming_rf, round((hamming_rm + hamming_rf) / 2, 9) AS hamming, round(inverse_rand, 9) AS inverse_rand, round(gce, 9) AS gce, round(lce, 9) AS lce"


def metrics_rollup(spark, sf_dir):
    """Items are numbered 1 to 140 in seven categories; one of them is left out."""
    items = _pairs(spark, sf_dir).withColumn("mesh", F.col("mesh") * 20)
    scores = metrics.agreement(items).withColumn("category", metrics.category_of(F.col("mesh"))).where("category <> 4")
    return rounded(metrics.by_category(scores, ["hamming", "inverse_rand", "gce", "lce"]), 6)


def broken_bounds(spark, sf_dir):
    """Of errors that were spoilt for every other mesh."""
    return metrics.bounds(metrics.agreement(_pairs(spark, sf_dir)).withColumn("gce", F.when(F.col("mesh") % 2 == 1, F.col("gce") / 4).otherwise(F.col("gce")))).select("mesh")


def mean_ranks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    answers = orders.select((F.col("o_orderkey") % 40).alias("item"), F.when(F.col("o_orderstatus") == "F", "abc").when(F.col("o_orderstatus") == "O", "bca").otherwise("cab").alias("letters"))
    methods = table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.explode(F.sequence(F.lit(0), F.lit(39))).alias("item"), F.col("r_regionkey").alias("place"), F.col("r_name").alias("method"))
    methods = methods.withColumn("item", F.col("item").cast("long")).withColumn("place", F.pmod(F.col("place") + F.col("item"), F.lit(3)).cast("int"))
    return rounded(metrics.mean_ranks(answers, methods), 6)


def blind_order(spark, sf_dir):
    items = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("item"), F.concat(F.lit("/runs/"), F.lower("n_name"), F.lit("/out.obj")).alias("path"))
    return metrics.blind_order(items, "path", "/runs/([^/]+)/", "blind").select("item", F.explode("positions").alias("method", "position"))


QUERIES = {
    "label_ids": label_ids, "front_facing": front_facing, "pixel_votes": _step("votes"), "view_winner": _step("winners"), "label_pairs": _step("overlaps"),
    "label_ratios": lambda s, d: rounded(_step("ratios")(s, d)), "label_degrees": label_degrees, "promiscuous_labels": promiscuous_labels, "promiscuous_filter": lambda s, d: rounded(_step("left")(s, d)),
    "ratio_histogram": _step("threshold"), "mutual_edges": _step("edges"), "label_hooks": label_hooks, "lifted_labels": lifted_labels, "lifted_labels_sum": lifted_labels_sum, "lifted_statistics": lifted_statistics,
    "contingency": contingency, "contingency_margins": contingency_margins, "segmentation_agreement": segmentation_agreement, "metrics_rollup": metrics_rollup, "broken_bounds": broken_bounds, "mean_ranks": mean_ranks, "blind_order": blind_order,
}
ORACLES = {
    "label_ids": STEPS_SQL + "SELECT * FROM ids",
    "front_facing": f"WITH {PIXELS_SQL} SELECT mesh, view, count(*) AS n FROM px WHERE {FACING_SQL} GROUP BY ALL",
    "pixel_votes": STEPS_SQL + "SELECT * FROM votes",
    "view_winner": STEPS_SQL + "SELECT * FROM win",
    "label_pairs": STEPS_SQL + "SELECT * FROM ov",
    "label_ratios": STEPS_SQL + "SELECT mesh, l1, l2, n, round(ratio, 9) AS ratio FROM rat",
    "label_degrees": STEPS_SQL + "SELECT * FROM deg",
    "promiscuous_labels": STEPS_SQL + "SELECT mesh, label FROM deg JOIN (SELECT mesh, greatest(quantile_cont(degree, 0.5), 2.0) AS lim FROM deg GROUP BY mesh) USING (mesh) WHERE degree > lim",
    "promiscuous_filter": STEPS_SQL + "SELECT mesh, l1, l2, n, round(ratio, 9) AS ratio FROM lft",
    "ratio_histogram": STEPS_SQL + "SELECT * FROM thr",
    "mutual_edges": STEPS_SQL + "SELECT * FROM mut",
    "label_hooks": STEPS_SQL + "SELECT * FROM hooks",
    "lifted_labels": LAST_SQL + " SELECT * FROM lifted",
    "lifted_labels_sum": STEPS_SQL + ", s AS (SELECT v.mesh, f, coalesce(hook, v.label) AS label, sum(n) AS n FROM votes v LEFT JOIN hooks ON v.mesh = hooks.mesh AND v.label = hooks.label GROUP BY ALL) SELECT mesh, f, label FROM (SELECT *, row_number() OVER (PARTITION BY mesh, f ORDER BY n DESC, label) AS r FROM s) WHERE r = 1",
    "lifted_statistics": LAST_SQL + " SELECT mesh, label, count(*) AS faces FROM lifted GROUP BY ALL",
    "contingency": PAIRS_SQL + " SELECT mesh, est, ref, count(*) AS n FROM p GROUP BY ALL",
    "contingency_margins": PAIRS_SQL + " SELECT mesh, est, ref, (grouping(est) * 2 + grouping(ref))::INT AS level, count(*) AS n FROM p GROUP BY GROUPING SETS ((mesh, est, ref), (mesh, est), (mesh, ref), (mesh))",
    "segmentation_agreement": AGREE_SQL + f" SELECT mesh, n, {AGREE_COLUMNS} FROM a",
    "metrics_rollup": AGREE_SQL + ", k AS (SELECT *, ((mesh * 20 - 1) // 20 + 1)::INT AS category, (hamming_rm + hamming_rf) / 2 AS hamming FROM a) SELECT category, count(*) AS pairs, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("hamming", "inverse_rand", "gce", "lce")) + " FROM k WHERE category <> 4 GROUP BY ROLLUP (category)",
    "broken_bounds": AGREE_SQL + ", b AS (SELECT * REPLACE (CASE WHEN mesh % 2 = 1 THEN gce / 4 ELSE gce END AS gce) FROM a) SELECT mesh FROM b WHERE NOT (hamming_rm BETWEEN 0 AND 1 AND hamming_rf BETWEEN 0 AND 1 AND inverse_rand BETWEEN 0 AND 1 AND gce BETWEEN 0 AND 1 AND lce BETWEEN 0 AND 1) OR lce > gce + 1e-12",
    "mean_ranks": "WITH a AS (SELECT o_orderkey % 40 AS item, CASE o_orderstatus WHEN 'F' THEN 'abc' WHEN 'O' THEN 'bca' ELSE 'cab' END AS letters FROM orders), l AS (SELECT item, k AS place, substr(letters, k + 1, 1) AS letter FROM a, (VALUES (0), (1), (2)) t(k)), m AS (SELECT i AS item, ((r_regionkey + i) % 3) AS place, r_name AS method FROM region, range(40) t(i) WHERE r_regionkey < 3) SELECT method, count(*) AS answers, round(avg(ascii(letter) - 96), 6) AS mean_rank, round(stddev_pop(ascii(letter) - 96), 6) AS deviation FROM l JOIN m USING (item, place) GROUP BY method",
    "blind_order": "SELECT n_regionkey AS item, lower(n_name) AS method, (row_number() OVER (PARTITION BY n_regionkey ORDER BY md5('blind|' || n_regionkey || '|' || lower(n_name))) - 1)::INT AS position FROM nation",
}
