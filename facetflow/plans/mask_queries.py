"""Queries of masks, run lengths, boxes and suppression, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.operators import masks
from facetflow.plans.analogues import NUMBERS_SQL, each, numbered, table
from facetflow.plans.lifting_queries import rounded
from facetflow.session import cut

H, W, MASKS = 16, 18, 4
INSIDE = "(y - 3 * mask) * (y - 3 * mask) + (x - 2 * mask - img % 3) * (x - 2 * mask - img % 3) <= (3 + mask) * (3 + mask) AND (y * 7 + x * 5 + mask) % 29 <> 0 OR (y * 31 + x * 17 + mask * 7 + img * 3) % 53 = 0"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = each(numbered(spark, sf_dir, "img"), "id", 0, H * W - 1)
    return rows.select("img", F.expr(f"cast(id div {W} as int)").alias("y"), F.expr(f"cast(id % {W} as int)").alias("x"))


def discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discs with pinholes and specks."""
    return each(grid(spark, sf_dir), "mask", 1, MASKS).where(INSIDE).select("img", "mask", "y", "x")


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark, sf_dir, "img").select("img", F.lit(H).alias("h"), F.lit(W).alias("w"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.pmod(F.col("y") * 31 + F.col("x") * 17 + F.col("mask") * 71 + F.col("img") * 3, F.lit(97)) / 10.0 - 4.8
    return each(grid(spark, sf_dir), "mask", 1, MASKS).select("img", "mask", "y", "x", value.alias("logit"))


GRID_SQL = f"""WITH RECURSIVE g AS (SELECT a.i::INT AS img, b.y::INT AS y, c.x::INT AS x FROM {NUMBERS_SQL} a(i), range({H}) b(y), range({W}) c(x)),
m4 AS (SELECT img, k::INT AS mask, y, x FROM g, range(1, {MASKS + 1}) t(k)), ms AS (SELECT * FROM m4 WHERE {INSIDE}),
ar AS (SELECT img, mask, count(*) AS area FROM ms GROUP BY ALL),
rk AS (SELECT img, mask, row_number() OVER (PARTITION BY img ORDER BY area DESC, mask) AS rank FROM ar),
pa AS (SELECT img, y, x, max(rank)::INT AS rank FROM ms JOIN rk USING (img, mask) GROUP BY ALL),
lg AS (SELECT img, mask, y, x, ((y * 31 + x * 17 + mask * 71 + img * 3) % 97) / 10.0::DOUBLE - 4.8 AS logit FROM m4)
"""
#: Components of pixels p (img, mask, y, x): reach, then the first pixel and the size.
COMPONENTS = """, {p}r AS (SELECT img, mask, y, x, y * 1000 + x AS c FROM {p} UNION SELECT r.img, r.mask, q.y, q.x, r.c FROM {p}r r JOIN {p} q ON q.img = r.img AND q.mask = r.mask AND abs(q.y - r.y) <= 1 AND abs(q.x - r.x) <= 1),
{p}c AS (SELECT img, mask, y, x, min(c) AS c FROM {p}r GROUP BY ALL), {p}a AS (SELECT *, count(*) OVER (PARTITION BY img, mask, c) AS area FROM {p}c)"""


def foreground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).withColumn("foreground", F.col("x") < W - 3)


def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.with_foreground(foreground(spark, sf_dir), masks.painted(discs(spark, sf_dir)))


def islands(spark, sf_dir):
    return masks.without_islands(discs(spark, sf_dir), 3)


def holes(spark, sf_dir):
    return masks.with_holes_filled(discs(spark, sf_dir), grid(spark, sf_dir), 3)


def components(spark, sf_dir):
    return masks.pixel_components(discs(spark, sf_dir), ["img", "mask"]).select("img", "mask", "y", "x", (F.col("comp.y") * 1000 + F.col("comp.x")).alias("c"), "area")


def cleaned_map(spark, sf_dir):
    return masks.cleaned_map(cut(label_map(spark, sf_dir)), 4)


def cleaned_once(spark, sf_dir):
    return masks.cleaned_once(cut(discs(spark, sf_dir)), grid(spark, sf_dir), 3)[1]


def rle(spark, sf_dir):
    return masks.run_lengths(discs(spark, sf_dir), sizes(spark, sf_dir)).select("img", "mask", F.array_join("counts", ",").alias("counts"), "area")


RLE_SQL = GRID_SQL + f""", o AS (SELECT m4.img, m4.mask, m4.x * {H} + m4.y AS pos, (ms.y IS NOT NULL)::INT AS b FROM m4 LEFT JOIN ms USING (img, mask, y, x)),
k AS (SELECT *, sum(ch) OVER (PARTITION BY img, mask ORDER BY pos) AS run FROM (SELECT *, (b <> coalesce(lag(b) OVER (PARTITION BY img, mask ORDER BY pos), 0))::INT AS ch FROM o)),
n AS (SELECT img, mask, run, count(*) AS n FROM k GROUP BY ALL), z AS (SELECT img, mask, run, n FROM n UNION ALL SELECT img, mask, 0, 0 FROM ar WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.img = ar.img AND n.mask = ar.mask AND n.run = 0))
SELECT z.img, z.mask, string_agg(n::VARCHAR, ',' ORDER BY run) AS counts, any_value(area) AS area FROM z JOIN ar USING (img, mask) GROUP BY z.img, z.mask"""


def rle_decoded(spark, sf_dir):
    return masks.from_run_lengths(masks.run_lengths(discs(spark, sf_dir), sizes(spark, sf_dir)), sizes(spark, sf_dir)).select("img", "mask", "y", "x")


def _boxes(spark, sf_dir) -> DataFrame:
    """lineitem rows as boxes; the lines of sixteen orders are an image, so images grow in number and not in size."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey div 16").cast("int").alias("img"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(*[F.min(c).alias(c) for c in ("l_quantity", "l_discount", "l_tax", "l_partkey")])
    x0, y0 = F.col("l_quantity"), F.pmod(F.col("l_partkey"), F.lit(37)).cast("double")
    return line.select("img", "id", x0.alias("x0"), y0.alias("y0"), (x0 + 5 + F.round(F.col("l_tax") * 100)).alias("x1"), (y0 + 6 + F.round(F.col("l_discount") * 100)).alias("y1"), (F.pmod(F.col("l_partkey") * 31, F.lit(1009)) / 1009.0).alias("score"))


BOX_SQL = """WITH b AS (SELECT (l_orderkey // 16)::INT AS img, l_orderkey * 10 + l_linenumber AS id, min(l_quantity) AS x0, (min(l_partkey) % 37)::DOUBLE AS y0, min(l_quantity) + 5 + round(min(l_tax) * 100) AS x1,
  (min(l_partkey) % 37)::DOUBLE + 6 + round(min(l_discount) * 100) AS y1, ((min(l_partkey) * 31) % 1009) / 1009.0::DOUBLE AS score FROM lineitem GROUP BY 1, 2),
p AS (SELECT a.img, a.id AS a, c.id AS b, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, c.x0 AS bx0, c.y0 AS by0, c.x1 AS bx1, c.y1 AS by1, greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0) AS i,
  (a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) AS s FROM b a JOIN b c ON a.img = c.img AND a.id < c.id)"""


def box_pairs(spark, sf_dir):
    return rounded(masks.overlapping_boxes(_boxes(spark, sf_dir), 16.0, 0.1), 12)


def giou_pairs(spark, sf_dir):
    """Of all pairs of an image: boxes apart from each other have one too, and an image has few boxes."""
    own = _boxes(spark, sf_dir)
    other = own.select("img", *[F.col(c).alias(f"{c}_b") for c in ("id", "x0", "y0", "x1", "y1")])
    a, b = [F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.col(f"{c}_b") for c in ("x0", "y0", "x1", "y1")]
    return rounded(own.join(other, "img").where("id < id_b").select("img", F.col("id").alias("a"), F.col("id_b").alias("b"), masks.generalised_iou(a, b).alias("giou")), 12)


def nms(spark, sf_dir):
    return masks.suppressed(_boxes(spark, sf_dir), 0.3, 0.1).select("img", "id")


NMS_SQL = BOX_SQL + """, l AS (SELECT img, list({'id': id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1} ORDER BY score DESC, id) AS l FROM b WHERE score > 0.1 GROUP BY img),
k AS (SELECT img, list_reduce(l, lambda kept, b: CASE WHEN len(list_filter(kept, lambda k: greatest(least(k.x1, b[1].x1) - greatest(k.x0, b[1].x0), 0) * greatest(least(k.y1, b[1].y1) - greatest(k.y0, b[1].y0), 0) > 0.3::DOUBLE * ((k.x1 - k.x0) * (k.y1 - k.y0) + (b[1].x1 - b[1].x0) * (b[1].y1 - b[1].y0) - greatest(least(k.x1, b[1].x1) - greatest(k.x0, b[1].x0), 0) * greatest(least(k.y1, b[1].y1) - greatest(k.y0, b[1].y0), 0)))) > 0 THEN kept ELSE list_concat(kept, b) END) AS kept FROM (SELECT img, list_transform(l, lambda x: [x]) AS l FROM l))
SELECT img, unnest(kept).id AS id FROM k"""


def nms_matrix(spark, sf_dir):
    own = cut(_boxes(spark, sf_dir))
    return masks.suppressed_by_matrix(own.where("score > 0.1").select("img", "id", "score"), masks.overlapping_boxes(own.where("score > 0.1"), 16.0), 0.3)


def box_formats(spark, sf_dir):
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    named = {}
    for target in ("xywh", "cxcywh"):
        out = masks.converted(box, "xyxy", target)
        named |= {f"{target}_{i}": c for i, c in enumerate(out)} | {f"{target}_back_{i}": c for i, c in enumerate(masks.converted(out, target, "xyxy"))}
    return rounded(_boxes(spark, sf_dir).select("img", "id", *[c.alias(n) for n, c in named.items()]), 6)


def box_filters(spark, sf_dir):
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    edge = masks.near_crop_edge(box, [F.lit(v) for v in (5.0, 5.0, 40.0, 30.0)], [F.lit(v) for v in (0.0, 0.0, 80.0, 80.0)], 2.0)
    border = masks.near_border([c / 80 for c in box], 0.2)
    return _boxes(spark, sf_dir).select("img", "id", edge.alias("edge"), border.alias("border"))


def stability(spark, sf_dir):
    a = masks.stability(logits(spark, sf_dir), 0.0, 1.0)
    b = masks.stability(logits(spark, sf_dir), 0.0, 1.0, symmetric=False).withColumnRenamed("score", "other")
    return rounded(a.join(b, ["img", "mask"]), 6)


def filtered(spark, sf_dir):
    rows = masks.areas(discs(spark, sf_dir)).join(masks.stability(logits(spark, sf_dir), 0.0, 1.0), ["img", "mask"]).select("img", "mask", "area", F.col("score").alias("stability"), (F.col("mask") / 5).alias("iou"))
    return masks.filtered(rows, 0.4, 0.5, 60).select("img", "mask")


def sprinkles(spark, sf_dir):
    rows = logits(spark, sf_dir).withColumn("logit", F.when(F.expr(INSIDE), F.lit(1.0)).otherwise(F.lit(-1.0)))
    return masks.holes_and_sprinkles(cut(rows), 2)


SPRINKLE_SQL = GRID_SQL + ", ou AS (SELECT * FROM m4 WHERE NOT EXISTS (SELECT 1 FROM ms WHERE ms.img = m4.img AND ms.mask = m4.mask AND ms.y = m4.y AND ms.x = m4.x))" + COMPONENTS.format(p="ms") + COMPONENTS.format(p="ou") + """
SELECT img, mask, y, x, CASE WHEN area <= least(2, (SELECT area // 2 FROM ar WHERE ar.img = msa.img AND ar.mask = msa.mask)) THEN -0.1 ELSE 1.0 END::DOUBLE AS logit FROM msa UNION ALL SELECT img, mask, y, x, CASE WHEN area <= 2 THEN 0.1 ELSE -1.0 END::DOUBLE FROM oua"""


def boundary(spark, sf_dir):
    return masks.boundary(discs(spark, sf_dir).join(sizes(spark, sf_dir), "img"))


def boundary_f(spark, sf_dir):
    edge = cut(boundary(spark, sf_dir))
    est = edge.where("mask <= 3")
    ref = edge.where("mask >= 2").withColumn("mask", F.col("mask") - 1)
    return rounded(masks.boundary_f(est, ref, 1), 6)


BOUNDARY_SQL = GRID_SQL + f""", o AS (SELECT m4.img, m4.mask, m4.y, m4.x, (ms.y IS NOT NULL)::INT AS b FROM m4 LEFT JOIN ms USING (img, mask, y, x)),
bd AS (SELECT DISTINCT o.img, o.mask, o.y, o.x FROM o JOIN o n ON n.img = o.img AND n.mask = o.mask AND n.y - o.y IN (0, 1) AND n.x - o.x IN (0, 1) AND n.b <> o.b)"""


def packed_counts(spark, sf_dir):
    """Run lengths as text, and read from it again."""
    own = masks.run_lengths(discs(spark, sf_dir), sizes(spark, sf_dir)).select("img", "mask", "area", masks.packed_counts(F.col("counts")).alias("text"))
    again = masks.unpacked_counts(F.col("text"))
    return own.select("img", "mask", "text", F.array_join(again, ",").alias("counts"), masks.run_length_area(again).cast("long").alias("area"))


def line_counts(spark, sf_dir):
    """Orders' quantities as run lengths, of all sizes and differences."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda s: (s["l_partkey"] * s["l_suppkey"] % 100_003).cast("int")).alias("counts"))
    text = masks.packed_counts(F.col("counts"))
    return rows.select("l_orderkey", text.alias("text"), (masks.unpacked_counts(text) == F.col("counts")).alias("same"))


def cleaned_suppressed(spark, sf_dir):
    own = masks.cleaned_and_suppressed(cut(discs(spark, sf_dir)), grid(spark, sf_dir), 3, 0.2)
    return own.select("img", "mask", "y", "x")


def distance(spark, sf_dir):
    return rounded(masks.distance_transform(discs(spark, sf_dir), sizes(spark, sf_dir)), 6)


DISTANCE_SQL = GRID_SQL + ", ou AS (SELECT * FROM m4 WHERE NOT EXISTS (SELECT 1 FROM ms WHERE ms.img = m4.img AND ms.mask = m4.mask AND ms.y = m4.y AND ms.x = m4.x)), dt AS (SELECT ms.img, ms.mask, ms.y, ms.x, min(sqrt(((ms.y - o.y) ** 2 + (ms.x - o.x) ** 2)::DOUBLE)) AS d FROM ms JOIN ou o USING (img, mask) GROUP BY ALL)"


def error_prompts(spark, sf_dir):
    own = discs(spark, sf_dir)
    ref = own.where("mask >= 2").withColumn("mask", F.col("mask") - 1)
    return masks.error_prompts(own.where("mask <= 3"), ref, sizes(spark, sf_dir))


def inside_samples(spark, sf_dir):
    return rounded(masks.inside_samples(discs(spark, sf_dir), sizes(spark, sf_dir), 5, 3).withColumn("k", F.col("k").cast("int")), 6)


def best_candidate(spark, sf_dir):
    both = masks.overlapping_masks(discs(spark, sf_dir)).where("a = 1").select("img", F.col("b").alias("mask"), "both")
    size = masks.areas(discs(spark, sf_dir))
    rows = both.join(size.withColumnRenamed("area", "n"), ["img", "mask"]).join(size.where("mask = 1").select("img", F.col("area").alias("n_ref")), "img").withColumn("score", F.col("mask") / 10)
    return masks.best_candidate(rows)


QUERIES = {
    "mask_areas": lambda s, d: masks.areas(discs(s, d)), "painter_merge": lambda s, d: masks.painted(discs(s, d)), "painted_labels": lambda s, d: label_map(s, d), "label_map_masks": lambda s, d: masks.decomposed(label_map(s, d)), "mask_union": lambda s, d: masks.union(discs(s, d)),
    "pixel_components": components, "island_removal": islands, "hole_filling": holes, "cleaned_label_map": cleaned_map, "unchanged_masks": cleaned_once, "rle_encode": rle, "rle_decode": rle_decoded, "packed_counts": packed_counts, "line_counts": line_counts, "cleaned_suppressed": cleaned_suppressed,
    "mask_boxes": lambda s, d: masks.boxes(discs(s, d)), "mask_boxes_exclusive": lambda s, d: masks.boxes(discs(s, d), exclusive=True), "mask_iou_pairs": lambda s, d: rounded(masks.overlapping_masks(discs(s, d)), 6),
    "box_iou_pairs": box_pairs, "giou_pairs": giou_pairs, "box_formats": box_formats, "box_filters": box_filters, "nms": nms, "nms_matrix": nms_matrix, "stability_score": stability, "filtered_masks": filtered,
    "pixel_exclusive": lambda s, d: rounded(masks.exclusive(logits(s, d)), 6), "shrunk_masks": lambda s, d: masks.shrunk(logits(s, d)), "score_exclusive": lambda s, d: masks.winners_by_score(logits(s, d), masks.areas(discs(s, d)).select("img", "mask", F.col("area").alias("score"))),
    "holes_and_sprinkles": sprinkles, "mask_boundary": boundary, "boundary_f": boundary_f, "distance_transform": distance, "error_prompts": error_prompts, "inside_samples": inside_samples, "best_candidate": best_candidate, 
}
#: A list c of run lengths as text, by cases and powers.
PACK_SQL = """array_to_string(list_transform(list_transform(range(len(c)), lambda i: c[i + 1] - CASE WHEN i > 2 THEN c[i - 1] ELSE 0 END), lambda x: array_to_string(list_transform(
  range(CASE WHEN x BETWEEN -16 AND 15 THEN 1 WHEN x BETWEEN -512 AND 511 THEN 2 WHEN x BETWEEN -16384 AND 16383 THEN 3 ELSE 4 END),
  lambda k: chr((48 + (floor(x / pow(32, k))::BIGINT % 32 + 32) % 32 + CASE WHEN x BETWEEN -pow(2, 5 * k + 4) AND pow(2, 5 * k + 4) - 1 THEN 0 ELSE 32 END)::INT)), '')), '')"""
ISLAND = ", isl AS (SELECT img, mask, y, x FROM (SELECT *, first_value(c) OVER (PARTITION BY img, mask ORDER BY area DESC, c) AS top FROM msa) WHERE area >= 3 OR c = top)"
OUTSIDE = ", ou AS (SELECT * FROM m4 WHERE NOT EXISTS (SELECT 1 FROM ms WHERE ms.img = m4.img AND ms.mask = m4.mask AND ms.y = m4.y AND ms.x = m4.x))"
F_SQL = BOUNDARY_SQL + """, e AS (SELECT * FROM bd WHERE mask <= 3), r AS (SELECT img, mask - 1 AS mask, y, x FROM bd WHERE mask >= 2),
p AS (SELECT e.img, e.mask, avg(CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.img = e.img AND r.mask = e.mask AND abs(r.y - e.y) + abs(r.x - e.x) <= 1) THEN 1.0 ELSE 0.0 END) AS p FROM e GROUP BY ALL),
q AS (SELECT r.img, r.mask, avg(CASE WHEN EXISTS (SELECT 1 FROM e WHERE r.img = e.img AND r.mask = e.mask AND abs(r.y - e.y) + abs(r.x - e.x) <= 1) THEN 1.0 ELSE 0.0 END) AS r FROM r GROUP BY ALL)
SELECT img, mask, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f FROM p JOIN q USING (img, mask)"""
ORACLES = {
    "mask_areas": GRID_SQL + "SELECT * FROM ar", "painter_merge": GRID_SQL + "SELECT * FROM pa",
    "painted_labels": GRID_SQL + f"SELECT img, y, x, (CASE WHEN x < {W - 3} THEN coalesce(rank, 0) + 1 ELSE 0 END)::INT AS label FROM g LEFT JOIN pa USING (img, y, x)",
    "label_map_masks": GRID_SQL + f"SELECT img, (coalesce(rank, 0) + 1)::INT AS mask, y, x FROM g LEFT JOIN pa USING (img, y, x) WHERE x < {W - 3}",
    "mask_union": GRID_SQL + "SELECT DISTINCT img, y, x FROM ms",
    "pixel_components": GRID_SQL + COMPONENTS.format(p="ms") + " SELECT * FROM msa",
    # a mask stays as it is if it has no hole to fill and, with that, no island to lose
    "unchanged_masks": GRID_SQL + OUTSIDE + COMPONENTS.format(p="ms") + ISLAND + COMPONENTS.format(p="ou") + " SELECT img, mask, (NOT EXISTS (SELECT 1 FROM oua WHERE oua.img = ms.img AND oua.mask = ms.mask AND area < 3) AND count(*) = (SELECT count(*) FROM isl WHERE isl.img = ms.img AND isl.mask = ms.mask))::INT AS score FROM ms GROUP BY img, mask",
    "island_removal": GRID_SQL + COMPONENTS.format(p="ms") + ISLAND + " SELECT * FROM isl",
    "hole_filling": GRID_SQL + OUTSIDE + COMPONENTS.format(p="ou") + " SELECT * FROM ms UNION ALL SELECT img, mask, y, x FROM oua WHERE area < 3",
    "packed_counts": f"SELECT img, mask, {PACK_SQL} AS text, counts, area FROM (SELECT *, list_transform(string_split(counts, ','), lambda v: v::BIGINT) AS c FROM ({RLE_SQL}))",
    "line_counts": f"SELECT l_orderkey, {PACK_SQL} AS text, true AS same FROM (SELECT l_orderkey, list((l_partkey * l_suppkey % 100003)::BIGINT ORDER BY l_linenumber, l_partkey, l_suppkey) AS c FROM lineitem GROUP BY l_orderkey)",
    "rle_encode": RLE_SQL, "rle_decode": GRID_SQL + "SELECT * FROM ms",
    "mask_boxes": GRID_SQL + "SELECT img, mask, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM ms GROUP BY ALL",
    "mask_boxes_exclusive": GRID_SQL + "SELECT img, mask, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM ms GROUP BY ALL",
    "mask_iou_pairs": GRID_SQL + ", p AS (SELECT a.img, a.mask AS a, b.mask AS b, count(*) AS both_in FROM ms a JOIN ms b ON a.img = b.img AND a.y = b.y AND a.x = b.x AND a.mask < b.mask GROUP BY ALL) SELECT p.img, p.a, p.b, both_in AS both, round(both_in / greatest(x.area + y.area - both_in, 1), 6) AS iou, round(both_in / (least(x.area, y.area) + 1e-8), 6) AS iom FROM p JOIN ar x ON x.img = p.img AND x.mask = p.a JOIN ar y ON y.img = p.img AND y.mask = p.b",
    "box_iou_pairs": BOX_SQL + " SELECT img, a, b, round(i / (s - i), 12) AS iou FROM p WHERE i / (s - i) > 0.1",
    "giou_pairs": BOX_SQL + " SELECT img, a, b, round(i / (s - i) - (h - (s - i)) / h, 12) AS giou FROM (SELECT *, (greatest(ax1, bx1) - least(ax0, bx0)) * (greatest(ay1, by1) - least(ay0, by0)) AS h FROM p)",
    "box_formats": BOX_SQL + " SELECT img, id, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in [("xywh_0", "x0"), ("xywh_1", "y0"), ("xywh_2", "x1 - x0"), ("xywh_3", "y1 - y0"), ("cxcywh_0", "(x0 + x1) / 2"), ("cxcywh_1", "(y0 + y1) / 2"), ("cxcywh_2", "x1 - x0"), ("cxcywh_3", "y1 - y0")] + [(f"{t}_back_{i}", c) for t in ("xywh", "cxcywh") for i, c in enumerate(("x0", "y0", "x1", "y1"))]) + " FROM b",
    "box_filters": BOX_SQL + " SELECT img, id, " + " OR ".join(f"(abs({c} - {k}) <= 2 AND abs({c} - {i}) > 2)" for c, k, i in (("x0", 5, 0), ("y0", 5, 0), ("x1", 40, 80), ("y1", 30, 80))) + " AS edge, " + " OR ".join(f"({c}0 / 80 + {c}1 / 80) / 2 < 0.2::DOUBLE OR ({c}0 / 80 + {c}1 / 80) / 2 > 1 - 0.2::DOUBLE" for c in "xy") + " AS border FROM b",
    "nms": NMS_SQL, "nms_matrix": NMS_SQL,
    "stability_score": GRID_SQL + "SELECT img, mask, round(count(*) FILTER (logit > 1.0) / count(*) FILTER (logit > -1.0), 6) AS score, round(count(*) FILTER (logit > 0.0) / count(*) FILTER (logit > -1.0), 6) AS other FROM lg GROUP BY ALL",
    "filtered_masks": GRID_SQL + "SELECT ar.img, ar.mask FROM ar JOIN (SELECT img, mask, count(*) FILTER (logit > 1.0) / count(*) FILTER (logit > -1.0) AS s FROM lg GROUP BY ALL) USING (img, mask) WHERE ar.mask / 5 > 0.4::DOUBLE AND s >= 0.5 AND area >= 60",
    "pixel_exclusive": GRID_SQL + "SELECT img, mask, y, x, round(CASE WHEN row_number() OVER (PARTITION BY img, y, x ORDER BY logit DESC, mask) = 1 THEN logit ELSE least(logit, -10.0) END, 6) AS logit FROM lg",
    "shrunk_masks": GRID_SQL + ", x AS (SELECT *, row_number() OVER (PARTITION BY img, y, x ORDER BY logit DESC, mask) AS r FROM lg) SELECT img, mask, count(*) AS before, count(*) FILTER (r = 1) AS after, count(*) FILTER (r = 1) < 0.3::DOUBLE * count(*) AS suppressed FROM x WHERE logit > 0 GROUP BY ALL",
    "score_exclusive": GRID_SQL + "SELECT img, mask, y, x FROM (SELECT lg.*, row_number() OVER (PARTITION BY lg.img, y, x ORDER BY area DESC, lg.mask) AS r FROM lg JOIN ar USING (img, mask) WHERE logit > 0) WHERE r = 1",
    "holes_and_sprinkles": SPRINKLE_SQL,
    "mask_boundary": BOUNDARY_SQL + " SELECT * FROM bd", "boundary_f": F_SQL,
    "distance_transform": DISTANCE_SQL + " SELECT img, mask, y, x, round(d, 6) AS d FROM dt",
    "error_prompts": GRID_SQL + """, e AS (SELECT * FROM ms WHERE mask <= 3), r AS (SELECT img, (mask - 1)::INT AS mask, y, x FROM ms WHERE mask >= 2),
d AS (SELECT *, 1 AS pos FROM (SELECT * FROM r EXCEPT SELECT * FROM e) UNION ALL SELECT *, 0 FROM (SELECT * FROM e EXCEPT SELECT * FROM r)),
o AS (SELECT m4.*, p.pos FROM m4, (VALUES (0), (1)) p(pos) WHERE mask <= 3 AND NOT EXISTS (SELECT 1 FROM d WHERE d.img = m4.img AND d.mask = m4.mask AND d.y = m4.y AND d.x = m4.x AND d.pos = p.pos)),
q AS (SELECT d.img, d.mask, d.y, d.x, d.pos, min((d.y - o.y) ** 2 + (d.x - o.x) ** 2) AS dd FROM d JOIN o USING (img, mask, pos) GROUP BY ALL)
SELECT img, mask, y, x, pos = 1 AS positive FROM (SELECT *, row_number() OVER (PARTITION BY img, mask ORDER BY dd DESC, pos DESC, y, x) AS r FROM q) WHERE r = 1""",
    "inside_samples": GRID_SQL + f", s AS (SELECT *, row_number() OVER (PARTITION BY img, mask ORDER BY md5('3|' || img || '|' || mask || '|' || y || '|' || x)) AS r FROM ms) SELECT img, mask, (row_number() OVER (PARTITION BY img, mask ORDER BY x, y) - 1)::INT AS k, round(x / {W - 1}, 6) AS sx, round(y / {H - 1}, 6) AS sy FROM s WHERE r <= 5",
    "best_candidate": GRID_SQL + ", p AS (SELECT a.img, b.mask, count(*) AS n FROM ms a JOIN ms b ON a.img = b.img AND a.y = b.y AND a.x = b.x AND a.mask = 1 AND b.mask > 1 GROUP BY ALL), q AS (SELECT p.img, p.mask, n / (x.area + y.area - n) AS iou FROM p JOIN ar x ON x.img = p.img AND x.mask = 1 JOIN ar y ON y.img = p.img AND y.mask = p.mask) SELECT img, mask FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY iou DESC, mask) AS r FROM q) WHERE r = 1",
}
