"""Queries of face graphs, labels, geometry and cuts on generated grids, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.operators import geometry, labels, mincut
from facetflow.plans.analogues import NUMBERS_SQL, each, numbered, table
from facetflow.plans.lifting_queries import rounded
from facetflow.session import cut

N, M, MESHES = 8, 9, 3  # rows and columns of a mesh; meshes that pixels are of


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of (N + 1) x (M + 1) vertices; heights come from an arithmetic hash, so sides have angles."""
    i, j = F.expr(f"id div {M + 1}"), F.expr(f"id % {M + 1}")
    rows = each(numbered(spark, sf_dir, "mesh"), "id", 0, (N + 1) * (M + 1) - 1).select("mesh", i.cast("int").alias("i"), j.cast("int").alias("j"))
    return rows.select("mesh", (F.col("i") * (M + 1) + F.col("j")).alias("v"), F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), (F.pmod(F.col("i") * 37 + F.col("j") * 91 + F.col("mesh") * 17, F.lit(11)) / 10.0).alias("z"))


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = each(numbered(spark, sf_dir, "mesh"), "f", 0, N * M - 1)
    a = F.expr(f"f div {M}") * (M + 1) + F.expr(f"f % {M}")
    return rows.select("mesh", "f", F.array(*[(a + k).cast("int") for k in (0, 1, M + 2, M + 1)]).alias("v"))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two triangles a quad, 2 q and 2 q + 1."""
    return geometry.triangles(quads(spark, sf_dir)).select("mesh", F.col("tri").cast("int").alias("f"), "v")


def face_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches with specks of other labels; a tenth of the faces has none, some have 0."""
    q, noise = F.expr("f div 2"), F.pmod(F.col("f") * 7919 + F.col("mesh") * 31, F.lit(23))
    patch = 1 + F.expr(f"(f div 2) div {M} div 3") * 2 + F.expr(f"(f div 2) % {M} div 5")
    label = F.when(noise.isin(1, 2), 5).when(noise == 3, 0).otherwise(patch)
    return faces(spark, sf_dir).where(~noise.isin(7, 8)).select("mesh", "f", label.cast("int").alias("label"), q.alias("q")).drop("q")


GRID_SQL = f"""WITH RECURSIVE vt AS (SELECT m::INT AS mesh, (i * {M + 1} + j)::INT AS v, i::DOUBLE AS x, j::DOUBLE AS y, ((i * 37 + j * 91 + m * 17) % 11) / 10.0::DOUBLE AS z FROM {NUMBERS_SQL} a(m), range({N + 1}) b(i), range({M + 1}) c(j)),
qd AS (SELECT m::INT AS mesh, q::INT AS f, ((q // {M}) * {M + 1} + q % {M})::INT AS a FROM {NUMBERS_SQL} a(m), range({N * M}) b(q)),
fc AS (SELECT mesh, 2 * f AS f, [a, a + 1, a + {M + 2}] AS v FROM qd UNION ALL SELECT mesh, 2 * f + 1, [a, a + {M + 2}, a + {M + 1}] FROM qd),
nz AS (SELECT mesh, f, (f * 7919 + mesh * 31) % 23 AS k FROM fc),
lb AS (SELECT mesh, f, (CASE WHEN k IN (1, 2) THEN 5 WHEN k = 3 THEN 0 ELSE 1 + ((f // 2) // {M} // 3) * 2 + ((f // 2) % {M}) // 5 END)::INT AS label FROM nz WHERE k NOT IN (7, 8)),
ed AS (SELECT mesh, f, least(v[1], v[2]) AS a, greatest(v[1], v[2]) AS b FROM fc UNION SELECT mesh, f, least(v[2], v[3]), greatest(v[2], v[3]) FROM fc UNION SELECT mesh, f, least(v[1], v[3]), greatest(v[1], v[3]) FROM fc),
pr AS (SELECT mesh, min(f) AS s, max(f) AS t FROM ed GROUP BY mesh, a, b HAVING count(*) = 2),
adj AS (SELECT DISTINCT mesh, s AS src, t AS dst FROM pr UNION SELECT mesh, t, s FROM pr),
reach AS (SELECT mesh, f, label, f AS comp FROM lb UNION SELECT r.mesh, d.f, r.label, r.comp FROM reach r JOIN adj ON adj.mesh = r.mesh AND adj.src = r.f JOIN lb d ON d.mesh = adj.mesh AND d.f = adj.dst AND d.label = r.label),
cmp AS (SELECT mesh, f, label, min(comp) AS comp FROM reach GROUP BY ALL),
pt AS (SELECT fc.mesh, fc.f, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM fc JOIN vt a ON a.mesh = fc.mesh AND a.v = fc.v[1] JOIN vt b ON b.mesh = fc.mesh AND b.v = fc.v[2] JOIN vt c ON c.mesh = fc.mesh AND c.v = fc.v[3]),
cr AS (SELECT mesh, f, (ax + bx + cx) / 3 AS mx, (ay + by_ + cy) / 3 AS my, (az + bz + cz) / 3 AS mz, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS ux, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS uy, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS uz FROM pt),
sh AS (SELECT mesh, f, sqrt(ux * ux + uy * uy + uz * uz) / 2 AS area, mx AS cx, my AS cy, mz AS cz, ux / sqrt(ux * ux + uy * uy + uz * uz) AS nx, uy / sqrt(ux * ux + uy * uy + uz * uz) AS ny, uz / sqrt(ux * ux + uy * uy + uz * uz) AS nz FROM cr),
an AS (SELECT DISTINCT pr.mesh, s AS src, t AS dst, acos(least(greatest(p.nx * q.nx + p.ny * q.ny + p.nz * q.nz, -1.0), 1.0)) AS angle FROM pr JOIN sh p ON p.mesh = pr.mesh AND p.f = s JOIN sh q ON q.mesh = pr.mesh AND q.f = t)
"""


def shapes(spark, sf_dir):
    return geometry.face_shapes(faces(spark, sf_dir), vertices(spark, sf_dir))


def sides(spark, sf_dir):
    return geometry.side_angles(faces(spark, sf_dir), shapes(spark, sf_dir))


def _parts(spark, sf_dir):
    return labels.label_components(face_labels(spark, sf_dir), labels.adjacency(faces(spark, sf_dir)))


def split_labels(spark, sf_dir):
    return labels.split(_parts(spark, sf_dir))


def small_component_drop(spark, sf_dir):
    return labels.without_small(_parts(spark, sf_dir), shapes(spark, sf_dir).select("mesh", "f", "area"), 0.2, 0.2)


def hole_fill(spark, sf_dir):
    return labels.fill_holes(face_labels(spark, sf_dir), labels.adjacency(faces(spark, sf_dir)), 3)


def hole_fill_rest(spark, sf_dir):
    few = face_labels(spark, sf_dir).where("label = 5")
    return labels.fill_rest(few, faces(spark, sf_dir))


def smoothed(spark, sf_dir):
    """The chain: drop small components, fill holes, fill the rest, split."""
    adjacent = cut(labels.adjacency(faces(spark, sf_dir)))
    kept = labels.without_small(labels.label_components(face_labels(spark, sf_dir), adjacent), shapes(spark, sf_dir).select("mesh", "f", "area"), 0.05, 0.05)
    full = cut(labels.fill_rest(labels.fill_holes(kept, adjacent), faces(spark, sf_dir)))
    return labels.split(labels.label_components(full, adjacent))


def submesh_faces(spark, sf_dir):
    return labels.submeshes(faces(spark, sf_dir), face_labels(spark, sf_dir))[0].select("mesh", "label", "f", F.array_join("v", ",").alias("v"))


def submesh_vertices(spark, sf_dir):
    return labels.submeshes(faces(spark, sf_dir), face_labels(spark, sf_dir))[1]


def label_energy(spark, sf_dir):
    start = labels.fill_rest(face_labels(spark, sf_dir), faces(spark, sf_dir))
    other = start.withColumn("label", F.when(F.col("f") % 5 == 0, 1).otherwise(F.col("label")))
    return rounded(labels.energy(other, start, sides(spark, sf_dir)), 6)


ENERGY_SQL = GRID_SQL + """, st AS (SELECT fc.mesh, fc.f, coalesce(label, 0) AS label FROM fc LEFT JOIN lb USING (mesh, f)), ot AS (SELECT mesh, f, CASE WHEN f % 5 = 0 THEN 1 ELSE label END AS label FROM st),
dt AS (SELECT mesh, sum((ot.label <> st.label)::INT)::DOUBLE AS data FROM ot JOIN st USING (mesh, f) GROUP BY mesh),
sm AS (SELECT an.mesh, sum(-ln(angle / pi() + 1e-20) * 6) AS smooth FROM an JOIN ot p ON p.mesh = an.mesh AND p.f = src JOIN ot q ON q.mesh = an.mesh AND q.f = dst WHERE p.label <> q.label GROUP BY an.mesh)
SELECT mesh, data, round(smooth, 6) AS smooth, round(data + smooth, 6) AS energy FROM dt JOIN sm USING (mesh)"""


def cut_graph(spark, sf_dir):
    start = cut(labels.fill_rest(face_labels(spark, sf_dir), faces(spark, sf_dir)))
    costs = cut(sides(spark, sf_dir).select("mesh", "src", "dst", labels.smoothness(F.col("angle")).alias("cost")))
    return mincut.expansion_graph(start, start, costs, 1).groupBy("mesh").agg(F.count("*").alias("arcs"), F.count_if(F.col("u") == "S").alias("from_s"), F.count_if(F.col("v") == "T").alias("to_t"), F.count_if(F.col("cap") == float("inf")).alias("fixed"))


CUT_SQL = GRID_SQL + """, st AS (SELECT fc.mesh, fc.f, coalesce(label, 0) AS label FROM fc LEFT JOIN lb USING (mesh, f)),
e AS (SELECT an.mesh, p.label AS l1, q.label AS l2 FROM an JOIN st p ON p.mesh = an.mesh AND p.f = src JOIN st q ON q.mesh = an.mesh AND q.f = dst),
k AS (SELECT mesh, count(*) FILTER (l1 = l2) AS same, count(*) FILTER (l1 <> l2) AS diff FROM e GROUP BY mesh), n AS (SELECT mesh, count(*) AS n, count(*) FILTER (label = 1) AS ones FROM st GROUP BY mesh)
SELECT mesh, 2 * n + 2 * same + 5 * diff AS arcs, n AS from_s, n + diff AS to_t, ones AS fixed FROM k JOIN n USING (mesh)"""


def refined_labels(spark, sf_dir):
    """Whether the refined labels' energy is at most the initial one's."""
    start = cut(labels.fill_rest(face_labels(spark, sf_dir), faces(spark, sf_dir)))
    ends = cut(sides(spark, sf_dir))
    costs = ends.select("mesh", "src", "dst", labels.smoothness(F.col("angle"), 0.3).alias("cost"))
    after = labels.energy(mincut.refined(start, costs), start, ends, 0.3).select("mesh", F.col("energy").alias("after"))
    before = labels.energy(start, start, ends, 0.3).select("mesh", F.col("energy").alias("before"))
    return before.join(after, "mesh").select("mesh", (F.col("after") <= F.col("before") + 1e-9).alias("no_worse"), (F.col("after") < F.col("before") - 1e-9).alias("better"))


def refined_to_target(spark, sf_dir):
    """Labels refined by that one of eight weights that leaves about six of more than ten faces: how many are left, and faces that kept their label."""
    start = cut(labels.fill_rest(face_labels(spark, sf_dir), faces(spark, sf_dir)))
    costs = cut(sides(spark, sf_dir).select("mesh", "src", "dst", labels.smoothness(F.col("angle"), 1.0).alias("cost")))
    found = mincut.refined_to(start, costs, [0.02 * 2**i for i in range(8)], 6, seed=0.1)
    own = found.join(start.withColumnRenamed("label", "was"), ["mesh", "f"])
    return own.groupBy("mesh", "weight").agg(F.count_distinct("label").alias("labels"), F.count_if(F.col("label") == F.col("was")).alias("kept"))


def weight_grid(spark, sf_dir):
    rows = numbered(spark, sf_dir, "mesh").withColumn("weight", F.explode(F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: i.cast("double"))))
    return rows.withColumn("labels", (40 - 2 * F.col("weight") - F.col("mesh") % 3).cast("int"))


WEIGHT_SQL = f"WITH w AS (SELECT m::INT AS mesh, (i + 1)::DOUBLE AS weight, (40 - 2 * (i + 1) - m % 3)::INT AS labels FROM {NUMBERS_SQL} a(m), range(15) b(i))"


def closest_weight(spark, sf_dir):
    return labels.closest_weight(weight_grid(spark, sf_dir), 21)


def crawled_weight(spark, sf_dir):
    return labels.crawled_weight(weight_grid(spark, sf_dir), 21)


def remapped_pixels(spark, sf_dir):
    tri_map = geometry.triangles(quads(spark, sf_dir)).select("mesh", F.col("tri").cast("int").alias("tri"), "f")
    pixels = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % MESHES).cast("int").alias("mesh"), F.col("l_orderkey").alias("px"), F.col("l_linenumber").alias("py"), (F.col("l_partkey") % 170 - 1).cast("int").alias("f"))
    return geometry.remapped(pixels, tri_map)


def polygon_areas(spark, sf_dir):
    return rounded(geometry.face_shapes(quads(spark, sf_dir), vertices(spark, sf_dir)).select("mesh", "f", "area"), 6)


POLYGON_SQL = GRID_SQL + f", tr AS (SELECT mesh, f // 2 AS f, area FROM sh) SELECT mesh, f, round(sum(area), 6) AS area FROM tr GROUP BY ALL"


def vertex_means(spark, sf_dir):
    values = faces(spark, sf_dir).select("mesh", "f", F.pmod(F.col("f") * 13, F.lit(7)).cast("double").alias("value"))
    return rounded(geometry.face_to_vertex(values, faces(spark, sf_dir), scaled=True), 6)


def pixel_values(spark, sf_dir):
    values = faces(spark, sf_dir).select("mesh", "f", F.pmod(F.col("f") * 13, F.lit(7)).cast("double").alias("value"))
    at_vertices = geometry.face_to_vertex(values, faces(spark, sf_dir))
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_discount", "l_tax")])
    w = F.array(F.col("l_discount"), F.col("l_tax"), 1 - F.col("l_discount") - F.col("l_tax"))
    pixels = line.select((F.col("l_orderkey") % MESHES).cast("int").alias("mesh"), F.lit(0).alias("view"), F.col("l_orderkey").alias("py"), F.col("l_linenumber").alias("px"), (F.col("l_partkey") % 150 - 6).cast("int").alias("f"), w.alias("w"))
    return rounded(geometry.at_pixels(pixels, faces(spark, sf_dir), at_vertices), 6)


def cut_vertices(spark, sf_dir):
    return geometry.cut_vertices(faces(spark, sf_dir), labels.fill_rest(face_labels(spark, sf_dir), faces(spark, sf_dir)))


def average_radius(spark, sf_dir):
    return rounded(geometry.average_radius(shapes(spark, sf_dir)), 6)


def cut_discrepancy(spark, sf_dir):
    est = faces(spark, sf_dir).select("mesh", "f", F.expr(f"(f div 2) div {M} div 4").alias("label"))
    ref = faces(spark, sf_dir).select("mesh", "f", F.expr(f"(f div 2) % {M} div 5").alias("label"))
    return rounded(geometry.cut_discrepancy(cut(faces(spark, sf_dir)), cut(vertices(spark, sf_dir)), est, ref), 6)


CUT_DISCREPANCY_SQL = GRID_SQL + f""", e1 AS (SELECT mesh, f, (f // 2) // {M} // 4 AS label FROM fc), e2 AS (SELECT mesh, f, ((f // 2) % {M}) // 5 AS label FROM fc),
c1 AS (SELECT DISTINCT mesh, unnest([a, b]) AS v FROM (SELECT ed.mesh, a, b FROM ed JOIN e1 USING (mesh, f) GROUP BY ALL HAVING count(*) = 2 AND min(label) <> max(label))),
c2 AS (SELECT DISTINCT mesh, unnest([a, b]) AS v FROM (SELECT ed.mesh, a, b FROM ed JOIN e2 USING (mesh, f) GROUP BY ALL HAVING count(*) = 2 AND min(label) <> max(label))),
sd0 AS (SELECT DISTINCT ed.mesh, a, b, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) AS len FROM ed JOIN vt p ON p.mesh = ed.mesh AND p.v = a JOIN vt q ON q.mesh = ed.mesh AND q.v = b),
sd AS (SELECT mesh, a AS s, b AS t, len FROM sd0 UNION ALL SELECT mesh, b, a, len FROM sd0),
w1 AS (SELECT mesh, v, 0.0::DOUBLE AS d, 0 AS k FROM c1 UNION ALL SELECT mesh, v, min(d) AS d, k FROM (SELECT sd.mesh, t AS v, d + len AS d, k + 1 AS k FROM w1 JOIN sd ON sd.mesh = w1.mesh AND sd.s = w1.v WHERE k < 14) GROUP BY mesh, v, k),
w2 AS (SELECT mesh, v, 0.0::DOUBLE AS d, 0 AS k FROM c2 UNION ALL SELECT mesh, v, min(d) AS d, k FROM (SELECT sd.mesh, t AS v, d + len AS d, k + 1 AS k FROM w2 JOIN sd ON sd.mesh = w2.mesh AND sd.s = w2.v WHERE k < 14) GROUP BY mesh, v, k),
d1 AS (SELECT mesh, v, min(d) AS d FROM w1 GROUP BY ALL), d2 AS (SELECT mesh, v, min(d) AS d FROM w2 GROUP BY ALL),
su AS (SELECT mesh, sum(d) AS d, count(*) AS n FROM (SELECT c1.mesh, d FROM c1 JOIN d2 ON d2.mesh = c1.mesh AND d2.v = c1.v UNION ALL SELECT c2.mesh, d FROM c2 JOIN d1 ON d1.mesh = c2.mesh AND d1.v = c2.v) GROUP BY mesh),
ce AS (SELECT mesh, sum(area * cx) / sum(area) AS x, sum(area * cy) / sum(area) AS y, sum(area * cz) / sum(area) AS z FROM sh GROUP BY mesh),
ra AS (SELECT sh.mesh, sum(area * sqrt((cx - x) ** 2 + (cy - y) ** 2 + (cz - z) ** 2)) / sum(area) AS radius FROM sh JOIN ce USING (mesh) GROUP BY sh.mesh)
SELECT mesh, round(d / n / radius, 6) AS value FROM su JOIN ra USING (mesh)"""


def vertex_distances(spark, sf_dir):
    sides_ = cut(geometry.side_lengths(faces(spark, sf_dir), vertices(spark, sf_dir)))
    return rounded(geometry.distances(vertices(spark, sf_dir).where("v % 30 = 0").select("mesh", "v"), sides_), 6)


DISTANCES_SQL = GRID_SQL + """, sd0 AS (SELECT DISTINCT ed.mesh, a, b, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) AS len FROM ed JOIN vt p ON p.mesh = ed.mesh AND p.v = a JOIN vt q ON q.mesh = ed.mesh AND q.v = b),
sd AS (SELECT mesh, a AS s, b AS t, len FROM sd0 UNION ALL SELECT mesh, b, a, len FROM sd0),
w1 AS (SELECT mesh, v, 0.0::DOUBLE AS d, 0 AS k FROM vt WHERE v % 30 = 0 UNION ALL SELECT mesh, v, min(d) AS d, k FROM (SELECT sd.mesh, t AS v, d + len AS d, k + 1 AS k FROM w1 JOIN sd ON sd.mesh = w1.mesh AND sd.s = w1.v WHERE k < 18) GROUP BY mesh, v, k)
SELECT mesh, v, round(min(d), 6) AS d FROM w1 GROUP BY ALL"""


def bbox(spark, sf_dir):
    return rounded(geometry.bounding_box(vertices(spark, sf_dir)), 6)


def bbox_normalised(spark, sf_dir):
    return rounded(geometry.normalised(vertices(spark, sf_dir)), 6)


def diameter_scale(spark, sf_dir):
    values = faces(spark, sf_dir).select("mesh", "f", F.when(F.col("f") % 9 == 0, F.lit(float("nan"))).otherwise(F.pmod(F.col("f") * 13, F.lit(7)).cast("double")).alias("value"))
    return rounded(geometry.diameter_scale(values), 6)


def posed(spark, sf_dir):
    pose = F.array(*[F.lit(float(v)) for v in (0, -1, 0, 2, 1, 0, 0, 3, 0, 0, 1, -1, 0, 0, 0, 1)])
    return rounded(geometry.transformed(vertices(spark, sf_dir), pose), 6)


def rounding(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.discretised(F.col("l_quantity"), 0.0, 50.0, 11).alias("i"))
    return rows.withColumn("back", geometry.undiscretised(F.col("i"), 0.0, 50.0, 11))


def decimation(spark, sf_dir):
    goal, share = geometry.decimation_target(F.col("p_size"), ratio=0.3)
    return rounded(table(spark, sf_dir, "part").select("p_partkey", goal.alias("goal"), share.alias("share")), 6)


def sampled_points(spark, sf_dir):
    """Samples of each triangle lie on its plane: barycentric means of its corners; counted by face."""
    return geometry.surface_samples(faces(spark, sf_dir), vertices(spark, sf_dir), 4).groupBy("mesh", "f").agg(F.count("*").alias("n"), F.count_if((F.col("x") >= 0) & (F.col("x") <= N) & (F.col("y") >= 0) & (F.col("y") <= M)).alias("inside"))


def box_corners(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(geometry.box_corners([F.lit(1.0), F.lit(2.0), F.lit(3.0)], [F.col("p_size") / 10.0, F.lit(2.0), F.lit(4.0)], F.lit(0.0))).alias("c"))
    return rounded(rows.groupBy("p_partkey").agg(F.min("c.x").alias("x0"), F.max("c.x").alias("x1"), F.min("c.y").alias("y0"), F.max("c.y").alias("y1"), F.min("c.z").alias("z0"), F.max("c.z").alias("z1")), 6)


def label_colours(spark, sf_dir):
    rows = face_labels(spark, sf_dir).select("mesh", "f", labels.colours(F.col("label")).alias("c"))
    return rows.select("mesh", "f", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate("rgb")])


QUERIES = {
    "grid_adjacency": lambda s, d: labels.adjacency(faces(s, d)), "ngon_adjacency": lambda s, d: labels.adjacency(quads(s, d), "all"), "face_components": lambda s, d: _parts(s, d),
    "small_component_drop": small_component_drop, "hole_fill": hole_fill, "hole_fill_rest": hole_fill_rest, "split_labels": split_labels, "smoothed_labels": smoothed, "label_counts": lambda s, d: labels.counts(face_labels(s, d)), "dense_relabel": lambda s, d: labels.dense(face_labels(s, d)),
    "label_colours": label_colours, "submesh_faces": submesh_faces, "submesh_vertices": submesh_vertices, "label_energy": label_energy, "cut_graph": cut_graph, "refined_labels": refined_labels, "refined_to_target": refined_to_target, "closest_weight": closest_weight, "crawled_weight": crawled_weight,
    "remapped_pixels": remapped_pixels, "polygon_areas": polygon_areas, "face_shapes": lambda s, d: rounded(shapes(s, d), 6), "side_angles": lambda s, d: rounded(sides(s, d), 6), "dihedral_max": lambda s, d: rounded(geometry.sharpest(sides(s, d), faces(s, d)), 6),
    "face_to_vertex": vertex_means, "bary_interp": pixel_values, "cut_vertices": cut_vertices, "average_radius": average_radius, "cut_discrepancy": cut_discrepancy, "vertex_distances": vertex_distances, "bounding_box": bbox, "bbox_normalise": bbox_normalised,
    "diameter_scale": diameter_scale, "posed_points": posed, "range_norm": rounding, "decimation_target": decimation, "surface_samples": sampled_points, "box_corners": box_corners,
}
FILL_SQL = GRID_SQL
for _k in range(3):
    _was = "lb" if _k == 0 else f"h{_k - 1}"
    FILL_SQL += f""", n{_k} AS (SELECT adj.mesh, adj.src AS f, o.label, count(*) AS n FROM adj JOIN {_was} o ON o.mesh = adj.mesh AND o.f = adj.dst WHERE o.label <> 0 AND NOT EXISTS (SELECT 1 FROM {_was} w WHERE w.mesh = adj.mesh AND w.f = adj.src) GROUP BY ALL),
    h{_k} AS (SELECT mesh, f, label FROM {_was} UNION ALL SELECT mesh, f, label FROM (SELECT *, row_number() OVER (PARTITION BY mesh, f ORDER BY n DESC, label) AS r FROM n{_k}) WHERE r = 1)"""
SPLIT_TAIL = """, k AS (SELECT mesh, label, comp, label <> 0 AND row_number() OVER (PARTITION BY mesh, label ORDER BY comp) = 1 AS keeps FROM (SELECT DISTINCT mesh, label, comp FROM {c})),
    s AS (SELECT mesh, comp, CASE WHEN keeps THEN label ELSE max(label) OVER (PARTITION BY mesh) + sum((NOT keeps)::INT) OVER (PARTITION BY mesh ORDER BY comp) END::BIGINT AS label FROM k)
    SELECT c.mesh, c.f, s.label FROM {c} c JOIN s ON s.mesh = c.mesh AND s.comp = c.comp"""
SMALL_SQL = ", q AS (SELECT mesh, comp, count(*) AS n, sum(area) AS a FROM cmp JOIN sh USING (mesh, f) GROUP BY ALL), mx AS (SELECT mesh, max(n) AS mn, max(a) AS ma FROM q GROUP BY mesh), bad AS (SELECT mesh, comp FROM q JOIN mx USING (mesh) WHERE n < {t} * mn AND a < {t} * ma)"
VERTEX_SQL = GRID_SQL + ", fv AS (SELECT mesh, unnest(v) AS v, ((f * 13) % 7)::DOUBLE AS value FROM fc), vm AS (SELECT mesh, v, avg(value) AS value FROM fv GROUP BY ALL)"
ORACLES = {
    "grid_adjacency": GRID_SQL + "SELECT * FROM adj",
    "ngon_adjacency": f"WITH q AS (SELECT m::INT AS mesh, i, j, (i * {M} + j)::INT AS f FROM {NUMBERS_SQL} a(m), range({N}) b(i), range({M}) c(j)) SELECT p.mesh, p.f AS src, q.f AS dst FROM q p JOIN q ON q.mesh = p.mesh AND abs(p.i - q.i) + abs(p.j - q.j) = 1",
    "face_components": GRID_SQL + "SELECT mesh, f, label, comp FROM cmp",
    "small_component_drop": GRID_SQL + SMALL_SQL.format(t=0.2) + " SELECT mesh, f, label, comp FROM cmp WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.mesh = cmp.mesh AND bad.comp = cmp.comp)",
    "hole_fill": FILL_SQL + " SELECT * FROM h2",
    "hole_fill_rest": GRID_SQL + "SELECT fc.mesh, fc.f, coalesce(label, 0) AS label FROM fc LEFT JOIN (SELECT * FROM lb WHERE label = 5) USING (mesh, f)",
    "split_labels": GRID_SQL + SPLIT_TAIL.format(c="cmp"),
    "label_counts": GRID_SQL + "SELECT mesh, label, count(*) AS n FROM lb GROUP BY ALL",
    "dense_relabel": GRID_SQL + "SELECT mesh, f, (dense_rank() OVER (PARTITION BY mesh ORDER BY label) - 1)::INT AS label FROM lb",
    "label_colours": GRID_SQL + "SELECT mesh, f, " + ", ".join(f"(CASE WHEN label = 0 THEN 0 ELSE (label * {k} + {k // 7}) % 256 END)::INT AS {n}" for k, n in ((97, "r"), (57, "g"), (193, "b"))) + " FROM lb",
    "submesh_faces": GRID_SQL + ", co AS (SELECT fc.mesh, label, f, unnest(v) AS old, generate_subscripts(v, 1) AS p FROM fc JOIN lb USING (mesh, f)), nw AS (SELECT *, dense_rank() OVER (PARTITION BY mesh, label ORDER BY old) - 1 AS v FROM co) SELECT mesh, label, f, string_agg(v::VARCHAR, ',' ORDER BY p) AS v FROM nw GROUP BY mesh, label, f",
    "submesh_vertices": GRID_SQL + ", co AS (SELECT DISTINCT mesh, label, unnest(v) AS old FROM fc JOIN lb USING (mesh, f)) SELECT mesh, label, (row_number() OVER (PARTITION BY mesh, label ORDER BY old) - 1)::INT AS v, old FROM co",
    "label_energy": ENERGY_SQL,
    "cut_graph": CUT_SQL,
    "closest_weight": WEIGHT_SQL + " SELECT mesh, arg_min(weight, abs(labels - 21) * 1000 + weight) AS weight FROM w GROUP BY mesh",
    "crawled_weight": WEIGHT_SQL + " SELECT mesh, min(weight) AS weight FROM w WHERE weight >= 6 AND abs(labels - 21) <= 1 GROUP BY mesh",
    "remapped_pixels": f"SELECT (l_orderkey % {MESHES})::INT AS mesh, l_orderkey AS px, l_linenumber AS py, (CASE WHEN l_partkey % 170 = 0 THEN -1 ELSE least(l_partkey % 170 - 1, {2 * N * M - 1}) // 2 END)::INT AS f FROM lineitem",
    "polygon_areas": POLYGON_SQL,
    "face_shapes": GRID_SQL + "SELECT mesh, f, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("area", "cx", "cy", "cz", "nx", "ny", "nz")) + " FROM sh",
    "side_angles": GRID_SQL + "SELECT mesh, src, dst, round(angle, 6) AS angle FROM an",
    "dihedral_max": GRID_SQL + "SELECT fc.mesh, fc.f, round(coalesce(max(angle) / pi(), 0), 6) AS value FROM fc LEFT JOIN an ON an.mesh = fc.mesh AND (an.src = fc.f OR an.dst = fc.f) GROUP BY ALL",
    "face_to_vertex": VERTEX_SQL + " SELECT mesh, v, round((value - min(value) OVER (PARTITION BY mesh)) / (max(value) OVER (PARTITION BY mesh) - min(value) OVER (PARTITION BY mesh)), 6) AS value FROM vm",
    "bary_interp": VERTEX_SQL + f", px AS (SELECT (l_orderkey % {MESHES})::INT AS mesh, l_orderkey AS py, l_linenumber AS px, (l_partkey % 150 - 6)::INT AS f, [l_discount, l_tax, 1 - l_discount - l_tax] AS w FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_discount) AS l_discount, min(l_tax) AS l_tax FROM lineitem GROUP BY ALL)), c AS (SELECT mesh, py, px, f, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM px) SELECT c.mesh, 0 AS view, c.py, c.px, round(coalesce(sum(c.w * vm.value), 0), 6) AS value FROM c LEFT JOIN fc ON fc.mesh = c.mesh AND fc.f = c.f LEFT JOIN vm ON vm.mesh = c.mesh AND vm.v = fc.v[c.k] GROUP BY c.mesh, c.py, c.px",
    "cut_vertices": GRID_SQL + ", st AS (SELECT fc.mesh, fc.f, coalesce(label, 0) AS label FROM fc LEFT JOIN lb USING (mesh, f)) SELECT DISTINCT mesh, unnest([a, b]) AS v FROM (SELECT ed.mesh, a, b FROM ed JOIN st USING (mesh, f) GROUP BY ALL HAVING count(*) = 2 AND min(label) <> max(label))",
    "average_radius": GRID_SQL + ", ce AS (SELECT mesh, sum(area * cx) / sum(area) AS x, sum(area * cy) / sum(area) AS y, sum(area * cz) / sum(area) AS z FROM sh GROUP BY mesh) SELECT sh.mesh, round(sum(area * sqrt((cx - x) ** 2 + (cy - y) ** 2 + (cz - z) ** 2)) / sum(area), 6) AS radius FROM sh JOIN ce USING (mesh) GROUP BY sh.mesh",
    "cut_discrepancy": CUT_DISCREPANCY_SQL,
    "vertex_distances": DISTANCES_SQL,
    "bounding_box": GRID_SQL + "SELECT mesh, " + ", ".join(f"round(min({c}), 6) AS min_{c}, round(max({c}), 6) AS max_{c}, round((min({c}) + max({c})) / 2, 6) AS centre_{c}" for c in "xyz") + " FROM vt GROUP BY mesh",
    "bbox_normalise": GRID_SQL + ", b AS (SELECT mesh, (min(x) + max(x)) / 2 AS bx, (min(y) + max(y)) / 2 AS by_, (min(z) + max(z)) / 2 AS bz FROM vt GROUP BY mesh), c AS (SELECT vt.mesh, v, x - bx AS x, y - by_ AS y, z - bz AS z FROM vt JOIN b USING (mesh)), s AS (SELECT mesh, 0.999 / max(greatest(abs(x), abs(y), abs(z))) AS s FROM c GROUP BY mesh) SELECT c.mesh, v, round(x * s, 6) AS x, round(y * s, 6) AS y, round(z * s, 6) AS z FROM c JOIN s USING (mesh)",
    "diameter_scale": GRID_SQL + ", d AS (SELECT mesh, f, CASE WHEN f % 9 = 0 THEN 0.0 ELSE (f * 13) % 7 END::DOUBLE AS v FROM fc) SELECT mesh, f, round(ln(4 * (v - min(v) OVER (PARTITION BY mesh)) / (max(v) OVER (PARTITION BY mesh) - min(v) OVER (PARTITION BY mesh)) + 1) / ln(5), 6) AS value FROM d",
    "posed_points": GRID_SQL + "SELECT mesh, v, round(-y + 2, 6) AS x, round(x + 3, 6) AS y, round(z - 1, 6) AS z FROM vt",
    "range_norm": "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 50 * 10, 0)::INT AS i, round_even(l_quantity / 50 * 10, 0) / 10 * 50 AS back FROM lineitem",
    "decimation_target": "SELECT p_partkey, floor(p_size * 0.3::DOUBLE)::INT AS goal, round(least(greatest(1 - floor(p_size * 0.3::DOUBLE) / p_size, 0.0), 0.99)::DOUBLE, 6) AS share FROM part",
    "surface_samples": GRID_SQL + "SELECT mesh, f, 4::BIGINT AS n, 4::BIGINT AS inside FROM fc",
    "box_corners": "SELECT p_partkey, round(1 - p_size / 20, 6) AS x0, round(1 + p_size / 20, 6) AS x1, 1.0::DOUBLE AS y0, 3.0::DOUBLE AS y1, 1.0::DOUBLE AS z0, 5.0::DOUBLE AS z1 FROM part",
}
