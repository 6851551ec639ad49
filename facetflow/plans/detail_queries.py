"""Queries of cameras, packing, parts, crops, prompts, clearing and small files, with their SQL."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from facetflow.operators import features, geometry, labels, masks, pixels, tracking
from facetflow.plans.analogues import NUMBERS_SQL, numbered, table
from facetflow.plans.feature_queries import POINT_SQL, _points
from facetflow.plans.lifting_queries import rounded
from facetflow.plans.mesh_queries import GRID_SQL, face_labels, faces, vertices
from facetflow.plans.track_queries import OUT_SQL, _frames
from facetflow.session import cut, shared_dir
from facetflow.sources import meshes

KINDS = ("octa", "cube", "standard", "swirl")


def camera_places(spark, sf_dir):
    """A set of cameras for each nation, of a radius by its region."""
    own = table(spark, sf_dir, "nation").select("n_nationkey", (1 + F.col("n_regionkey")).alias("radius"), F.get(F.array(*map(F.lit, KINDS)), (F.col("n_nationkey") % 4).cast("int")).alias("kind"))
    sets = None
    for kind in KINDS:
        one = geometry.cameras(spark, kind, {"standard": 6, "swirl": 10}.get(kind, 0)).withColumn("kind", F.lit(kind))
        sets = one if sets is None else sets.unionByName(one)
    return rounded(own.join(F.broadcast(sets), "kind").select("n_nationkey", "camera", *[(F.col(c) * F.col("radius")).alias(c) for c in "xyz"]), 6)


_E = math.radians(20)
_CORNERS = [("octa", i, *[s if k == a else 0 for k in range(3)]) for i, (a, s) in enumerate((a, s) for a in range(3) for s in (1, -1))]
_CORNERS += [("cube", i, *p) for i, p in enumerate((a / 3**0.5, b / 3**0.5, c / 3**0.5) for a in (1, -1) for b in (1, -1) for c in (1, -1))]
CAMERA_SQL = f"""WITH c AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {i}, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for k, i, x, y, z in _CORNERS)}) t(kind, camera, x, y, z)
  UNION ALL SELECT 'standard', (s * 6 + i)::INT, cos(2 * pi() * i / 6) * cos({_E}), sin(2 * pi() * i / 6) * cos({_E}), (1 - 2 * s) * sin({_E}) FROM range(6) a(i), range(2) b(s) UNION ALL SELECT 'standard', (12 + s)::INT, 0, 0, 1 - 2 * s FROM range(2) b(s)
  UNION ALL SELECT 'swirl', i::INT, sin(t) * cos(8 * t), sin(t) * sin(8 * t), cos(t) FROM (SELECT i, pi() * (i + 0.5) / 10 AS t FROM range(10) a(i)))
SELECT n_nationkey, camera, round(x * (1 + n_regionkey), 6) + 0.0 AS x, round(y * (1 + n_regionkey), 6) + 0.0 AS y, round(z * (1 + n_regionkey), 6) + 0.0 AS z FROM nation JOIN c ON kind = ['octa', 'cube', 'standard', 'swirl'][1 + n_nationkey % 4]"""


def sphere_cameras(spark, sf_dir):
    return rounded(geometry.sphere_cameras(table(spark, sf_dir, "supplier"), "s_suppkey", radius=2.0), 6)


SPHERE_SQL = """WITH a AS (SELECT s_suppkey, 2 * pi() * (('0x' || substr(md5('0|turn|' || s_suppkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE) AS t, pi() * (('0x' || substr(md5('0|polar|' || s_suppkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE) AS p FROM supplier)
SELECT s_suppkey, round(2 * sin(p) * cos(t), 6) AS x, round(2 * sin(p) * sin(t), 6) AS y, round(2 * cos(p), 6) AS z FROM a"""


def camera_sets(spark, sf_dir):
    """How many cameras each nation has, and how many of them are as far as its radius says."""
    own = camera_places(spark, sf_dir).join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey")
    far = F.abs(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) - 1 - F.col("n_regionkey"))
    return own.groupBy("n_nationkey").agg(F.count("*").alias("n"), F.count_if(far < 1e-5).alias("on_sphere"))


def look_at(spark, sf_dir):
    """Poses of cameras that look at a point of each supplier's own from the sphere about it."""
    eyes = cut(geometry.sphere_cameras(table(spark, sf_dir, "supplier"), "s_suppkey", radius=3.0).withColumn("tx", (F.col("s_suppkey") % 5) / 10.0))
    pose = geometry.look_at([F.col("x"), F.col("y"), F.col("z")], [F.col("tx"), F.lit(0.0), F.lit(0.0)])
    return rounded(cut(eyes.select("s_suppkey", pose.alias("pose"))).select("s_suppkey", F.posexplode("pose").alias("i", "value")), 6)


LOOK_SQL = SPHERE_SQL.partition("SELECT s_suppkey, round(")[0] + """, e AS (SELECT s_suppkey, 3 * sin(p) * cos(t) AS ex, 3 * sin(p) * sin(t) AS ey, 3 * cos(p) AS ez, (s_suppkey % 5) / 10.0::DOUBLE AS tx FROM a),
z AS (SELECT *, (ex - tx) / sqrt((ex - tx) ** 2 + ey ** 2 + ez ** 2) AS zx, ey / sqrt((ex - tx) ** 2 + ey ** 2 + ez ** 2) AS zy, ez / sqrt((ex - tx) ** 2 + ey ** 2 + ez ** 2) AS zz FROM e), x AS (SELECT *, zz / sqrt(zz ** 2 + zx ** 2) AS xx, -zx / sqrt(zz ** 2 + zx ** 2) AS xz FROM z),
m AS (SELECT s_suppkey, [xx, zy * xz, zx, ex, 0, zz * xx - zx * xz, zy, ey, xz, -zy * xx, zz, ez, 0, 0, 0, 1] AS m FROM x) SELECT s_suppkey, (generate_subscripts(m, 1) - 1)::INT AS i, round(unnest(m), 6) + 0.0 AS value FROM m"""


def triangulate(spark, sf_dir):
    """Triangles of polygons with a corner more than an order has lines, a hundred orders a mesh."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).select(F.expr("l_orderkey div 100").alias("mesh"), (F.col("l_orderkey") % 100).cast("int").alias("f"), F.sequence(F.lit(0), F.col("n").cast("int")).alias("v"))
    return geometry.triangles(rows).select("mesh", F.col("tri").cast("long").alias("tri"), "f", F.array_join("v", ",").alias("v"))


def point_grid(spark, sf_dir):
    return rounded(table(spark, sf_dir, "nation").select("n_nationkey").join(F.broadcast(masks.point_grid(spark, 8))), 6)


def area_normalise(spark, sf_dir):
    return rounded(geometry.normalised_by_area(vertices(spark, sf_dir), faces(spark, sf_dir)), 6)


AREA_SQL = GRID_SQL + """, m AS (SELECT mesh, sum(area * cx) / sum(area) AS mx, sum(area * cy) / sum(area) AS my, sum(area * cz) / sum(area) AS mz FROM sh GROUP BY mesh), d AS (SELECT mesh, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS side FROM vt GROUP BY mesh)
SELECT vt.mesh, v, round((x - mx) / side, 6) AS x, round((y - my) / side, 6) AS y, round((z - mz) / side, 6) AS z FROM vt JOIN m USING (mesh) JOIN d USING (mesh)"""


def valid_ids(spark, sf_dir):
    f = (F.col("l_partkey") % 210 - 5).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy(geometry.valid_ids(f, F.lit(200)).alias("f")).agg(F.count("*").alias("n"))


def _images(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("img", F.expr("l_orderkey div 64"))
    values = F.when(F.col("img") % 2 == 0, F.array(F.col("l_discount"), F.col("l_tax"), F.col("l_discount"))).otherwise(F.array(F.col("l_quantity") * 5))
    return line.groupBy("img", (F.col("l_orderkey") % 64).cast("int").alias("y"), F.col("l_linenumber").cast("int").alias("x")).agg(F.max(values).alias("channels"))


def packed_images(spark, sf_dir):
    """Images of three small values or one large one; one without pixels behind the last."""
    own = _images(spark, sf_dir)
    every = own.select("img").unionByName(own.agg((F.max("img") + 1).alias("img")))
    return rounded(pixels.packed_images(own, every, ["img"]), 6)


PACK_SQL = """WITH a AS (SELECT l_orderkey // 64 AS img, (l_orderkey % 64)::INT AS y, l_linenumber::INT AS x, max(CASE WHEN (l_orderkey // 64) % 2 = 0 THEN [l_discount, l_tax, l_discount]::DOUBLE[] ELSE [l_quantity * 5]::DOUBLE[] END) AS c FROM lineitem GROUP BY ALL),
t AS (SELECT img, max(list_max(c)) > 1 AS big FROM a GROUP BY img), p AS (SELECT a.img, y, x, list_transform(CASE WHEN len(c) = 1 THEN [c[1], c[1], c[1]] ELSE c END, lambda v: least(greatest(v / CASE WHEN big THEN 255.0 ELSE 1.0 END, 0), 1)) AS c FROM a JOIN t USING (img))
SELECT img, y, x, round(c[1], 6) AS r, round(c[2], 6) AS g, round(c[3], 6) AS b FROM p UNION ALL SELECT (SELECT max(img) + 1 FROM a), (i // 64)::INT, (i % 64)::INT, 0, 0, 0 FROM range(4096) q(i)"""


def grid_points(spark, sf_dir):
    return rounded(pixels.grid_points(table(spark, sf_dir, "nation").select("n_nationkey"), 4), 6)


def large_parts(spark, sf_dir):
    own, points = labels.parts_of(faces(spark, sf_dir), face_labels(spark, sf_dir), 20)
    return own.groupBy("mesh", "label").agg(F.count("*").alias("faces"), F.max(F.array_max("v")).alias("last")).join(points.groupBy("mesh", "label").agg(F.count("*").alias("vertices")), ["mesh", "label"])


PARTS_SQL = GRID_SQL + """, b AS (SELECT mesh, label FROM lb WHERE label <> 0 GROUP BY ALL HAVING count(*) >= 20), co AS (SELECT mesh, label, f, unnest(v) AS old FROM fc JOIN lb USING (mesh, f) JOIN b USING (mesh, label))
SELECT mesh, label, count(DISTINCT f) AS faces, (count(DISTINCT old) - 1)::INT AS last, count(DISTINCT old) AS vertices FROM co GROUP BY ALL"""


def carried_values(spark, sf_dir):
    values = vertices(spark, sf_dir).where("v % 5 <> 0").select("mesh", "v", (F.col("x") / 8).alias("u"), (F.col("v") * 3 % 256).cast("int").alias("r"))
    return labels.carried(labels.submeshes(faces(spark, sf_dir), face_labels(spark, sf_dir))[1], values).select("mesh", "label", "v", F.round("u", 6).alias("u"), "r")


CARRIED_SQL = GRID_SQL + """, co AS (SELECT DISTINCT mesh, label, unnest(v) AS old FROM fc JOIN lb USING (mesh, f)), nw AS (SELECT *, (row_number() OVER (PARTITION BY mesh, label ORDER BY old) - 1)::INT AS v FROM co)
SELECT nw.mesh, label, nw.v, CASE WHEN old % 5 <> 0 THEN round(vt.x / 8, 6) END AS u, CASE WHEN old % 5 <> 0 THEN (old * 3 % 256)::INT END AS r FROM nw JOIN vt ON vt.mesh = nw.mesh AND vt.v = old"""


def component_numbers(spark, sf_dir):
    return labels.numbered_components(labels.label_components(face_labels(spark, sf_dir), labels.adjacency(faces(spark, sf_dir))))


PLANES = ("xy", "yz", "xz")


def planes_sample(spark, sf_dir):
    """Three planes of eight by eight cells for each mesh of points."""
    cells = _points(spark, sf_dir).select("mesh").distinct().withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(63)))).select("mesh", F.expr("cast(c div 8 as int)").alias("i"), (F.col("c") % 8).cast("int").alias("j"))
    grids = {name: cells.withColumn("value", (F.pmod((F.col("mesh") * 64 + F.col("i") * 8 + F.col("j")) * (37 + k), F.lit(11)) / 1.0)) for k, name in enumerate(PLANES)}
    return rounded(features.planes_sample(_points(spark, sf_dir), grids, 8), 6)


PLANES_SQL = POINT_SQL + ", pl AS (" + " UNION ALL ".join(f"SELECT mesh, id, {k} AS k, least(greatest({a} * 7, 0), 7) AS u, least(greatest({b} * 7, 0), 7) AS w FROM p" for k, (a, b) in enumerate(PLANES)) + """), l AS (SELECT *, least(floor(u), 6)::INT AS i0, least(floor(w), 6)::INT AS j0 FROM pl),
s AS (SELECT mesh, id, (1 - abs(u - (i0 + a))) * (1 - abs(w - (j0 + b))) * (((mesh * 64 + (i0 + a) * 8 + j0 + b) * (37 + k)) % 11) AS c FROM l, range(2) q(a), range(2) r(b)) SELECT mesh, id, round(sum(c), 6) AS value FROM s GROUP BY ALL"""


def uncropped_masks(spark, sf_dir):
    """Masks of four crops of each image of orders; some pixels lie outside their crop."""
    line = table(spark, sf_dir, "lineitem")
    own = line.select(F.expr("l_orderkey div 256").alias("img"), (F.col("l_linenumber") % 4).cast("int").alias("crop"), (F.col("l_suppkey") % 7).cast("int").alias("mask"), (F.col("l_orderkey") % 16).cast("int").alias("y"), (F.col("l_partkey") % 20).cast("int").alias("x")).distinct()
    crops = own.select("img").distinct().withColumn("crop", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("img", "crop", (F.col("crop") * 10).alias("x0"), (F.col("crop") * 6).alias("y0"), (F.col("crop") * 10 + 18).alias("x1"), (F.col("crop") * 6 + 14).alias("y1"))
    return masks.uncropped_masks(own, crops).distinct()


UNCROP_SQL = """SELECT DISTINCT l_orderkey // 256 AS img, (l_suppkey % 7)::INT AS mask, (l_orderkey % 16 + l_linenumber % 4 * 6)::INT AS y, (l_partkey % 20 + l_linenumber % 4 * 10)::INT AS x FROM lineitem WHERE l_orderkey % 16 < 14 AND l_partkey % 20 < 18"""


def layered_points(spark, sf_dir):
    return rounded(masks.layered_points(table(spark, sf_dir, "nation").select("n_nationkey"), 8, 3), 6)


def jittered_boxes(spark, sf_dir):
    own = table(spark, sf_dir, "part").select(F.col("p_size").alias("img"), F.col("p_partkey").alias("mask"), *[c.cast("double").alias(n) for n, c in (("x0", F.col("p_partkey") % 50), ("y0", F.col("p_partkey") % 40), ("x1", F.col("p_partkey") % 50 + 10 + F.col("p_size") * 4), ("y1", F.col("p_partkey") % 40 + 30))])
    sizes = own.select("img").distinct().select("img", F.lit(80).alias("h"), F.lit(90).alias("w"))
    return rounded(masks.jittered(own, sizes), 6)


def _draw(c: str) -> str:
    return f"(2 * (('0x' || substr(md5('0|{c}|' || p_size || '|' || p_partkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE) - 1)"


JITTER_SQL = f"""SELECT p_size AS img, p_partkey AS mask, round(greatest(least(p_partkey % 50 + {_draw("x0")} * least((10 + p_size * 4) * 0.1::DOUBLE, 20), 89), 0), 6) AS x0, round(greatest(least(p_partkey % 40 + {_draw("y0")} * 3, 79), 0), 6) AS y0,
round(greatest(least(p_partkey % 50 + 10 + p_size * 4 + {_draw("x1")} * least((10 + p_size * 4) * 0.1::DOUBLE, 20), 89), 0), 6) AS x1, round(greatest(least(p_partkey % 40 + 30 + {_draw("y1")} * 3, 79), 0), 6) AS y1 FROM part"""


def uniform_prompts(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.expr("l_orderkey div 32").alias("img"), (F.col("l_linenumber") % 2).cast("int").alias("mask"), (F.col("l_orderkey") % 32).cast("int").alias("y"), F.col("l_linenumber").cast("int").alias("x"), "l_quantity").distinct()
    ref, est = line.where("l_quantity > 10").drop("l_quantity").distinct(), line.where("l_quantity < 45 OR img % 3 = 0 AND l_quantity > 10").where("NOT (img % 3 = 0 AND l_quantity <= 10)").drop("l_quantity").distinct()
    return masks.uniform_prompts(est, ref, line.select("img", "y", "x").distinct())


PROMPT_SQL = """WITH l AS (SELECT DISTINCT l_orderkey // 32 AS img, (l_linenumber % 2)::INT AS mask, (l_orderkey % 32)::INT AS y, l_linenumber::INT AS x, l_quantity AS q FROM lineitem), r AS (SELECT DISTINCT img, mask, y, x FROM l WHERE q > 10),
e AS (SELECT DISTINCT img, mask, y, x FROM l WHERE (q < 45 OR img % 3 = 0 AND q > 10) AND NOT (img % 3 = 0 AND q <= 10)), w AS (SELECT *, true AS positive FROM (SELECT * FROM r EXCEPT SELECT * FROM e) UNION ALL SELECT *, false FROM (SELECT * FROM e EXCEPT SELECT * FROM r)),
o AS (SELECT k.img, k.mask, p.y, p.x, false AS positive FROM (SELECT DISTINCT img, mask FROM r EXCEPT SELECT DISTINCT img, mask FROM w) k JOIN (SELECT DISTINCT img, y, x FROM l) p USING (img) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.img = k.img AND r.mask = k.mask AND r.y = p.y AND r.x = p.x)),
a AS (SELECT *, row_number() OVER (PARTITION BY img, mask ORDER BY md5('0|' || img || '|' || mask || '|' || y || '|' || x), y, x) AS n FROM (SELECT * FROM w UNION ALL SELECT * FROM o)) SELECT img, mask, y, x, positive FROM a WHERE n = 1"""


def _outputs(spark, sf_dir):
    kind = F.when(F.col("frame") % 5 == 0, "cond").otherwise("non")
    return _frames(spark, sf_dir).select("session", "obj", "frame", kind.alias("kind"), (F.col("frame") % 9).alias("area"))


def cleared_prompts(spark, sf_dir):
    own = _outputs(spark, sf_dir)
    return tracking.after_clearing(own, own.where("kind = 'cond'"), own.where("frame % 3 = 0"))


def cleared_shared(spark, sf_dir):
    """Frames of which all prompts are cleared; session 2 has no other conditioning frames left."""
    own = _outputs(spark, sf_dir).withColumn("frame", F.expr("frame div 4"))
    inputs = own.where("kind = 'cond'")
    return tracking.after_clearing(own, inputs, inputs.where("session = 2 OR obj % 2 = 0"), shared=True).groupBy("session", "kind").agg(F.count("*").alias("n"))


def reset_inputs(spark, sf_dir):
    """Inputs by user and event, resets by purchases; of objects only those before the last reset of everything go."""
    own = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("session"), F.col("event_id").alias("seq"), F.col("user_id").alias("obj"), "event_type")
    resets = own.where("event_type = 'purchase' AND seq % 4 = 0").select("session", "seq", (F.col("seq") % 8 == 0).alias("everything"))
    left = tracking.after_resets(own, resets).groupBy("session").agg(F.count("*").alias("inputs"))
    objs = tracking.after_resets(own, resets, objects=True).groupBy("session").agg(F.count_distinct("obj").alias("objs"))
    return left.join(objs, "session")


def removed_objects(spark, sf_dir):
    own = _outputs(spark, sf_dir)
    return tracking.without_objects(own, own.select("session", "obj").distinct(), own.where("obj % 4 = 1").select("session", "obj").distinct())


def trimmed_outputs(spark, sf_dir):
    own = _outputs(spark, sf_dir)
    return tracking.trimmed_outputs(own, own.groupBy("session").agg(F.max("frame").alias("last")), 4)


def material_lines(spark, sf_dir):
    return meshes.material_lines(face_labels(spark, sf_dir), labels.colours(F.col("label")))


_PART = "printf('%.6f', CASE WHEN label = 0 THEN 0 ELSE (label::BIGINT * {k} + {d}) % 256 END / 255.0::DOUBLE)"
MATERIAL_SQL = GRID_SQL + "SELECT DISTINCT mesh, label, 'newmtl label_' || label || chr(10) || 'Kd ' || " + " || ' ' || ".join(_PART.format(k=k, d=k // 7) for k in (97, 57, 193)) + " AS line FROM lb"


def part_tables(spark, sf_dir):
    """Faces written as a folder a label, and read again."""
    folder = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    meshes.write_parts(faces(spark, sf_dir).join(face_labels(spark, sf_dir), ["mesh", "f"]), folder)
    return spark.read.parquet(folder).select("mesh", "label", "f", F.array_join("v", ",").alias("v"))


def point_clouds(spark, sf_dir):
    """Vertices written as ascii ply without faces, and read again."""
    folder = f"{shared_dir(spark)}/points-{uuid.uuid4().hex}"
    own = vertices(spark, sf_dir).select("mesh", "v", "x", "y", "z", *[F.lit(0).alias(c) for c in "rgb"])
    meshes.write_obj(meshes.ply_lines(own), folder)
    return rounded(meshes.elements(spark, folder, kind="ply").where("kind = 'v'").select(F.col("mesh").cast("int").alias("mesh"), F.col("id").alias("v"), "x", "y", "z"), 6)


def cluster_sweep(spark, sf_dir):
    """How many rows and clusters each number of clusters gives."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return features.k_sweep(cut(own), [2, 4], starts=1, rounds=10).groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("clusters"))


def crop_boxes(spark, sf_dir):
    """Crops of the images of meshes' numbers: 60 by 40 pixels, two layers."""
    boxes = masks.crop_boxes(spark, 40, 60, 2)
    return numbered(spark, sf_dir, "img").join(F.broadcast(boxes))


QUERIES = {f.__name__: f for f in (camera_places, camera_sets, look_at, triangulate, point_grid, sphere_cameras, area_normalise, valid_ids, packed_images, grid_points, large_parts, carried_values, component_numbers, planes_sample, uncropped_masks, layered_points, jittered_boxes, uniform_prompts, cleared_prompts, cleared_shared, reset_inputs, removed_objects, trimmed_outputs, material_lines, part_tables, point_clouds, cluster_sweep, crop_boxes)}
ORACLES = {
    "camera_sets": "SELECT n_nationkey, [6, 8, 14, 10][1 + n_nationkey % 4]::BIGINT AS n, [6, 8, 14, 10][1 + n_nationkey % 4]::BIGINT AS on_sphere FROM nation", "look_at": LOOK_SQL,
    "triangulate": "WITH p AS (SELECT l_orderkey // 100 AS mesh, (l_orderkey % 100)::INT AS f, count(*) + 1 AS n FROM lineitem GROUP BY l_orderkey), t AS (SELECT mesh, f, unnest(range(n - 2)) AS k FROM p) SELECT mesh, row_number() OVER (PARTITION BY mesh ORDER BY f, k) - 1 AS tri, f, '0,' || (k + 1) || ',' || (k + 2) AS v FROM t",
    "point_grid": "SELECT n_nationkey, (i + 0.5::DOUBLE) / 8 AS x, (j + 0.5::DOUBLE) / 8 AS y FROM nation, range(8) a(i), range(8) b(j)",
    "camera_places": CAMERA_SQL, "sphere_cameras": SPHERE_SQL, "area_normalise": AREA_SQL, "packed_images": PACK_SQL, "large_parts": PARTS_SQL, "carried_values": CARRIED_SQL, "planes_sample": PLANES_SQL, "uncropped_masks": UNCROP_SQL, "jittered_boxes": JITTER_SQL, "uniform_prompts": PROMPT_SQL, "material_lines": MATERIAL_SQL,
    "valid_ids": "SELECT CASE WHEN l_partkey % 210 - 5 BETWEEN -1 AND 199 THEN l_partkey % 210 - 5 ELSE -1 END::INT AS f, count(*) AS n FROM lineitem GROUP BY 1",
    "grid_points": "SELECT n_nationkey, i::INT AS i, j::INT AS j, k::INT AS k, -1 + (2 * i + 1) / 4.0::DOUBLE AS x, -1 + (2 * j + 1) / 4.0::DOUBLE AS y, -1 + (2 * k + 1) / 4.0::DOUBLE AS z FROM nation, range(4) a(i), range(4) b(j), range(4) c(k)",
    "component_numbers": GRID_SQL + "SELECT mesh, f, (dense_rank() OVER (PARTITION BY mesh ORDER BY comp) - 1)::INT AS part FROM cmp",
    "layered_points": "SELECT n_nationkey, l::INT AS layer, (i % (8 // (1 << l)) + 0.5::DOUBLE) / (8 // (1 << l)) AS x, (i // (8 // (1 << l)) + 0.5::DOUBLE) / (8 // (1 << l)) AS y FROM nation, range(4) a(l), range(64) b(i) WHERE i < (8 // (1 << l)) * (8 // (1 << l))",
    "cleared_prompts": OUT_SQL + " SELECT session, obj, frame, CASE WHEN frame % 3 = 0 THEN 'non' ELSE kind END AS kind, area FROM o",
    "cleared_shared": OUT_SQL + """, q AS (SELECT session, obj, frame // 4 AS frame, kind FROM o), i AS (SELECT * FROM q WHERE kind = 'cond'), c AS (SELECT DISTINCT session, obj, frame FROM i WHERE session = 2 OR obj % 2 = 0),
      h AS (SELECT DISTINCT session, frame FROM i WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.session = i.session AND c.obj = i.obj AND c.frame = i.frame)), b AS (SELECT DISTINCT session, frame FROM c EXCEPT SELECT session, frame FROM h),
      d AS (SELECT q.session, CASE WHEN b.frame IS NOT NULL AND kind = 'cond' THEN 'non' ELSE kind END AS kind FROM q LEFT JOIN b USING (session, frame)) SELECT session, kind, count(*) AS n FROM d WHERE session IN (SELECT session FROM d WHERE kind = 'cond') OR session NOT IN (SELECT session FROM b) GROUP BY ALL""",
    "reset_inputs": """WITH e AS (SELECT user_id % 7 AS session, event_id AS seq, user_id AS obj, event_type = 'purchase' AND event_id % 4 = 0 AS r FROM events), l AS (SELECT session, max(CASE WHEN r THEN seq END) AS a, max(CASE WHEN r AND seq % 8 = 0 THEN seq END) AS b FROM e GROUP BY ALL)
      SELECT session, count(*) FILTER (seq > coalesce(a, -1)) AS inputs, count(DISTINCT CASE WHEN seq > coalesce(b, -1) THEN obj END) AS objs FROM e JOIN l USING (session) GROUP BY ALL HAVING inputs > 0 AND objs > 0""",
    "removed_objects": OUT_SQL + " SELECT * FROM o WHERE obj % 4 <> 1", "trimmed_outputs": OUT_SQL + " SELECT o.* FROM o JOIN (SELECT session, max(frame) AS last FROM o GROUP BY ALL) USING (session) WHERE kind = 'cond' OR frame > last - 80",
    "part_tables": GRID_SQL + "SELECT mesh, label, f, array_to_string(v, ',') AS v FROM fc JOIN lb USING (mesh, f) WHERE label <> 0", "point_clouds": GRID_SQL + "SELECT mesh, v, x, y, z FROM vt",
    "cluster_sweep": "SELECT k::INT AS k, count(*) AS n, k AS clusters FROM embeddings, (VALUES (2), (4)) t(k) GROUP BY k",
    "crop_boxes": f"""WITH l AS (SELECT i AS layer, (1 << i) AS n, floor((512 / 1500.0::DOUBLE) * 40 * 2 / (1 << i))::INT AS o FROM range(1, 3) t(i)), c AS (SELECT *, ceil((o * (n - 1) + 60) / n::DOUBLE)::INT AS cw, ceil((o * (n - 1) + 40) / n::DOUBLE)::INT AS ch FROM l)
      SELECT m::INT AS img, b.* FROM {NUMBERS_SQL} a(m), (SELECT 0::INT AS layer, 0::INT AS x0, 0::INT AS y0, 60::INT AS x1, 40::INT AS y1 UNION ALL SELECT layer::INT, ((cw - o) * i)::INT, ((ch - o) * j)::INT, least((cw - o) * i + cw, 60)::INT, least((ch - o) * j + ch, 40)::INT FROM c, range(4) p(i), range(4) q(j) WHERE i < n AND j < n) b""",
}
