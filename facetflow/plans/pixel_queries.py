"""Queries of pixel values, cues, candidates, dendrograms, cleaned meshes, sessions and part files, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from facetflow.operators import features, geometry, labels, masks, pixels, tracking
from facetflow.plans.analogues import table
from facetflow.plans.lifting_queries import rounded
from facetflow.plans.mask_queries import GRID_SQL as MASK_SQL
from facetflow.plans.mask_queries import discs
from facetflow.plans.mesh_queries import GRID_SQL, face_labels, faces, vertices
from facetflow.session import cut, shared_dir
from facetflow.sources import meshes

LINE = ("l_orderkey", "l_linenumber")


def _line(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def packed(spark, sf_dir):
    """Pixels of one channel, three, or four, by line number; values of 0 to 255 and beyond."""
    q, k = F.col("l_quantity"), F.col("l_linenumber") % 3
    channels = F.when(k == 0, F.array(q * 6)).when(k == 1, F.array(q, q * 2, q * 4)).otherwise(F.array(q * 5, q - 20, q, F.lit(255.0)))
    out = pixels.packed(channels, divide=True)
    return rounded(_line(spark, sf_dir).select(*LINE, *[F.get(out, F.lit(i)).alias(c) for i, c in enumerate("rgb")]), 6)


def grey_depth(spark, sf_dir):
    own = _line(spark, sf_dir).select(F.expr("l_orderkey div 16").alias("img"), *LINE, "l_extendedprice", "l_quantity")
    return pixels.ranged(own, "l_extendedprice", F.col("l_quantity") > 5, ["img"]).select(*LINE, "grey")


def blended(spark, sf_dir):
    q = F.col("l_quantity")
    out = pixels.blended(F.array(q, q * 2, q * 4), F.array(F.lit(255.0), F.lit(0.0), q * 5))
    return rounded(_line(spark, sf_dir).select(*LINE, *[F.get(out, F.lit(i)).alias(c) for i, c in enumerate("rgb")]), 6)


def normals(spark, sf_dir):
    out = pixels.decoded_normal(F.array(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50))
    return rounded(_line(spark, sf_dir).select(*LINE, *[F.get(out, F.lit(i)).alias(c) for i, c in enumerate(("nx", "ny", "nz"))]), 6)


def shaded(spark, sf_dir):
    w = F.array(F.col("l_discount"), F.col("l_tax"), 1 - F.col("l_discount") - F.col("l_tax"))
    corners = [F.array(F.lit(1.0), F.lit(0.5), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.25)), F.array(F.lit(0.0), F.lit(0.0), F.col("l_quantity") / 25 - 1)]
    light = F.array(F.lit(0.6), F.lit(0.0), F.lit(0.8))
    return rounded(_line(spark, sf_dir).select(*LINE, pixels.shaded(w, corners, light).alias("light")), 6)


def channels(spark, sf_dir):
    out = pixels.projected(F.array("l_quantity", "l_discount", "l_tax"), ["depth", "id", "normal"], ["normal", "depth"])
    return _line(spark, sf_dir).select(*LINE, F.get(out, F.lit(0)).alias("normal"), F.get(out, F.lit(1)).alias("depth"))


def plane_points(spark, sf_dir):
    return pixels.plane_points(vertices(spark, sf_dir), ["mesh", "v"])


def linspaced(spark, sf_dir):
    own = table(spark, sf_dir, "part")
    return rounded(own.select("p_partkey", F.posexplode(pixels.linspace(F.lit(0.0), F.col("p_size"), 6)).alias("i", "value")), 6)


def padded(spark, sf_dir):
    k = (F.col("p_size") % 4).cast("int")
    first, second = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: i.cast("double")), F.array(F.lit(10.0), F.lit(20.0), F.lit(30.0))
    pads = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: i >= k)
    out = pixels.padded_concat(first, pads, second, F.array(F.lit(False), F.lit(False), F.lit(True)))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(out, lambda x: x.cast("int").cast("string")), ",").alias("values"))


def cues(spark, sf_dir):
    own = discs(spark, sf_dir)
    return masks.of_cues({"normal": own.where("mask < 3"), "depth": own.where("mask > 1")}).groupBy("img", "cue", "mask").agg(F.count("*").alias("area"))


def annotation_kinds(spark, sf_dir):
    k = F.col("p_size") % 4
    text = F.when(k == 0, F.format_string("[[%d, 2, 3]]", "p_size")).when(k == 1, F.format_string('{"counts": [%d, 2], "size": [1, 2]}', "p_size")).when(k == 2, F.lit('{"counts": "ab1", "size": [1, 2]}')).otherwise(F.lit("{}"))
    return table(spark, sf_dir, "part").select("p_partkey", masks.annotation_kind(text).alias("kind"))


def best_of_queries(spark, sf_dir):
    own = _line(spark, sf_dir).groupBy(F.col("l_orderkey").alias("query"), F.col("l_suppkey").alias("cand")).agg(F.max(F.round("l_tax", 2)).alias("logit"))
    return masks.best_of_queries(own, ["query"]).select("query", "cand", "logit", F.size("multi").alias("n"), F.array_join(F.transform("multi", lambda m: m["cand"].cast("string")), ",").alias("cands"))


def dendrogram(spark, sf_dir):
    """Vectors in chains of 128, cut into ten clusters."""
    ids = table(spark, sf_dir, "embeddings").select(F.expr("cast(vec_id div 128 as int)").alias("mesh"), F.col("vec_id").alias("n"))
    after = ids.select("mesh", (F.col("n") - 1).alias("n"))
    merges = ids.join(after, ["mesh", "n"], "left_semi").select("mesh", F.col("n").alias("src"), (F.col("n") + 1).alias("dst"), F.pmod(F.col("n") * 7919, F.lit(1009)).cast("double").alias("w"))
    return features.dendrogram_cut(merges, ids, 10)


def cleaned_faces(spark, sf_dir):
    return geometry.cleaned_mesh(vertices(spark, sf_dir), faces(spark, sf_dir), 1.5)[1].select("mesh", "f", F.array_join(F.col("v").cast("array<string>"), ",").alias("v"))


def cleaned_vertices(spark, sf_dir):
    return geometry.cleaned_mesh(vertices(spark, sf_dir), faces(spark, sf_dir), 1.5)[0]


def sessions(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "reset").when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", F.when(F.col("event_id") % 3 == 0, "close").otherwise("start")).otherwise("add")
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), kind.alias("type"), (F.col("event_id") % 5).alias("obj"))
    return tracking.session_states(own).select("session", "open", F.array_join(F.col("objs").cast("array<string>"), ",").alias("objs"))


def part_round_trip(spark, sf_dir):
    """A file a part, written as OBJ text and read again by the mesh reader."""
    folder = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    own = cut(labels.fill_rest(face_labels(spark, sf_dir), faces(spark, sf_dir)).join(faces(spark, sf_dir), ["mesh", "f"]))
    meshes.write_obj(meshes.part_lines(vertices(spark, sf_dir), own), folder)
    point, triangle = F.col("kind") == "v", F.col("kind") == "f"
    found = meshes.elements(spark, folder, kind="obj").groupBy("mesh").agg(F.count_if(point).alias("vertices"), F.round(F.sum(F.when(point, F.col("z"))), 4).alias("z"), F.count_if(triangle).alias("faces"))
    return found.where("vertices > 0 AND faces > 0")


def _three(*sql: str) -> str:
    return ", ".join(f"round({s}, 6)::DOUBLE AS {c}" for s, c in zip(sql, "rgb", strict=True))


_PACK = [f"least(greatest((CASE l_linenumber % 3 WHEN 0 THEN l_quantity * 6 WHEN 1 THEN l_quantity * {a} ELSE {b} END) / 255, 0), 1)" for a, b in ((1, "l_quantity * 5"), (2, "l_quantity - 20"), (4, "l_quantity"))]
_NORMAL = ("l_discount * 1.0::DOUBLE", "(l_discount * 0.5::DOUBLE + l_tax)", "(l_tax * 0.25::DOUBLE + (1 - l_discount - l_tax) * (l_quantity / 25 - 1))")
QUERIES = {
    "packed_pixels": packed, "depth_colours": grey_depth, "blended_colours": blended, "decoded_normals": normals, "matte_shading": shaded, "channel_projection": channels, "plane_coordinates": plane_points, "linspace": linspaced, "padded_concat": padded,
    "concat_cues": cues, "annotation_kinds": annotation_kinds, "best_of_queries": best_of_queries, "dendrogram_cut": dendrogram, "cleaned_faces": cleaned_faces, "cleaned_vertices": cleaned_vertices, "session_states": sessions, "part_round_trip": part_round_trip,
}
CLEAN_SQL = GRID_SQL + """, nr AS (SELECT mesh, v, min(v) OVER (PARTITION BY mesh, floor(x / 1.5), floor(y / 1.5), floor(z / 1.5)) AS k FROM vt),
cf AS (SELECT fc.mesh, fc.f, [a.k, b.k, c.k] AS v FROM fc JOIN nr a ON a.mesh = fc.mesh AND a.v = fc.v[1] JOIN nr b ON b.mesh = fc.mesh AND b.v = fc.v[2] JOIN nr c ON c.mesh = fc.mesh AND c.v = fc.v[3]),
cl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mesh, list_sort(v) ORDER BY f) AS r FROM cf WHERE v[1] <> v[2] AND v[2] <> v[3] AND v[1] <> v[3]) WHERE r = 1)"""
ORACLES = {
    "packed_pixels": f"SELECT l_orderkey, l_linenumber, {_three(*_PACK)} FROM lineitem",
    "depth_colours": "WITH e AS (SELECT l_orderkey // 16 AS img, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem WHERE l_quantity > 5 GROUP BY ALL) SELECT l_orderkey, l_linenumber, (CASE WHEN l_quantity > 5 AND hi > lo THEN round(255 * ((l_extendedprice - lo) / (hi - lo))) ELSE 0 END)::INT AS grey FROM lineitem LEFT JOIN e ON e.img = l_orderkey // 16",
    "blended_colours": "SELECT l_orderkey, l_linenumber, " + _three(*[f"least(greatest(0.75::DOUBLE * l_quantity * {a} + 0.25::DOUBLE * {b}, 0), 255)" for a, b in ((1, "255"), (2, "0"), (4, "l_quantity * 5"))]) + " FROM lineitem",
    "decoded_normals": "SELECT l_orderkey, l_linenumber, round(l_discount * 2 - 1, 6) AS nx, round(l_tax * 2 - 1, 6) AS ny, round(l_quantity / 50 * 2 - 1, 6) AS nz FROM lineitem",
    "matte_shading": f"WITH n AS (SELECT l_orderkey, l_linenumber, {_NORMAL[0]} AS x, {_NORMAL[1]} AS y, {_NORMAL[2]} AS z FROM lineitem) SELECT l_orderkey, l_linenumber, round(CASE WHEN x * x + y * y + z * z > 0 THEN least(greatest((x * 0.6::DOUBLE + z * 0.8::DOUBLE) / sqrt(x * x + y * y + z * z), 0), 1) ELSE 0 END, 6)::DOUBLE AS light FROM n",
    "channel_projection": "SELECT l_orderkey, l_linenumber, l_tax AS normal, l_quantity AS depth FROM lineitem",
    "plane_coordinates": GRID_SQL + "SELECT mesh, v, 'xy' AS plane, x AS a, y AS b FROM vt UNION ALL SELECT mesh, v, 'yz', y, z FROM vt UNION ALL SELECT mesh, v, 'zx', z, x FROM vt",
    "linspace": "SELECT p_partkey, i::INT AS i, round(p_size * i / 5, 6)::DOUBLE AS value FROM part, range(6) t(i)",
    "padded_concat": "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '10,20,0,0,0,0,0' WHEN 1 THEN '1,10,20,0,0,0,0' WHEN 2 THEN '1,2,10,20,0,0,0' ELSE '1,2,3,10,20,0,0' END AS values FROM part",
    "concat_cues": MASK_SQL + "SELECT img, cue, (row_number() OVER (PARTITION BY img ORDER BY cue, mask))::INT AS mask, area FROM (SELECT img, 'normal' AS cue, mask, area FROM ar WHERE mask < 3 UNION ALL SELECT img, 'depth', mask, area FROM ar WHERE mask > 1)",
    "annotation_kinds": "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'polygons' WHEN 1 THEN 'counts' WHEN 2 THEN 'coded' ELSE 'none' END AS kind FROM part",
    "best_of_queries": "WITH c AS (SELECT l_orderkey AS query, l_suppkey AS cand, max(round(l_tax, 2)) AS logit FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY logit DESC, cand) AS r, (count(*) OVER (PARTITION BY query))::INT AS n FROM c) SELECT r.query, r.cand, r.logit, r.n, l.cands FROM r JOIN (SELECT query, string_agg(cand::VARCHAR, ',' ORDER BY cand) AS cands FROM c GROUP BY query) l USING (query) WHERE r = 1",
    "dendrogram_cut": "WITH n AS (SELECT (vec_id // 128)::INT AS mesh, vec_id AS n FROM embeddings), m AS (SELECT a.mesh, a.n AS src, ((a.n * 7919) % 1009)::DOUBLE AS w FROM n a JOIN n b ON a.mesh = b.mesh AND b.n = a.n + 1), o AS (SELECT *, row_number() OVER (PARTITION BY mesh ORDER BY w, src) AS r FROM m), z AS (SELECT mesh, count(*) AS z FROM n GROUP BY mesh), s AS (SELECT n.mesh, n.n, coalesce(o.r <= z - 10, false) AS joined FROM n JOIN z USING (mesh) LEFT JOIN o ON o.mesh = n.mesh AND o.src = n.n - 1) SELECT mesh, n, max(CASE WHEN joined THEN NULL ELSE n END) OVER (PARTITION BY mesh ORDER BY n) AS cluster FROM s",
    "cleaned_faces": CLEAN_SQL + " SELECT mesh, f, array_to_string(v, ',') AS v FROM cl",
    "cleaned_vertices": CLEAN_SQL + " SELECT * FROM vt WHERE EXISTS (SELECT 1 FROM cl WHERE cl.mesh = vt.mesh AND list_contains(cl.v, vt.v))",
    "session_states": """WITH r AS (SELECT user_id AS session, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'reset' WHEN event_type = 'error' THEN 'remove' WHEN event_type = 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'close' ELSE 'start' END ELSE 'add' END AS type, event_id % 5 AS obj FROM events),
t AS (SELECT *, coalesce(last_value(CASE WHEN type IN ('start', 'close') THEN type END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq) = 'start', false) AS live FROM r),
e AS (SELECT session, arg_max(live, seq) AS open, max(seq) FILTER (type IN ('reset', 'close')) AS e FROM t GROUP BY session),
l AS (SELECT session, obj, max(seq) FILTER (type = 'add') AS a, max(seq) FILTER (type = 'remove') AS d FROM t WHERE live GROUP BY session, obj),
o AS (SELECT session, string_agg(obj::VARCHAR, ',' ORDER BY obj) AS objs FROM l JOIN e USING (session) WHERE a > coalesce(e, -1) AND a > coalesce(d, -1) GROUP BY session) SELECT session, open, coalesce(objs, '') AS objs FROM e LEFT JOIN o USING (session)""",
    "part_round_trip": GRID_SQL + ", st AS (SELECT fc.mesh, fc.f, label, v FROM fc JOIN lb USING (mesh, f) WHERE label > 0), pn AS (SELECT *, mesh || '_part_' || lpad(label::VARCHAR, 3, '0') AS name FROM st), pv AS (SELECT DISTINCT name, mesh, unnest(v) AS v FROM pn) SELECT pv.name AS mesh, count(*) AS vertices, round(sum(z), 4) AS z, (SELECT count(*) FROM pn WHERE pn.name = pv.name) AS faces FROM pv JOIN vt ON vt.mesh = pv.mesh AND vt.v = pv.v GROUP BY pv.name",
}
