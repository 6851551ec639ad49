"""Queries of feature vectors, texts and file round trips, with their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.operators import features, labels, text
from facetflow.plans.analogues import numbered, table
from facetflow.plans.lifting_queries import rounded
from facetflow.plans.mesh_queries import GRID_SQL, face_labels, faces, shapes, vertices
from facetflow.session import cut, shared_dir
from facetflow.sources import mesh_source, meshes


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def _points(spark, sf_dir) -> DataFrame:
    """The first three numbers of a vector as a point of the unit cube, the fourth as its value."""
    at = lambda i: F.get("v", F.lit(i)) + 0.5
    return _vectors(spark, sf_dir).select((F.col("label") % 2).alias("mesh"), "id", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), at(3).alias("value"))


POINT_SQL = "WITH RECURSIVE e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT label % 2 AS mesh, id, v[1] + 0.5 AS x, v[2] + 0.5 AS y, v[3] + 0.5 AS z, v[4] + 0.5 AS value FROM e)"
CELL = "floor(least(greatest({c}, 0), 1 - 1e-5) * 8)::INT"


def l2(spark, sf_dir):
    return _vectors(spark, sf_dir).select("id", F.posexplode(features.l2_normalised(F.col("v"))).alias("i", "x")).select("id", "i", F.round("x", 6).alias("x"))


def mean_vectors(spark, sf_dir):
    return features.mean_by(_vectors(spark, sf_dir), ["label"]).select("label", F.posexplode("v").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


def plane_mean(spark, sf_dir):
    return rounded(features.plane_mean(_points(spark, sf_dir), 8), 6)


def pool_gather(spark, sf_dir):
    return rounded(features.pooled(_points(spark, sf_dir), 8).select("id", "pooled"), 6)


def plane_sample(spark, sf_dir):
    cells = spark.range(2 * 64).select(F.expr("cast(id div 64 as int)").alias("mesh"), F.expr("cast(id div 8 % 8 as int)").alias("i"), F.expr("cast(id % 8 as int)").alias("j"), (F.pmod(F.col("id") * 37, F.lit(11)) / 1.0).alias("value"))
    return rounded(features.plane_sample(_points(spark, sf_dir), cells, 8), 6)


SAMPLE_SQL = POINT_SQL + """, u AS (SELECT mesh, id, least(greatest(x * 7, 0), 7) AS u, least(greatest(y * 7, 0), 7) AS w FROM p), l AS (SELECT *, least(floor(u), 6)::INT AS i0, least(floor(w), 6)::INT AS j0 FROM u),
s AS (SELECT mesh, id, (1 - abs(u - (i0 + a))) * (1 - abs(w - (j0 + b))) * (((mesh * 64 + (i0 + a) * 8 + j0 + b) * 37) % 11) AS c FROM l, range(2) q(a), range(2) r(b)) SELECT mesh, id, round(sum(c), 6) AS value FROM s GROUP BY ALL"""


def voxel_mean(spark, sf_dir):
    return rounded(features.voxel_mean(_points(spark, sf_dir), 8), 6)


def voxel_sample(spark, sf_dir):
    own = cut(_points(spark, sf_dir))
    return rounded(features.voxel_sample(own, features.voxel_mean(own, 8), 8), 6)


VOXEL_SQL = POINT_SQL + ", vx AS (SELECT mesh, " + ", ".join(f"round_even(least(greatest({c} * 7, 0), 7), 0)::INT AS v{c}" for c in "xyz") + ", avg(value) AS value FROM p GROUP BY ALL)"
VOXEL_SAMPLE_SQL = VOXEL_SQL + ", u AS (SELECT mesh, id, " + ", ".join(f"least(greatest({c} * 7, 0), 7) AS p{c}" for c in "xyz") + " FROM p), n AS (SELECT u.*, " + ", ".join(f"(least(floor(p{c}), 6) + {k})::INT AS n{c}" for c, k in zip("xyz", "abc", strict=True)) + " FROM u, range(2) q(a), range(2) r(b), range(2) s(c)) SELECT n.mesh, n.id, round(sum(" + " * ".join(f"(1 - abs(p{c} - n{c}))" for c in "xyz") + " * coalesce(value, 0)), 6) AS value FROM n LEFT JOIN vx ON vx.mesh = n.mesh AND vx.vx = nx AND vx.vy = ny AND vx.vz = nz GROUP BY n.mesh, n.id"


def ball_query(spark, sf_dir):
    own = _points(spark, sf_dir)
    return rounded(features.within(own, own.where("id % 5 = 0").select("mesh", "id", "x", "y", "z"), 0.15, 6), 6)


BALL_SQL = POINT_SQL + """, d AS (SELECT c.mesh, c.id AS centre, p.id, p.x - c.x AS dx, p.y - c.y AS dy, p.z - c.z AS dz FROM p c JOIN p ON p.mesh = c.mesh WHERE c.id % 5 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY mesh, centre ORDER BY dx * dx + dy * dy + dz * dz, id) AS rank FROM d WHERE dx * dx + dy * dy + dz * dz <= 0.15::DOUBLE * 0.15::DOUBLE) SELECT mesh, centre, id, round(dx, 6) AS dx, round(dy, 6) AS dy, round(dz, 6) AS dz, rank::INT AS rank FROM r WHERE rank <= 6"""


def cosine_top_k(spark, sf_dir):
    return rounded(features.cosine_neighbours(_vectors(spark, sf_dir), 5, 50), 6)


COSINE_SQL = "WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT a.id AS query, b.id, list_cosine_similarity(a.v, b.v) AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0) SELECT query, rank::INT AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5"


def _links(spark, sf_dir) -> DataFrame:
    """A sparse graph on the vectors' ids with distinct weights."""
    own = _vectors(spark, sf_dir).select((F.col("label") % 2).alias("mesh"), F.col("id").alias("src"), F.explode(F.array(F.lit(2), F.lit(6), F.lit(14))).alias("step"))
    own = own.withColumn("dst", F.col("src") + F.col("step"))
    own = own.join(_vectors(spark, sf_dir).select(F.col("id").alias("dst")), "dst", "left_semi")
    return own.withColumn("w", F.pmod(F.col("src") * 7919 + F.col("step") * 104729, F.lit(10007)) / 10.0).select("mesh", "src", "dst", "w")


def mst(spark, sf_dir):
    return features.spanning_tree(_links(spark, sf_dir)).select("mesh", "src", "dst", "w")


def single_linkage(spark, sf_dir):
    tree = features.spanning_tree(_links(spark, sf_dir))
    nodes = tree.select("mesh", F.col("src").alias("n")).unionByName(tree.select("mesh", F.col("dst").alias("n"))).distinct()
    return features.single_linkage(tree, nodes, 600.0)


LINK_SQL = "WITH RECURSIVE lk AS (SELECT label % 2 AS mesh, vec_id AS src, vec_id + s AS dst, ((vec_id * 7919 + s * 104729) % 10007) / 10.0 AS w FROM embeddings, (VALUES (2), (6), (14)) t(s) WHERE vec_id + s IN (SELECT vec_id FROM embeddings))"
LINKAGE_SQL = LINK_SQL + ", b AS (SELECT mesh, src AS a, dst AS b FROM lk WHERE w <= 600 UNION SELECT mesh, dst, src FROM lk WHERE w <= 600), n AS (SELECT mesh, src AS n FROM lk UNION SELECT mesh, dst FROM lk), r AS (SELECT mesh, n, n AS c FROM n UNION SELECT r.mesh, b.b, r.c FROM r JOIN b ON b.mesh = r.mesh AND b.a = r.n) SELECT mesh, n, min(c) AS cluster FROM r GROUP BY ALL"


def chained(spark, sf_dir):
    parts = labels.label_components(face_labels(spark, sf_dir), labels.adjacency(faces(spark, sf_dir)))
    return features.chained(parts)


def _parts(spark, sf_dir):
    """Components of six ids each."""
    return _points(spark, sf_dir).select("mesh", F.col("id").alias("f"), (F.col("id") - F.col("id") % 6).alias("comp"))


def _places(spark, sf_dir):
    return _points(spark, sf_dir).select("mesh", F.col("id").alias("f"), "x", "y", "z")


def representatives(spark, sf_dir):
    return features.representatives(_places(spark, sf_dir).join(_parts(spark, sf_dir), ["mesh", "f"]))


def nearest_points(spark, sf_dir):
    return features.nearest(_points(spark, sf_dir), 6).select("mesh", "id", "other", "rank")


def joining_edges(spark, sf_dir):
    return rounded(features.joining_edges(_places(spark, sf_dir), _parts(spark, sf_dir), 6, whole=False), 6)


def component_edges(spark, sf_dir):
    return rounded(features.component_edges(_places(spark, sf_dir), _parts(spark, sf_dir), 6), 6)


NEAR_SQL = POINT_SQL + """, pc AS (SELECT mesh, id, x, y, z, id - id % 6 AS comp FROM p), ce AS (SELECT mesh, comp AS id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM pc GROUP BY ALL),
rp AS (SELECT mesh, comp, f FROM (SELECT pc.mesh, comp, pc.id AS f, row_number() OVER (PARTITION BY pc.mesh, comp ORDER BY (pc.x - ce.x) * (pc.x - ce.x) + (pc.y - ce.y) * (pc.y - ce.y) + (pc.z - ce.z) * (pc.z - ce.z), pc.id) AS r FROM pc JOIN ce ON ce.mesh = pc.mesh AND ce.id = comp) WHERE r = 1)"""
NEXT_SQL = """, nn AS (SELECT * FROM (SELECT a.mesh, a.id, b.id AS other, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) AS d2,
  row_number() OVER (PARTITION BY a.mesh, a.id ORDER BY (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z), b.id)::INT AS rank FROM {t} a JOIN {t} b ON a.mesh = b.mesh AND a.id <> b.id) WHERE rank <= 6)"""
NEAR_EDGES = ", ke AS (SELECT mesh, least(id, other) AS src, greatest(id, other) AS dst, min(sqrt(d2)) AS w FROM nn GROUP BY ALL)"
#: Kruskal's way: edges ke one after another over the list of a mesh's nodes kn (mesh, n, c).
KRUSKAL = """, ks AS (SELECT *, row_number() OVER (PARTITION BY mesh ORDER BY w, src, dst) AS k FROM ke),
kz AS (SELECT mesh, 0::BIGINT AS k, list({'n': n, 'c': c} ORDER BY n) AS st, 0::BIGINT AS src, 0::BIGINT AS dst, 0::DOUBLE AS w, false AS took FROM kn GROUP BY mesh
  UNION ALL SELECT mesh, k, CASE WHEN ca <> cb THEN list_transform(st, lambda x: {'n': x.n, 'c': CASE WHEN x.c = greatest(ca, cb) THEN least(ca, cb) ELSE x.c END}) ELSE st END, src, dst, w, ca <> cb FROM (
    SELECT ks.mesh, ks.k, st, ks.src, ks.dst, ks.w, list_filter(st, lambda x: x.n = ks.src)[1].c AS ca, list_filter(st, lambda x: x.n = ks.dst)[1].c AS cb FROM kz JOIN ks ON ks.mesh = kz.mesh AND ks.k = kz.k + 1)),
tk AS (SELECT mesh, src, dst, w FROM kz WHERE took)"""


def k_means(spark, sf_dir):
    return features.k_means(_vectors(spark, sf_dir), 5, starts=2, rounds=20).groupBy("cluster").agg(F.count("*").alias("n"))


def pca(spark, sf_dir):
    return features.pca_colours(_vectors(spark, sf_dir))


def gmm(spark, sf_dir):
    return features.mixture_costs(_points(spark, sf_dir).select("id", F.col("x").alias("x")), 3).select("id", "label")


def agglomerated(spark, sf_dir):
    """Meshes of 128 vectors: more vectors are more meshes."""
    own = _vectors(spark, sf_dir).select(F.expr("cast(id div 128 as int)").alias("mesh"), F.col("id").alias("f"), "v")
    return features.agglomerated(own, None, 6)


def merged_by_index(spark, sf_dir):
    targets = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 60 - 1).alias("idx"))
    return features.merged_by_index(targets, _points(spark, sf_dir).select("id", F.round("value", 6).alias("value"))).select("p_partkey", "idx", "value")


def small_functions(spark, sf_dir):
    x = F.col("l_discount")
    wave = features.wave_encoding(x, 4)
    pair = [F.array(x, F.col("l_tax"), F.lit(3.0)), F.array(F.lit(100.0), F.lit(-50.0), F.col("l_quantity"))]
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.get(wave, F.lit(i)).alias(f"w{i}") for i in range(4)], features.inverse_sigmoid(x).alias("logit"), features.clamped_score(*pair).alias("score")), 6)


def masked_means(spark, sf_dir):
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(features.masked_mean(F.col("l_tax"), F.col("l_discount") > 0.095).alias("mean")), 6)


# --- texts --------------------------------------------------------------------------------------

def canonical(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.canonical(F.concat(F.lit(" The_"), "p_name", F.lit(" (No. 5)!,  "), "p_brand")).alias("text"))


def pre_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(text.pre_tokens(F.lower("text"))).alias("token")).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("token").alias("kinds"), F.max("token").alias("last"))


def byte_pairs(spark, sf_dir):
    """Ids of whole texts; a padded prompt is byte_pairs() with its length."""
    merges = [("t", "h"), ("th", "e</w>"), ("i", "n"), ("e", "r"), ("a", "n"), ("an", "d</w>"), ("in", "g</w>")]
    return table(spark, sf_dir, "documents").select("doc_id", text.byte_pairs(merges, None)(text.pre_tokens(F.lower("text"))).alias("ids"))


def vocabulary_pairs(spark, sf_dir):
    """Ids of whole texts by the merges of a public tokenizer file."""
    return table(spark, sf_dir, "documents").select("doc_id", text.byte_pairs(public_tokenizers.path("word_bpe_49k.json"), None)(text.pre_tokens(F.lower("text"))).alias("ids"))


def unescaped(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.unescaped(F.concat(F.lit("a &amp;amp; b  "), "p_name", F.lit(" &lt;i&gt; "))).alias("text"))


def colours(spark, sf_dir):
    raw = F.when(F.col("p_size") % 3 == 0, F.format_string("[%d, 51, 255]", F.col("p_size"))).when(F.col("p_size") % 3 == 1, F.lit("[0.5, 0.25, 1]")).otherwise(F.lit("red"))
    c = text.colour(raw)
    return rounded(table(spark, sf_dir, "part").select("p_partkey", *[F.get(c, F.lit(i)).alias(n) for i, n in enumerate("rgb")]), 6)


def source_options(spark, sf_dir):
    line = F.format_string("if mode == 'fast_%d': pass\nelif mode == \"slow\": pass\nif other == 'x': pass", F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.options_in_source(line, "mode"), ",").alias("found"))


# --- files --------------------------------------------------------------------------------------

FILES = ("ply", "stl", "gltf", "glb", "3mf", "off")


def obj_round_trip(spark, sf_dir):
    """Meshes written as OBJ text, read again by the mesh reader."""
    folder = f"{shared_dir(spark)}/obj-{uuid.uuid4().hex}"
    own = labels.fill_rest(face_labels(spark, sf_dir), faces(spark, sf_dir)).join(faces(spark, sf_dir), ["mesh", "f"])
    lines = meshes.obj_lines(vertices(spark, sf_dir), own)
    meshes.write_obj(lines, folder)
    own, triangles = meshes.mesh(spark, folder, kind="obj")
    corners = F.aggregate("v", F.lit(0), lambda a, b: a + b)
    materials = spark.read.text(folder).where(F.col("value").startswith("usemtl")).groupBy("mesh").agg(F.count("*").alias("materials"))
    found = own.groupBy("mesh").agg(F.count("*").alias("vertices"), F.round(F.sum("z"), 4).alias("z")).join(triangles.groupBy("mesh").agg(F.count("*").alias("faces"), F.sum(corners).alias("corners")), "mesh")
    return found.withColumn("mesh", F.col("mesh").cast("int")).join(materials, "mesh").select("mesh", "vertices", "faces", "materials", "z", "corners")


def ply_round_trip(spark, sf_dir):
    """Vertices written as ascii PLY, with colours and faces, read again by the mesh reader."""
    folder = f"{shared_dir(spark)}/ply-{uuid.uuid4().hex}"
    own = vertices(spark, sf_dir).select("mesh", "v", "x", "y", "z", *[(F.col("v") * k % 256).cast("int").alias(c) for k, c in ((3, "r"), (5, "g"), (7, "b"))])
    meshes.write_obj(meshes.ply_lines(own, faces(spark, sf_dir)), folder)
    return rounded(meshes.mesh(spark, folder, kind="ply")[0].withColumn("mesh", F.col("mesh").cast("int")), 6)


def files_round_trip(kind: str, by_source: bool):
    """Meshes written as files of a kind, read again by the data source or by Spark's file reader: of each corner the face, its place and coordinates."""

    def query(spark, sf_dir):
        folder = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
        mesh_source.write_files(vertices(spark, sf_dir), faces(spark, sf_dir), folder, kind)
        if by_source:
            mesh_source.register(spark)
            rows = spark.read.format("meshes").option("partitionBytes", 1 << 20).load(folder)
        else:
            rows = meshes.elements(spark, folder)
        corners = rows.where("kind = 'f'").select("mesh", F.col("id").alias("f"), F.posexplode("v").alias("corner", "id"))
        found = corners.join(rows.where("kind = 'v'").select("mesh", "id", "x", "y", "z"), ["mesh", "id"])
        return rounded(found.select(F.col("mesh").cast("int").alias("mesh"), "f", "corner", "x", "y", "z"), 4)

    return query


def label_json_round_trip(spark, sf_dir):
    folder = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    meshes.labels_json(face_labels(spark, sf_dir)).write.partitionBy("mesh").text(folder)
    return spark.read.text(folder).select("mesh", F.explode(F.from_json("value", "map<string,int>")).alias("f", "label")).select("mesh", F.col("f").cast("int").alias("f"), "label")


def changed_rows(spark, sf_dir):
    lines = meshes.obj_lines(vertices(spark, sf_dir), face_labels(spark, sf_dir).join(faces(spark, sf_dir), ["mesh", "f"]))
    return lines.where("part = 1").select("mesh", F.col("id").cast("int").alias("id"), "line")


def label_gaps(spark, sf_dir):
    return meshes.gaps(face_labels(spark, sf_dir).select("mesh", "f"))


def not_processed(spark, sf_dir):
    """Customers without a finished order."""
    return meshes.not_yet_done(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey")


def natural_order(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", meshes.in_natural_order(F.concat(F.lit("views/mask_"), F.col("page_id").cast("string"), F.lit(".png"))).alias("place"))


def scene(spark, sf_dir):
    shapes_ = vertices(spark, sf_dir).select(F.lit("s").alias("scene"), F.col("mesh").cast("string").alias("name"), "v", "x", "y", "z")
    poses = numbered(spark, sf_dir, "id").select(F.lit("s").alias("scene"), F.col("id").cast("string").alias("name"), F.array(*[F.lit(1.0) if i % 5 == 0 else (F.col("id") * 10.0 if i == 3 else F.lit(0.0)) for i in range(16)]).alias("m"))
    return rounded(meshes.scene(shapes_, poses), 6)


QUERIES = {
    "l2_normalise": l2, "mean_vectors": mean_vectors, "plane_scatter_mean": plane_mean, "pool_gather": pool_gather, "plane_sample": plane_sample, "voxel_mean": voxel_mean, "voxel_sample": voxel_sample, "ball_query": ball_query, "cosine_top_k": cosine_top_k,
    "mst_edges": mst, "single_linkage": single_linkage, "component_chain": chained, "component_representatives": representatives, "nearest_points": nearest_points, "joining_edges": joining_edges, "component_edges": component_edges, "kmeans": k_means, "pca": pca, "gmm": gmm, "agglomerative": agglomerated, "index_merge": merged_by_index, "vector_functions": small_functions, "masked_mean": masked_means,
    "canonical_text": canonical, "pretokenise": pre_tokens, "byte_pairs": byte_pairs, "vocabulary_pairs": vocabulary_pairs, "unescaped_text": unescaped, "colour_text": colours, "source_options": source_options,
    "obj_round_trip": obj_round_trip, "ply_round_trip": ply_round_trip, **{f"{k}_file_round_trip": files_round_trip(k, i % 2 == 0) for i, k in enumerate(FILES)}, "label_json_round_trip": label_json_round_trip, "change_rows": changed_rows, "label_gaps": label_gaps, "anti_processed": not_processed, "natural_order": natural_order, "scene_flatten": scene,
}
POOL = " + ".join(f"max(value) OVER (PARTITION BY mesh, {CELL.format(c=a)}, {CELL.format(c=b)})" for a, b in (("x", "y"), ("x", "z"), ("y", "z")))
ORACLES = {
    "l2_normalise": "WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e) SELECT id, (generate_subscripts(v, 1) - 1)::INT AS i, round(unnest(v) / n, 6) AS x FROM n",
    "mean_vectors": "WITH e AS (SELECT label, (generate_subscripts(embedding, 1) - 1)::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, i, round(avg(x), 6) AS x FROM e GROUP BY ALL",
    "plane_scatter_mean": POINT_SQL + f" SELECT mesh, {CELL.format(c='x')} + 8 * {CELL.format(c='y')} AS cell, round(avg(value), 6) AS value FROM p GROUP BY ALL",
    "pool_gather": POINT_SQL + f" SELECT id, round({POOL}, 6) AS pooled FROM p",
    "plane_sample": SAMPLE_SQL, "voxel_mean": VOXEL_SQL + " SELECT mesh, vx, vy, vz, round(value, 6) AS value FROM vx", "voxel_sample": VOXEL_SAMPLE_SQL, "ball_query": BALL_SQL, "cosine_top_k": COSINE_SQL, "single_linkage": LINKAGE_SQL,
    "component_representatives": NEAR_SQL + "SELECT mesh, comp, f FROM rp", "nearest_points": NEAR_SQL + NEXT_SQL.format(t="p") + "SELECT mesh, id, other, rank FROM nn",
    "joining_edges": NEAR_SQL + NEXT_SQL.format(t="p") + NEAR_EDGES.replace("ke AS", "kf AS") + """, kc AS (SELECT kf.*, least(a.comp, b.comp) AS ca, greatest(a.comp, b.comp) AS cb FROM kf JOIN pc a ON a.mesh = kf.mesh AND a.id = src JOIN pc b ON b.mesh = kf.mesh AND b.id = dst WHERE a.comp <> b.comp),
kb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mesh, ca, cb ORDER BY w, src, dst) AS r FROM kc) WHERE r = 1), ke AS (SELECT mesh, ca AS src, cb AS dst, w FROM kb), kn AS (SELECT DISTINCT mesh, comp AS n, comp AS c FROM pc)""" + KRUSKAL + "SELECT kb.mesh, kb.src, kb.dst, round(kb.w, 6) AS w FROM tk JOIN kb ON kb.mesh = tk.mesh AND kb.ca = tk.src AND kb.cb = tk.dst",
    "component_edges": NEAR_SQL + NEXT_SQL.format(t="ce") + NEAR_EDGES + ", kn AS (SELECT mesh, id AS n, id AS c FROM ce)" + KRUSKAL + "SELECT tk.mesh, least(a.f, b.f) AS src, greatest(a.f, b.f) AS dst, round(w, 6) AS w FROM tk JOIN rp a ON a.mesh = tk.mesh AND a.comp = src JOIN rp b ON b.mesh = tk.mesh AND b.comp = dst",
    "mst_edges": LINK_SQL + ", ke AS (SELECT mesh, src, dst, min(w)::DOUBLE AS w FROM lk WHERE src < dst GROUP BY ALL), kn AS (SELECT mesh, src AS n, src AS c FROM lk UNION SELECT mesh, dst, dst FROM lk)" + KRUSKAL + "SELECT mesh, src, dst, w FROM tk",
    "component_chain": GRID_SQL + ", c AS (SELECT mesh, comp, min(f) AS f FROM cmp GROUP BY ALL) SELECT * FROM (SELECT mesh, f AS src, lead(f) OVER (PARTITION BY mesh ORDER BY comp) AS dst FROM c) WHERE dst IS NOT NULL",
    "index_merge": "WITH e AS (SELECT vec_id AS id, round(embedding[4]::DOUBLE + 0.5, 6) AS value FROM embeddings) SELECT p_partkey, p_partkey % 60 - 1 AS idx, coalesce(value, 0)::DOUBLE AS value FROM part LEFT JOIN e ON e.id = p_partkey % 60 - 1",
    "vector_functions": "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({'sin' if i % 2 == 0 else 'cos'}(l_discount * 2 * pi() / pow(10000, {2 * (i // 2) / 4})), 6) AS w{i}" for i in range(4)) + ", round(ln(greatest(l_discount, 1e-3) / greatest(1 - l_discount, 1e-3)), 6) AS logit, round(least(greatest((l_discount * 100 - l_tax * 50 + 3 * l_quantity) / sqrt(3), -12), 12), 6) AS score FROM lineitem",
    "masked_mean": "SELECT l_suppkey, round(coalesce(avg(l_tax) FILTER (l_discount > 0.095::DOUBLE), 0), 6) AS mean FROM lineitem GROUP BY ALL",
    "canonical_text": "SELECT p_partkey, trim(regexp_replace(lower(translate(replace(' The_' || p_name || ' (No. 5)!,  ' || p_brand, '_', ' '), '!\"#$%&''()*+,-./:;<=>?@[\\]^`{|}~', '')), '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM part",
    "pretokenise": "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '" + text.PIECES.replace("'", "''") + "')) AS token FROM documents) SELECT doc_id, count(*) AS n, count(DISTINCT token) AS kinds, max(token) AS last FROM t GROUP BY doc_id",
    "unescaped_text": "SELECT p_partkey, trim(regexp_replace('a & b  ' || p_name || ' <i> ', ' +', ' ', 'g')) AS text FROM part",
    "colour_text": "SELECT p_partkey, round(CASE p_size % 3 WHEN 0 THEN p_size / 255 WHEN 1 THEN 0.5 ELSE 1 END, 6)::DOUBLE AS r, round(CASE p_size % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.25 ELSE 1 END, 6)::DOUBLE AS g, 1.0::DOUBLE AS b FROM part",
    "source_options": "SELECT p_partkey, 'fast_' || p_size || ',slow' AS found FROM part",
    "obj_round_trip": GRID_SQL + ", st AS (SELECT fc.mesh, fc.f, coalesce(label, 0) AS label FROM fc LEFT JOIN lb USING (mesh, f)) SELECT mesh, (SELECT count(*) FROM vt WHERE vt.mesh = st.mesh) AS vertices, count(*) AS faces, count(DISTINCT label) AS materials, (SELECT round(sum(z), 4) FROM vt WHERE vt.mesh = st.mesh) AS z, sum(v[1] + v[2] + v[3])::BIGINT AS corners FROM st JOIN fc USING (mesh, f) GROUP BY mesh",
    "ply_round_trip": GRID_SQL + "SELECT mesh, v::BIGINT AS v, x, y, z FROM vt",
    **{f"{k}_file_round_trip": GRID_SQL + "SELECT o.mesh, o.f, (o.i - 1)::INT AS corner, x, y, round(z, 4) AS z FROM (SELECT mesh, f, generate_subscripts(v, 1) AS i, unnest(v) AS v FROM fc) o JOIN vt ON vt.mesh = o.mesh AND vt.v = o.v" for k in FILES},
    "label_json_round_trip": GRID_SQL + "SELECT mesh, f, label FROM lb",
    "change_rows": GRID_SQL + ", o AS (SELECT lb.mesh, label, v, row_number() OVER w AS id, lag(label) OVER w AS before FROM lb JOIN fc USING (mesh, f) WINDOW w AS (PARTITION BY lb.mesh ORDER BY label, lb.f)) SELECT mesh, id::INT AS id, CASE WHEN before IS DISTINCT FROM label THEN 'usemtl label_' || label || chr(10) ELSE '' END || 'f ' || (v[1] + 1) || ' ' || (v[2] + 1) || ' ' || (v[3] + 1) AS line FROM o",
    "label_gaps": GRID_SQL + "SELECT mesh, count(DISTINCT f) AS faces, max(f) AS last FROM lb GROUP BY mesh HAVING min(f) <> 0 OR max(f) + 1 <> count(DISTINCT f)",
    "anti_processed": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'F')",
    "natural_order": "SELECT page_id, page_id::INT AS place FROM pages",
    "scene_flatten": GRID_SQL + "SELECT 's' AS scene, mesh::VARCHAR AS name, v, round(x + 10 * mesh, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM vt",
}
