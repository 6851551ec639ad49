"""Meshes as vertices (by, v, x, y, z) and faces (by, f, v array<int>): boxes, poses, transfers, sampling, paths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetflow.operators.labels import edges
from facetflow.session import cut

BY = ("mesh",)
AXES = ("x", "y", "z")


# --- rows of arithmetic -------------------------------------------------------------------------

def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a: list[Column], b: list[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def length(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def transformed(points: DataFrame, pose: Column, snap: float = 1e-6) -> DataFrame:
    """Points moved by a row-major 4 x 4 pose; one within `snap` of the identity leaves them as they are."""
    unit = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]
    same = F.lit(True)
    for i, u in enumerate(unit):
        same = same & (F.abs(pose[i] - u) < snap)
    p = [F.col(c) for c in AXES]
    return points.withColumns({c: F.when(same, F.col(c)).otherwise(dot([pose[4 * i + k] for k in range(3)], p) + pose[4 * i + 3]) for i, c in enumerate(AXES)})


def look_at(eye: list[Column], target: list[Column], up: tuple[float, float, float] = (0.0, 1.0, 0.0), nudge: float = 1e-6) -> Column:
    """Row-major camera-to-world pose that looks from eye to target along -z; where the view is along up, the eye is moved by `nudge` on each axis, also in the pose."""
    ups = [F.lit(u) for u in up]
    flat = F.greatest(*[F.abs(c) for c in cross(minus(target, eye), ups)]) < nudge
    eye = [F.when(flat, c + nudge).otherwise(c) for c in eye]
    back = minus(eye, target)
    size = length(back)
    z = [c / size for c in back]
    x = cross(ups, z)
    n = length(x)
    x = [c / n for c in x]
    y = cross(z, x)
    rows = [[x[i], y[i], z[i], eye[i]] for i in range(3)]
    return F.array(*[c.cast("double") for r in rows for c in r], *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])


def turned_convention(pose: Column) -> Column:
    """A pose between the conventions that differ in the signs of the y and z axes."""
    return F.transform(pose, lambda m, i: F.when((i % 4 == 1) | (i % 4 == 2), -m).otherwise(m))


def discretised(x: Column, low: float, high: float, steps: int) -> Column:
    """Index of the nearest of `steps` places over [low, high]; halves go to the even one."""
    return F.bround((x - low) / (high - low) * (steps - 1)).cast("int")


def undiscretised(i: Column, low: float, high: float, steps: int) -> Column:
    return i / F.lit(steps - 1) * (high - low) + low


def decimation_target(faces: Column, ratio: float | None = None, target: int | None = None) -> tuple[Column, Column]:
    """(faces to leave, share to remove within [0, 0.99])."""
    goal = F.lit(target) if target is not None else F.floor(faces * ratio)
    return goal.cast("int"), F.least(F.greatest(1 - goal / faces, F.lit(0.0)), F.lit(0.99))


def box_corners(centre: list[Column], size: list[Column], yaw: Column) -> Column:
    """The eight corners of a box turned about z, as an array of structs."""
    out = []
    for i in range(8):
        dx, dy, dz = [(1 if i >> k & 1 else -1) * s / 2 for k, s in enumerate(size)]
        out.append(F.struct((centre[0] + dx * F.cos(yaw) - dy * F.sin(yaw)).alias("x"), (centre[1] + dx * F.sin(yaw) + dy * F.cos(yaw)).alias("y"), (centre[2] + dz).alias("z")))
    return F.array(*out)


# --- sets of cameras ----------------------------------------------------------------------------

def cameras(spark: SparkSession, kind: str, n: int = 0, radius: float = 1.0, elevation: float = 20.0) -> DataFrame:
    """(camera, x, y, z) on a sphere. kind: the corners of tetra (4), octa (6), cube (8), icosa (12) or dodeca (20);
    standard: n azimuths each above and below, and both poles (2n + 2); swirl: n on a spiral from pole to pole."""
    g, h = (1 + math.sqrt(5)) / 2, 2 / (1 + math.sqrt(5))
    signs = (1.0, -1.0)
    rings = {
        "tetra": [(1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1)],
        "octa": [tuple(s if k == a else 0 for k in range(3)) for a in range(3) for s in signs],
        "cube": [(a, b, c) for a in signs for b in signs for c in signs],
        "icosa": [p for a in signs for b in signs for p in ((0, a, b * g), (a, b * g, 0), (b * g, 0, a))],
    }
    rings["dodeca"] = rings["cube"] + [p for a in signs for b in signs for p in ((0, a * h, b * g), (a * h, b * g, 0), (b * g, 0, a * h))]
    if kind in rings:
        points = rings[kind]
    elif kind == "standard":
        e = math.radians(elevation)
        points = [(math.cos(2 * math.pi * i / n) * math.cos(e), math.sin(2 * math.pi * i / n) * math.cos(e), s * math.sin(e)) for s in signs for i in range(n)] + [(0, 0, 1), (0, 0, -1)]
    elif kind == "swirl":
        polar = [math.pi * (i + 0.5) / n for i in range(n)]
        points = [(math.sin(t) * math.cos(8 * t), math.sin(t) * math.sin(8 * t), math.cos(t)) for t in polar]
    else:
        raise ValueError(f"no camera set {kind}")
    rows = []
    for i, p in enumerate(points):
        size = math.sqrt(sum(c * c for c in p))
        rows.append((i, *[float(c) / size * radius for c in p]))
    return spark.createDataFrame(rows, "camera int, x double, y double, z double")


def sphere_cameras(items: DataFrame, key: str, seed: int = 0, radius: float = 1.0) -> DataFrame:
    """(key, x, y, z): a place on the sphere for each key, its two angles evenly by a hash of seed and key."""
    share = lambda name: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(name), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    own = items.select(key, (share("turn") * 2 * math.pi).alias("turn"), (share("polar") * math.pi).alias("polar"))
    return own.select(key, (radius * F.sin("polar") * F.cos("turn")).alias("x"), (radius * F.sin("polar") * F.sin("turn")).alias("y"), (radius * F.cos("polar")).alias("z"))


# --- meshes -------------------------------------------------------------------------------------

def bounding_box(points: DataFrame, by=BY) -> DataFrame:
    return points.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in AXES]).withColumns({f"centre_{c}": (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in AXES})


def normalised(points: DataFrame, mode: str = "cube", by=BY) -> DataFrame:
    """Points about the centre of their box. cube: by the largest coordinate, to 0.999; extent: longest side 1.8; half: by 1.001 half longest sides."""
    box = bounding_box(points, by)
    centred = points.join(box, list(by)).withColumns({c: F.col(c) - F.col(f"centre_{c}") for c in AXES})
    extent = F.greatest(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in AXES])
    if mode == "cube":
        most = centred.groupBy(*by).agg(F.max(F.greatest(*[F.abs(c) for c in AXES])).alias("most"))
        centred, scale = centred.join(most, list(by)), (1 - 1e-3) / F.when(F.col("most") > 0, F.col("most")).otherwise(1.0)
    elif mode == "extent":
        scale = 1.8 / F.when(extent > 0, extent).otherwise(1.0)
    elif mode == "half":
        scale = 1 / (F.when(extent > 0, extent).otherwise(1.0) / 2 * 1.001)
    else:
        raise ValueError("mode is cube, extent or half")
    return centred.select(*by, "v", *[(F.col(c) * scale).alias(c) for c in AXES])


def normalised_by_area(points: DataFrame, faces: DataFrame, by=BY) -> DataFrame:
    """Points about the mean of the faces' centres by area (of the points' box where no face has any), over the longest side of their box."""
    shape = face_shapes(faces, points, by)
    middle = shape.groupBy(*by).agg(F.sum("area").alias("_a"), *[F.sum(F.col("area") * F.col(f"c{c}")).alias(f"_{c}") for c in AXES])
    box = bounding_box(points, by).join(middle, list(by), "left")
    side = F.greatest(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in AXES])
    own = points.join(box, list(by))
    return own.select(*by, "v", *[((F.col(c) - F.when(F.col("_a") > 0, F.col(f"_{c}") / F.col("_a")).otherwise(F.col(f"centre_{c}"))) / F.when(side > 0, side).otherwise(1.0)).alias(c) for c in AXES])


def triangles(polygons: DataFrame, by=BY) -> DataFrame:
    """(by, tri, f, v): fans from the first corner; polygons of fewer than three corners give none but keep their number."""
    fan = F.expr("transform(sequence(1, size(v) - 2), i -> array(v[0], v[i], v[i + 1]))")
    own = polygons.where(F.size("v") >= 3).select(*by, "f", F.posexplode(fan).alias("k", "t"))
    before = own.groupBy(*by, "f").agg(F.count("*").alias("n")).withColumn("first", F.sum("n").over(Window.partitionBy(*by).orderBy("f").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    return own.join(before, [*by, "f"]).select(*by, (F.col("first") + F.col("k")).alias("tri"), "f", F.col("t").alias("v"))


def remapped(pixels: DataFrame, tri_map: DataFrame, by=BY) -> DataFrame:
    """Pixels' triangle numbers f as polygon numbers; those past the end take the last one, -1 stays."""
    last = tri_map.groupBy(*by).agg(F.max("tri").alias("last"))
    keyed = pixels.join(last, list(by), "left").withColumn("tri", F.least("f", "last"))
    return keyed.drop("f").join(tri_map.select(*by, "tri", "f"), [*by, "tri"], "left").withColumn("f", F.coalesce("f", F.lit(-1))).drop("tri", "last")


def valid_ids(f: Column, count: Column) -> Column:
    """Face numbers of pixels; those outside [-1, count) are -1."""
    return F.when((f >= -1) & (f < count), f).otherwise(F.lit(-1))


def corners(faces: DataFrame, vertices: DataFrame, by=BY) -> DataFrame:
    """(by, f, place, v, x, y, z): each face's corners; also the mesh with vertices of its own for each corner."""
    return faces.select(*by, "f", F.posexplode("v").alias("place", "v")).join(vertices, [*by, "v"])


def face_shapes(faces: DataFrame, vertices: DataFrame, by=BY) -> DataFrame:
    """(by, f, area, cx, cy, cz, nx, ny, nz): area and unit normal by the fan's cross products, and the mean corner."""
    at = F.transform(F.array_sort(F.collect_list(F.struct("place", *AXES))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z")))
    own = corners(faces, vertices, by).groupBy(*by, "f").agg(at.alias("p"))
    normal = {}
    for c, (a, b) in {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}.items():
        normal[c] = F.expr(f"aggregate(sequence(1, size(p) - 2), 0D, (s, i) -> s + (p[i].{a} - p[0].{a}) * (p[i + 1].{b} - p[0].{b}) - (p[i].{b} - p[0].{b}) * (p[i + 1].{a} - p[0].{a}))")
    twice = F.expr(
        "aggregate(sequence(1, size(p) - 2), 0D, (s, i) -> s + sqrt("
        + " + ".join(f"pow((p[i].{a} - p[0].{a}) * (p[i + 1].{b} - p[0].{b}) - (p[i].{b} - p[0].{b}) * (p[i + 1].{a} - p[0].{a}), 2)" for a, b in (("y", "z"), ("z", "x"), ("x", "y")))
        + "))"
    )
    mean = lambda c: F.expr(f"aggregate(p, 0D, (s, q) -> s + q.{c}) / size(p)")
    own = own.where(F.size("p") >= 3).select(*by, "f", (twice / 2).alias("area"), *[mean(c).alias(f"c{c}") for c in AXES], *[normal[c].alias(f"n{c}") for c in AXES])
    size = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    return own.withColumns({f"n{c}": F.when(size > 0, F.col(f"n{c}") / size).otherwise(0.0) for c in AXES})


def side_angles(faces: DataFrame, shapes: DataFrame, by=BY) -> DataFrame:
    """(by, src, dst, angle), src < dst: the angle between the normals of two faces on a side of exactly two."""
    pairs = edges(faces, by).groupBy(*by, "a", "b").agg(F.count("*").alias("n"), F.min("f").alias("src"), F.max("f").alias("dst")).where("n = 2").select(*by, "src", "dst").distinct()
    one = shapes.select(*by, F.col("f").alias("src"), *[F.col(f"n{c}").alias(f"a{c}") for c in AXES])
    two = shapes.select(*by, F.col("f").alias("dst"), *[F.col(f"n{c}").alias(f"b{c}") for c in AXES])
    d = sum((F.col(f"a{c}") * F.col(f"b{c}") for c in AXES[1:]), F.col("ax") * F.col("bx"))
    return pairs.join(one, [*by, "src"]).join(two, [*by, "dst"]).select(*by, "src", "dst", F.acos(F.least(F.greatest(d, F.lit(-1.0)), F.lit(1.0))).alias("angle"))


def sharpest(sides: DataFrame, faces: DataFrame, by=BY) -> DataFrame:
    """(by, f, value): each face's largest angle over pi, 0 where there is none, within [0, 1]."""
    both = sides.select(*by, F.col("src").alias("f"), "angle").unionByName(sides.select(*by, F.col("dst").alias("f"), "angle"))
    most = both.groupBy(*by, "f").agg(F.max(F.nanvl("angle", F.lit(0.0))).alias("angle"))
    return faces.select(*by, "f").join(most, [*by, "f"], "left").select(*by, "f", F.least(F.greatest(F.coalesce("angle", F.lit(0.0)) / math.pi, F.lit(0.0)), F.lit(1.0)).alias("value"))


def face_to_vertex(values: DataFrame, faces: DataFrame, scaled: bool = False, by=BY) -> DataFrame:
    """(by, v, value): mean of the values (by, f, value) of a vertex's faces; scaled: to [0, 1] over the mesh."""
    own = faces.select(*by, "f", F.explode("v").alias("v")).join(values, [*by, "f"]).groupBy(*by, "v").agg(F.avg("value").alias("value"))
    return min_max(own, by) if scaled else own


def min_max(values: DataFrame, by=BY, eps: float = 1e-8) -> DataFrame:
    """The column value to [0, 1] over each mesh; nulls and NaN count as 0."""
    clean = values.withColumn("value", F.nanvl(F.coalesce("value", F.lit(0.0)), F.lit(0.0)))
    ends = clean.groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return clean.join(ends, list(by)).withColumn("value", F.when(F.col("high") - F.col("low") > eps, (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)).drop("low", "high")


def diameter_scale(values: DataFrame, by=BY) -> DataFrame:
    """Shape diameters on a log scale: min-max, then ln(4 s + 1) / ln 5."""
    return min_max(values, by).withColumn("value", F.log(4 * F.col("value") + 1) / math.log(5))


def at_pixels(pixels: DataFrame, faces: DataFrame, values: DataFrame, by=BY) -> DataFrame:
    """(by, view, py, px, value): pixels (.., f, w array<double>) take the barycentric mean of their triangle's vertex values; background takes 0."""
    at = faces.select(*by, "f", F.posexplode("v").alias("k", "v")).join(values, [*by, "v"], "left")
    at = at.groupBy(*by, "f").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda s: s["value"]).alias("_v"))  # once a face
    mean = F.aggregate(F.zip_with("w", "_v", lambda w, v: F.coalesce(w * v, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return pixels.join(at, [*by, "f"], "left").select(*by, "view", "py", "px", F.coalesce(F.when(F.col("f") >= 0, mean), F.lit(0.0)).alias("value"))


def cut_vertices(faces: DataFrame, labels: DataFrame, by=BY) -> DataFrame:
    """(by, v): ends of the sides whose first two faces, by number, differ in label; sides of one face count for nothing."""
    own = edges(faces, by).join(labels, [*by, "f"]).groupBy(*by, "a", "b").agg(F.array_sort(F.collect_list(F.struct("f", "label"))).alias("on"))
    cuts = own.where((F.size("on") >= 2) & (F.get("on", F.lit(0))["label"] != F.get("on", F.lit(1))["label"]))
    return cuts.select(*by, F.explode(F.array("a", "b")).alias("v")).distinct()


def average_radius(shapes: DataFrame, by=BY) -> DataFrame:
    """(by, radius): area-weighted mean distance of face centres from the surface's centroid."""
    mean = shapes.groupBy(*by).agg(*[(F.sum(F.col("area") * F.col(f"c{c}")) / F.sum("area")).alias(f"m{c}") for c in AXES])
    far = length([F.col(f"c{c}") - F.col(f"m{c}") for c in AXES])
    return shapes.join(mean, list(by)).groupBy(*by).agg((F.sum(F.col("area") * far) / F.sum("area")).alias("radius"))


def side_lengths(faces: DataFrame, vertices: DataFrame, by=BY) -> DataFrame:
    """(by, src, dst, length) of all sides, both ways, between vertices."""
    ends = edges(faces, by).select(*by, "a", "b").distinct()
    p, q = vertices.select(*by, F.col("v").alias("a"), *[F.col(c).alias(f"p{c}") for c in AXES]), vertices.select(*by, F.col("v").alias("b"), *[F.col(c).alias(f"q{c}") for c in AXES])
    own = ends.join(p, [*by, "a"]).join(q, [*by, "b"]).select(*by, "a", "b", length([F.col(f"p{c}") - F.col(f"q{c}") for c in AXES]).alias("length"))
    return own.select(*by, F.col("a").alias("src"), F.col("b").alias("dst"), "length").unionByName(own.select(*by, F.col("b").alias("src"), F.col("a").alias("dst"), "length"))


def distances(sources: DataFrame, sides: DataFrame, rounds: int = 10_000, by=BY) -> DataFrame:
    """(by, v, d): length of the shortest way from the nearest source. Each round relaxes the vertices that came nearer in the last one; RuntimeError if `rounds` don't end it."""
    best = cut(sources.select(*by, "v", F.lit(0.0).alias("d")).distinct())
    moved = best
    for _ in range(rounds):
        new = moved.withColumnRenamed("v", "src").join(sides, [*by, "src"]).groupBy(*by, F.col("dst").alias("v")).agg(F.min(F.col("d") + F.col("length")).alias("n"))
        moved = cut(new.join(best, [*by, "v"], "left").where(F.col("d").isNull() | (F.col("n") < F.col("d") - 1e-12)).select(*by, "v", F.col("n").alias("d")))
        if moved.isEmpty():
            return best
        best = cut(best.join(moved.withColumnRenamed("d", "n"), [*by, "v"], "full").select(*by, "v", F.coalesce("n", "d").alias("d")))
    raise RuntimeError(f"distances not found in {rounds} rounds")


def cut_discrepancy(faces: DataFrame, vertices: DataFrame, est: DataFrame, ref: DataFrame, by=BY) -> DataFrame:
    """(by, value): mean distance over the surface's sides between the cuts of two labellings, in average radii; 0 where either has none."""
    sides = cut(side_lengths(faces, vertices, by))
    one, two = cut(cut_vertices(faces, est, by)), cut(cut_vertices(faces, ref, by))
    ways = []
    for a, b in ((one, two), (two, one)):
        ways.append(a.join(distances(b, sides, by=by), [*by, "v"]).groupBy(*by).agg(F.sum("d").alias("d"), F.count("*").alias("n")))
    both = ways[0].join(ways[1].withColumnRenamed("d", "d2").withColumnRenamed("n", "n2"), list(by))
    return average_radius(face_shapes(faces, vertices, by), by).join(both, list(by), "left").select(*by, F.coalesce((F.col("d") + F.col("d2")) / (F.col("n") + F.col("n2")) / F.col("radius"), F.lit(0.0)).alias("value"))


def surface_samples(faces: DataFrame, vertices: DataFrame, n: int, seed: int = 0, by=BY) -> DataFrame:
    """(by, f, k, x, y, z): n points on each triangle, evenly spread, by a hash of face and number."""
    p = corners(faces, vertices, by).groupBy(*by, "f").agg(F.array_sort(F.collect_list(F.struct("place", *AXES))).alias("p"))
    u = lambda k: F.pmod(F.xxhash64(*by, "f", "k", F.lit(seed + k)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    own = p.select(*by, "f", "p", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).withColumn("a", F.sqrt(u(1))).withColumn("b", u(2))
    at = lambda i, c: F.get("p", F.lit(i))[c]
    return own.select(*by, "f", "k", *[((1 - F.col("a")) * at(0, c) + F.col("a") * (1 - F.col("b")) * at(1, c) + F.col("a") * F.col("b") * at(2, c)).alias(c) for c in AXES])


def cleaned_mesh(vertices: DataFrame, faces: DataFrame, cell: float, by=BY) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) with vertices of one grid cell merged into the least of them, faces that lost a corner or repeat another's corners left out (the least stays), and vertices that no face names."""
    place = [F.floor(F.col(c) / cell) for c in AXES]
    near = vertices.select(*by, "v", F.min("v").over(Window.partitionBy(*by, *place)).alias("to"))
    corners = faces.select(*by, "f", F.posexplode("v").alias("i", "v")).join(near, [*by, "v"])
    own = corners.groupBy(*by, "f").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "to"))), lambda s: s["to"]).alias("v"))
    own = own.where(F.size(F.array_distinct("v")) == F.size("v"))
    own = own.withColumn("_r", F.row_number().over(Window.partitionBy(*by, F.array_sort("v")).orderBy("f"))).where("_r = 1").drop("_r")
    used = own.select(*by, F.explode("v").alias("v")).distinct()
    return vertices.join(used, [*by, "v"], "left_semi"), own
