"""Feature vectors of faces and points: norms, planes, voxels, neighbours, clusters."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetflow.operators.graph import components
from facetflow.session import cut

TREE = 200_000  # edges up to which a unit's may meet in one task

def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalised(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))


def numbered_columns(df: DataFrame, prefix: str = "features_") -> Column:
    """Columns prefix0, prefix1 ... as one array, in the order of their numbers."""
    own = sorted((c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))
    return F.array(*[F.col(c) for c in own])


def mean_by(points: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    """(keys, v): mean vector of each group, element by element."""
    each = points.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))


def pca_colours(vectors: DataFrame, key: str = "id", vector: str = "v", parts: int = 3) -> DataFrame:
    """(key, colour array<int>): principal components of normalised and centred rows, all components scaled together to 0..255."""
    unit = vectors.select(key, l2_normalised(F.col(vector)).alias("u"))
    mean = unit.select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    centred = unit.join(F.broadcast(mean)).select(key, array_to_vector(F.zip_with("u", "mean", lambda a, b: a - b)).alias("c"))  # one row of statistics
    out = PCA(k=parts, inputCol="c", outputCol="p").fit(centred).transform(centred).select(key, vector_to_array("p").alias("p"))
    ends = out.agg(F.min(F.array_min("p")).alias("low"), F.max(F.array_max("p")).alias("high"))
    return out.join(F.broadcast(ends)).select(key, F.transform("p", lambda x: F.floor((x - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-12)) * 255).cast("int")).alias("colour"))


def k_means(vectors: DataFrame, k: int, starts: int = 3, rounds: int = 100, seed: int = 0, key: str = "id", vector: str = "v") -> DataFrame:
    """(key, cluster) of the cheapest of some starts; clusters are numbered by their least key."""
    rows = cut(vectors.select(key, array_to_vector(l2_normalised(F.col(vector))).alias("u")))
    models = [KMeans(k=k, seed=seed + i, maxIter=rounds, featuresCol="u", predictionCol="c").fit(rows) for i in range(starts)]
    found = min(models, key=lambda m: m.summary.trainingCost).transform(rows).select(key, "c")
    order = found.groupBy("c").agg(F.min(key).alias("first"))
    order = order.withColumn("cluster", F.row_number().over(Window.orderBy("first")) - 1)  # k rows
    return found.join(F.broadcast(order), "c").select(key, "cluster")


def k_sweep(vectors: DataFrame, counts: list[int], starts: int = 3, rounds: int = 100, seed: int = 0, key: str = "id", vector: str = "v") -> DataFrame:
    """(k, key, cluster): k_means() for each of several numbers of clusters."""
    out = None
    for k in counts:
        own = cut(k_means(vectors, k, starts, rounds, seed, key, vector).select(F.lit(k).alias("k"), key, "cluster"))
        out = own if out is None else out.unionByName(own)
    return out


def mixture_costs(values: DataFrame, k: int, seed: int = 0, key: str = "id", value: str = "x") -> DataFrame:
    """(key, costs array, label): -ln of each component's posterior for a number, and the cheapest component."""
    rows = values.select(key, array_to_vector(F.array(F.col(value).cast("double"))).alias("u"))
    found = GaussianMixture(k=k, seed=seed, featuresCol="u", probabilityCol="p").fit(rows).transform(rows).select(key, F.transform(vector_to_array("p"), lambda p: -F.log(p + 1e-20)).alias("costs"))
    return found.withColumn("label", (F.array_position("costs", F.array_min("costs")) - 1).cast("int"))


def cell(x: Column, size: int) -> Column:
    """Place of a coordinate in [0, 1) among `size` cells; others go to the nearest end."""
    return F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1 - 1e-5)) * size).cast("int")


def plane_mean(points: DataFrame, size: int, axes: tuple[str, str] = ("x", "y"), value: str = "value", by=("mesh",)) -> DataFrame:
    """(by, cell, value): mean of the points of each cell of a plane; cell = place on the first axis + size * place on the second."""
    at = cell(F.col(axes[0]), size) + size * cell(F.col(axes[1]), size)
    return points.groupBy(*by, at.alias("cell")).agg(F.avg(value).alias("value"))


def pooled(points: DataFrame, size: int, value: str = "value", how: str = "max", by=("mesh",)) -> DataFrame:
    """points with `pooled`: the sum over three planes of the max or mean of the point's cell. Aggregates and joins back, so a crowded cell is no large window."""
    out, fn = points, F.max if how == "max" else F.avg
    for i, (a, b) in enumerate((("x", "y"), ("x", "z"), ("y", "z"))):
        at = cell(F.col(a), size) + size * cell(F.col(b), size)
        own = points.groupBy(*by, at.alias(f"_c{i}")).agg(fn(value).alias(f"_p{i}"))
        out = out.withColumn(f"_c{i}", at).join(own, [*by, f"_c{i}"])
    return out.withColumn("pooled", F.col("_p0") + F.col("_p1") + F.col("_p2")).drop(*[f"_{c}{i}" for c in "cp" for i in range(3)])


def plane_sample(points: DataFrame, grid: DataFrame, size: int, axes: tuple[str, str] = ("x", "y"), by=("mesh",), key: str = "id") -> DataFrame:
    """(by, key, value): bilinear value of the grid (by, i, j, value; i, j from 0) at a point whose coordinates in [0, 1] span the cells' centres; beyond the border it takes the border's."""
    spot = lambda c: F.least(F.greatest(F.col(c) * (size - 1), F.lit(0.0)), F.lit(float(size - 1)))
    own = points.select(*by, key, spot(axes[0]).alias("u"), spot(axes[1]).alias("w"))
    low = own.withColumn("i0", F.least(F.floor("u"), F.lit(max(size - 2, 0)))).withColumn("j0", F.least(F.floor("w"), F.lit(max(size - 2, 0))))
    near = low.select("*", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("s"))
    weight = (1 - F.abs(F.col("u") - F.col("i"))) * (1 - F.abs(F.col("w") - F.col("j")))
    near = near.withColumn("i", (F.col("i0") + F.col("s.a")).cast("int")).withColumn("j", (F.col("j0") + F.col("s.b")).cast("int"))
    return near.join(grid, [*by, "i", "j"]).groupBy(*by, key).agg(F.sum(weight * F.col("value")).alias("value"))


def planes_sample(points: DataFrame, grids: dict[str, DataFrame], size: int, by=("mesh",), key: str = "id") -> DataFrame:
    """(by, key, value): the sum of plane_sample() over planes, each named by its two axes (xy, yz, xz) with its own grid."""
    out = None
    for axes, grid in grids.items():
        own = plane_sample(points, grid, size, tuple(axes), by, key)
        out = own if out is None else out.unionByName(own)
    return out.groupBy(*by, key).agg(F.sum("value").alias("value"))


def voxel_mean(points: DataFrame, size: int, value: str = "value", by=("mesh",)) -> DataFrame:
    """(by, vx, vy, vz, value): mean of the points whose coordinates in [0, 1], times size - 1, round (halves to even) to the voxel."""
    at = {f"v{c}": F.bround(F.least(F.greatest(F.col(c) * (size - 1), F.lit(0.0)), F.lit(float(size - 1)))).cast("int") for c in ("x", "y", "z")}
    return points.groupBy(*by, *[e.alias(n) for n, e in at.items()]).agg(F.avg(value).alias("value"))


def voxel_sample(points: DataFrame, voxels: DataFrame, size: int, by=("mesh",), key: str = "id") -> DataFrame:
    """(by, key, value): trilinear value of the voxels at points in [0, 1]; voxels without a row are 0."""
    spot = lambda c: F.least(F.greatest(F.col(c) * (size - 1), F.lit(0.0)), F.lit(float(size - 1)))
    own = points.select(*by, key, *[spot(c).alias(f"p{c}") for c in ("x", "y", "z")])
    corners = F.array(*[F.struct(*[F.lit(k >> i & 1).alias(c) for i, c in enumerate(("x", "y", "z"))]) for k in range(8)])
    near = own.select("*", F.explode(corners).alias("s"))
    for c in ("x", "y", "z"):
        near = near.withColumn(f"v{c}", (F.least(F.floor(f"p{c}"), F.lit(max(size - 2, 0))) + F.col(f"s.{c}")).cast("int"))
    weight = F.lit(1.0)
    for c in ("x", "y", "z"):
        weight = weight * (1 - F.abs(F.col(f"p{c}") - F.col(f"v{c}")))
    sums = near.join(voxels, [*by, "vx", "vy", "vz"], "left").groupBy(*by, key).agg(F.sum(weight * F.coalesce("value", F.lit(0.0))).alias("value"))
    return sums


def within(points: DataFrame, centres: DataFrame, radius: float, k: int, by=("mesh",)) -> DataFrame:
    """(by, centre, id, dx, dy, dz, rank): the k nearest points (ties: the smaller id) within the radius of each centre.

    A grid of the radius's size makes this an equi-join over the 27 cells about a centre.
    """
    axes = ("x", "y", "z")
    own = points.select(*by, "id", *axes, *[F.floor(F.col(c) / radius).cast("int").alias(f"g{c}") for c in axes])
    steps = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit(c).alias("z")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    near = centres.select(*by, F.col("id").alias("centre"), *[F.col(c).alias(f"c{c}") for c in axes], F.explode(steps).alias("s")).select("*", *[(F.floor(F.col(f"c{c}") / radius) + F.col(f"s.{c}")).cast("int").alias(f"g{c}") for c in axes]).drop("s")
    both = near.join(own, [*by, "gx", "gy", "gz"]).select(*by, "centre", "id", *[(F.col(c) - F.col(f"c{c}")).alias(f"d{c}") for c in axes])
    d2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")
    order = Window.partitionBy(*by, "centre").orderBy("d2", "id")
    return both.withColumn("d2", d2).where(F.col("d2") <= radius * radius).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("d2")


def nearest(points: DataFrame, k: int, by=("mesh",)) -> DataFrame:
    """(by, id, other, d2, rank): the k nearest other points of each (by, id, x, y, z), ties to the smaller id; all where there are fewer. Exact.

    An equi-join over the 27 grid cells about a point, of a cell size by the density of its unit. Whatever lies outside them is a cell's side
    away at least, so a point whose k-th neighbour is nearer is done; the others are looked at again with cells twice as wide, at last
    with all of the unit in the 27. A join's hot cells are split by Spark (adaptive skew joins).
    """
    axes = ("x", "y", "z")
    boxes = points.groupBy(*by).agg(F.count("*").alias("n"), *[F.min(c).alias(f"low_{c}") for c in axes], F.greatest(*[F.max(c) - F.min(c) for c in axes]).alias("side"))
    parts = F.greatest(F.lit(1.0), F.floor(F.sqrt(F.col("n") / (4 * k))))
    own = cut(points.select(*by, "id", *axes).join(boxes, list(by)).withColumn("cell", F.when(F.col("side") > 0, F.col("side") / parts).otherwise(1.0)).drop("side"))
    steps = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit(c).alias("z")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    apart = {c: F.col(c) - F.col(f"c{c}") for c in axes}
    d2 = apart["x"] * apart["x"] + apart["y"] * apart["y"] + apart["z"] * apart["z"]
    asked, done, wide = own, None, 1
    while True:
        grid = {c: F.floor((F.col(c) - F.col(f"low_{c}")) / (F.col("cell") * wide)) for c in axes}
        place = own.select(*by, F.col("id").alias("other"), *axes, *[g.alias(f"g{c}") for c, g in grid.items()])
        near = asked.select(*by, "id", "n", "cell", *[F.col(c).alias(f"c{c}") for c in axes], *[g.alias(f"o{c}") for c, g in grid.items()], F.explode(steps).alias("s"))
        near = near.select(*by, "id", "n", "cell", *[f"c{c}" for c in axes], *[(F.col(f"o{c}") + F.col(f"s.{c}")).alias(f"g{c}") for c in axes])
        pairs = near.join(place, [*by, *[f"g{c}" for c in axes]], "left").where(F.col("other").isNull() | (F.col("other") != F.col("id"))).withColumn("d2", d2)
        order = Window.partitionBy(*by, "id").orderBy(F.asc_nulls_last("d2"), "other")
        found = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        whole = F.least(F.lit(k), F.col("n") - 1)
        ends = found.groupBy(*by, "id").agg(F.count("other").alias("has"), F.max("d2").alias("far"), F.first("cell").alias("side"), F.first("n").alias("n"))
        sure = (F.col("has") >= whole) & ((F.col("far") <= F.pow(F.col("side") * wide, 2)) | (F.col("n") - 1 <= F.col("has")))
        ends = cut(ends.select(*by, "id", sure.alias("sure")))
        fresh = found.join(ends.where("sure"), [*by, "id"]).where(F.col("other").isNotNull()).select(*by, "id", "other", "d2", "rank")
        done = fresh if done is None else done.unionByName(fresh)
        left = asked.join(ends.where("sure"), [*by, "id"], "left_anti")
        left = left.where(F.col("n") > 1)
        if (most := left.agg(F.max(F.col("n"))).first()[0]) is None:
            return done
        done, asked, wide = cut(done), cut(left), wide * 2
        if wide > 4 * most:
            raise RuntimeError("points with coordinates that aren't numbers have no neighbours")


def spanning_tree(edges: DataFrame, by=("mesh",), parts: DataFrame | None = None) -> DataFrame:
    """(by, src, dst, w) of the minimum spanning forest of edges (by, src, dst, w; src < dst), by Boruvka's rounds; ties go to the smaller ends, so the forest is one. parts (by, n, c): nodes that are joined already.

    A round reads only what is left: edges between components, of parallel ones the least, under the components' names. Once they are
    few enough for one task a unit's are sorted and joined there.
    """
    own = edges.select(*by, "src", "dst", F.col("w").cast("double").alias("w")).where("src < dst").groupBy(*by, "src", "dst").agg(F.min("w").alias("w"))
    edge = F.struct("w", "src", "dst")
    if parts is None:
        open_ = own.select(*by, F.col("src").alias("a"), F.col("dst").alias("b"), edge.alias("e"))
    else:
        a, b = parts.select(*by, F.col("n").alias("src"), F.col("c").alias("ca")), parts.select(*by, F.col("n").alias("dst"), F.col("c").alias("cb"))
        open_ = own.join(a, [*by, "src"], "left").join(b, [*by, "dst"], "left").select(*by, F.coalesce("ca", "src").alias("a"), F.coalesce("cb", "dst").alias("b"), edge.alias("e"))
    slim = lambda df: cut(df.where("a <> b").groupBy(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("e").alias("e")))
    open_, tree = slim(open_), []
    while (count := open_.count()) > TREE:
        best = cut(open_.select(*by, "a", "b", "e", F.explode(F.array("a", "b")).alias("c")).groupBy(*by, "c").agg(F.min_by(F.struct("a", "b", "e"), "e").alias("x")).select(*by, "x.a", "x.b", "x.e").distinct())
        tree.append(best.select(*by, "e.src", "e.dst", "e.w"))
        node = lambda c: F.struct(*by, F.col(c).alias("n"))
        found = components(best.select(node("a").alias("src"), node("b").alias("dst")))
        found = cut(found.select(*[F.col(f"node.{c}") for c in by], F.col("node.n").alias("n"), F.col("component.n").alias("c")))
        ends = [found.withColumnsRenamed({"n": e, "c": f"_{e}"}) for e in "ab"]
        open_ = slim(open_.join(ends[0], [*by, "a"]).join(ends[1], [*by, "b"]).select(*by, F.col("_a").alias("a"), F.col("_b").alias("b"), "e"))
    if count:
        kinds = dict(own.dtypes)

        def joined(batch: pd.DataFrame) -> pd.DataFrame:
            batch = batch.sort_values(["w", "src", "dst"])
            _, at = np.unique(batch[["a", "b"]].to_numpy().ravel(), return_inverse=True)
            parent, taken = list(range(at.max() + 1)), []

            def root(i: int) -> int:
                while parent[i] != i:
                    parent[i] = i = parent[parent[i]]
                return i

            for a, b in at.reshape(-1, 2).tolist():
                a, b = root(a), root(b)
                taken.append(a != b)
                parent[max(a, b)] = min(a, b)
            return batch[taken][[*by, "src", "dst", "w"]]

        rest = open_.select(*by, "a", "b", "e.w", "e.src", "e.dst").groupBy(*by).applyInPandas(joined, ", ".join(f"{c} {kinds[c]}" for c in (*by, "src", "dst", "w")))
        tree.append(cut(rest))
    out = tree[0] if tree else own.limit(0)
    for more in tree[1:]:
        out = out.unionByName(more)
    return out


def joining_edges(points: DataFrame, parts: DataFrame, k: int = 10, by=("mesh",), whole: bool = True) -> DataFrame:
    """(by, src, dst, w): edges that join components: parts (by, f, comp) of points (by, f, x, y, z): of the graph of each point's k nearest others the least ones, by distance, that lead from one component to another.

    Where that graph leaves several components and whole=True, the points nearest the components' centroids are joined the same way, until there is one.
    """
    here = points.select(*by, F.col("f").alias("id"), "x", "y", "z")
    known = cut(parts.select(*by, F.col("f").alias("n"), F.col("comp").alias("c")))
    found = None
    while True:
        near = nearest(here, k, by).select(*by, F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst"), F.sqrt("d2").alias("w"))
        fresh = cut(spanning_tree(near, by, known))
        found = fresh if found is None else cut(found.unionByName(fresh))
        if not whole or fresh.isEmpty():
            return found
        links = fresh.join(known.toDF(*by, "src", "a"), [*by, "src"]).join(known.toDF(*by, "dst", "b"), [*by, "dst"])
        node = lambda c: F.struct(*by, F.col(c).alias("n"))
        joined = components(links.select(node("a").alias("src"), node("b").alias("dst")))
        joined = joined.select(*[F.col(f"node.{c}") for c in by], F.col("node.n").alias("c"), F.col("component.n").alias("to"))
        known = cut(known.join(joined, [*by, "c"], "left").select(*by, "n", F.coalesce("to", "c").alias("c")))
        several = known.groupBy(*by).agg((F.min("c") < F.max("c")).alias("several")).where("several").select(*by)
        if several.isEmpty():
            return found
        own = points.join(known.toDF(*by, "f", "comp"), [*by, "f"]).join(several, list(by), "left_semi")
        here = cut(representatives(own, by).join(points, [*by, "f"]).select(*by, F.col("f").alias("id"), "x", "y", "z"))


def component_edges(points: DataFrame, parts: DataFrame, k: int = 10, by=("mesh",), with_neighbours: bool = False) -> DataFrame:
    """(by, src, dst, w): the spanning tree of each component's k nearest others, by the distance of their centroids, between the faces nearest the centroids; with_neighbours: the whole graph of those neighbours. points (by, f, x, y, z), parts (by, f, comp)."""
    own = points.join(parts.select(*by, "f", "comp"), [*by, "f"])
    centroids = own.groupBy(*by, F.col("comp").alias("id")).agg(*[F.avg(c).alias(c) for c in ("x", "y", "z")])
    near = nearest(centroids, k, by).select(*by, F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst"), F.sqrt("d2").alias("w"))
    edges = near.groupBy(*by, "src", "dst").agg(F.min("w").alias("w")) if with_neighbours else spanning_tree(near, by)
    face = representatives(own, by)
    named = edges.join(face.toDF(*by, "src", "a"), [*by, "src"]).join(face.toDF(*by, "dst", "b"), [*by, "dst"])
    return named.select(*by, F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "w")


def single_linkage(tree: DataFrame, nodes: DataFrame, limit: float, by=("mesh",)) -> DataFrame:
    """(by, n, cluster): clusters of the tree without its edges longer than the limit, named by their least node."""
    node = lambda c: F.struct(*by, F.col(c).alias("n"))
    found = components(tree.where(F.col("w") <= limit).select(node("src").alias("src"), node("dst").alias("dst")))
    found = found.select(*[F.col(f"node.{c}") for c in by], F.col("node.n").alias("n"), F.col("component.n").alias("cluster"))
    return nodes.select(*by, "n").join(found, [*by, "n"], "left").select(*by, "n", F.coalesce("cluster", "n").alias("cluster"))


def dendrogram_cut(merges: DataFrame, nodes: DataFrame, clusters: int, by=("mesh",)) -> DataFrame:
    """(by, n, cluster): merges (by, src, dst, w; a tree's edges) replayed in order of w, src, dst until at most so many clusters of nodes (by, n) are left, named by their least node."""
    sizes = nodes.groupBy(*by).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*by).orderBy("w", "src", "dst")
    done = merges.withColumn("_r", F.row_number().over(order)).join(sizes, list(by)).where(F.col("_r") <= F.col("_n") - clusters)
    return single_linkage(done, nodes, float("inf"), by)


def chained(parts: DataFrame, by=("mesh",)) -> DataFrame:
    """(by, src, dst): edges that join a mesh's components (by, f, comp) to a chain of their least faces."""
    reps = parts.groupBy(*by, "comp").agg(F.min("f").alias("f"))
    order = Window.partitionBy(*by).orderBy("comp")
    return reps.select(*by, F.col("f").alias("src"), F.lead("f").over(order).alias("dst")).where(F.col("dst").isNotNull())


def representatives(points: DataFrame, by=("mesh",)) -> DataFrame:
    """(by, comp, f): of each component (by, f, comp, x, y, z) the face nearest its centroid; ties to the smaller."""
    mean = points.groupBy(*by, "comp").agg(*[F.avg(c).alias(f"m{c}") for c in ("x", "y", "z")])
    d2 = sum(((F.col(c) - F.col(f"m{c}")) ** 2 for c in ("y", "z")), (F.col("x") - F.col("mx")) ** 2)
    return points.join(mean, [*by, "comp"]).groupBy(*by, "comp").agg(F.min_by("f", F.struct(d2.alias("d2"), "f")).alias("f"))


def _touching(x: np.ndarray, a: np.ndarray, b: np.ndarray, linkage: str) -> list[tuple[int, int, float]]:
    """Merges (i, j, distance), i < j the least members, of clusters that touch, the closest two first: from the sides a - b of rows x. A side's distance is its ends'; where two sides become one, their mean by size, the greater or the less. Memory is the sides'."""
    ends = np.unique(np.sort(np.stack([a, b], axis=1)[a != b], axis=1), axis=0)
    far = np.sqrt(((x[ends[:, 0]] - x[ends[:, 1]]) ** 2).sum(axis=1))
    near: list[dict[int, float]] = [{} for _ in range(len(x))]
    for i, j, d in zip(*ends.T.tolist(), far.tolist(), strict=True):
        near[i][j] = near[j][i] = d
    waiting = sorted(zip(far.tolist(), *ends.T.tolist(), strict=True))
    size, out = [1] * len(x), []
    while waiting:
        d, i, j = heapq.heappop(waiting)
        if near[i].get(j) != d:  # of clusters that have merged since, or a distance that has changed
            continue
        out.append((i, j, d))
        own, other = near[i], near[j]
        del own[j], other[i]
        for k in own.keys() | other.keys():
            p, q = own.get(k), other.get(k)
            if p is None or q is None:
                new = q if p is None else p
            elif linkage == "average":
                new = (size[i] * p + size[j] * q) / (size[i] + size[j])
            else:
                new = min(p, q) if linkage == "single" else max(p, q)
            near[k].pop(j, None)
            if new != p:
                heapq.heappush(waiting, (new, min(i, k), max(i, k)))
            own[k] = near[k][i] = new
        near[j] = {}
        size[i] += size[j]
    return out


def _chained(x: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (i, j, distance) of all rows by Ward's rule, the closest two first: by chains of nearest neighbours over the clusters' centroids. Memory is the rows'."""
    n = len(x)
    centre, size, least = x.astype(float).copy(), np.ones(n), np.arange(n)
    live, chain, out = np.ones(n, dtype=bool), [], []

    def apart(i: int) -> np.ndarray:
        d = ((centre - centre[i]) ** 2).sum(axis=1) * (2 * size * size[i] / (size + size[i]))
        d[~live] = np.inf
        d[i] = np.inf
        return d

    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(live)[0]))
        while True:
            d = apart(chain[-1])
            best = d.min()
            # the one before in the chain, where it is as near: else chains could go round
            if len(chain) > 1 and d[chain[-2]] <= best:
                break
            at = np.flatnonzero(d == best)
            chain.append(int(at[np.argmin(least[at])]))
        i, j = sorted((chain.pop(), chain.pop()), key=lambda c: least[c])
        out.append((int(least[i]), int(least[j]), float(np.sqrt(best))))
        centre[i] = (size[i] * centre[i] + size[j] * centre[j]) / (size[i] + size[j])
        size[i] += size[j]
        live[j] = False
    return sorted(out, key=lambda m: (m[2], m[0], m[1]))


def _everywhere(x: np.ndarray, linkage: str) -> list[tuple[int, int, float]]:
    """Merges of all rows, the closest two first, over the matrix of their distances."""
    n = len(x)
    d = np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1), 0))
    np.fill_diagonal(d, np.inf)
    size, out = np.ones(n), []
    for _ in range(n - 1):
        i, j = sorted(divmod(int(d.argmin()), n))
        out.append((i, j, float(d[i, j])))
        new = np.minimum(d[i], d[j]) if linkage == "single" else np.maximum(d[i], d[j]) if linkage == "complete" else (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = new, new
        d[j] = d[:, j] = np.inf
        d[i, i] = np.inf
        size[i] += size[j]
    return out


def merges(vectors: DataFrame, adjacent: DataFrame | None, linkage: str = "average", by=("mesh",)) -> DataFrame:
    """(by, step, src, dst, w): a mesh's vectors (by, f, v) merged, the closest two clusters first, until none are left that may: the dendrogram, clusters named by their least face.

    linkage: average, complete, single or ward. With adjacent (by, src, dst) only clusters that touch may merge, and a distance is one of sides, as a
    sparse graph gives it; ward ignores it. A mesh is one group, as each merge depends on those before, and takes memory by its vectors and sides, but for
    average, complete and single without adjacent, which take the matrix of all distances; meshes are spread over the cluster.
    """
    if linkage not in ("average", "complete", "single", "ward"):
        raise ValueError("linkage is average, complete, single or ward")
    free = adjacent is None or linkage == "ward"
    sides = vectors.select(*by, F.col("f").alias("src"), F.col("f").alias("dst")).limit(0) if free else adjacent
    kinds = dict(vectors.dtypes)

    def run(key: tuple, faces: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
        faces = faces.sort_values("f")
        ids, x = faces["f"].to_numpy(), np.array(faces["v"].tolist(), dtype=float)
        if linkage == "ward":
            found = _chained(x)
        elif free:
            found = _everywhere(x, linkage)
        else:
            known = sides[sides["src"].isin(ids) & sides["dst"].isin(ids)]
            found = _touching(x, np.searchsorted(ids, known["src"].to_numpy()), np.searchsorted(ids, known["dst"].to_numpy()), linkage)
        a, b, w = zip(*found, strict=True) if found else ([], [], [])
        rows = {c: [value] * len(a) for c, value in zip(by, key, strict=True)}
        return pd.DataFrame(rows | {"step": range(len(a)), "src": ids[list(a)], "dst": ids[list(b)], "w": w})

    return vectors.select(*by, "f", "v").groupBy(*by).cogroup(sides.select(*by, "src", "dst").groupBy(*by)).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", step bigint, src bigint, dst bigint, w double")


def cut_to(merges: DataFrame, nodes: DataFrame, counts: list[int], by=("mesh",)) -> DataFrame:
    """(by, clusters, f, cluster): for each of counts the clusters of nodes (by, f) after as many merges() as leave so many, numbered by least face."""
    sizes = nodes.groupBy(*by).agg(F.count("*").alias("n"))
    names = [*by, "clusters"]
    wanted = F.explode(F.array(*[F.lit(c) for c in counts])).alias("clusters")
    done = merges.join(sizes, list(by)).select("*", wanted).where(F.col("step") < F.col("n") - F.col("clusters")).select(*names, "src", "dst", F.lit(0.0).alias("w"))
    own = nodes.select(*by, F.col("f").alias("n"), wanted)
    found = single_linkage(done, own, 0.0, names)
    order = Window.partitionBy(*names).orderBy("cluster")
    return found.select(*names, F.col("n").alias("f"), (F.dense_rank().over(order) - 1).cast("int").alias("cluster"))


def agglomerated(vectors: DataFrame, adjacent: DataFrame | None, clusters: int, linkage: str = "average", by=("mesh",)) -> DataFrame:
    """(by, f, cluster): merges() of a mesh's vectors (by, f, v) until so many clusters are left; numbered by least face."""
    tree = cut(merges(vectors, adjacent, linkage, by))
    return cut_to(tree, vectors, [clusters], by).drop("clusters")


def cosine_neighbours(vectors: DataFrame, k: int, every: int, keys: str = "id", vector: str = "v", rows: int = 4096, queries: int = 1024) -> DataFrame:
    """(query, rank, id, score): of each row whose id is divisible by `every` the k other rows of largest cosine; ties to the smaller id.

    Rows and queries are packed in blocks, of about so many by a hash of their id; each pair of blocks is one matrix product, of which the best k a query are
    handed on. What the product puts within rounding of the k-th is scored again, in one order, so that ties are ties.
    """
    unit = vectors.select(F.col(keys).cast("long").alias("id"), l2_normalised(F.col(vector)).alias("u"))
    asked = unit.where(F.col("id") % every == 0)
    n, m = unit.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
    blocks, lots = -(-n // rows) or 1, -(-m // queries) or 1
    packed = lambda df, parts, names: df.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias(names[0])).agg(F.collect_list("id").alias(names[1]), F.collect_list("u").alias(names[2]))
    pairs = packed(unit, blocks, ("block", "ids", "us")).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).join(packed(asked, lots, ("lot", "query", "qs")), "lot").select("ids", "us", "query", "qs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = lambda c: np.array(c.as_py(), dtype=float)
        for batch in batches:
            for ids, us, query, qs in zip(*batch.columns, strict=True):
                ids, us, query, qs = np.array(ids.as_py()), matrix(us), np.array(query.as_py()), matrix(qs)
                scores = qs @ us.T
                scores[query[:, None] == ids[None, :]] = -np.inf
                least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(query), -2.0)
                a, b = np.nonzero(scores >= np.maximum(least, -2.0)[:, None] - 1e-9)
                exact = np.add.accumulate(qs[a] * us[b], axis=1)[:, -1] if len(a) else np.zeros(0)
                order = np.lexsort((ids[b], -exact, a))
                a, b, exact = a[order], b[order], exact[order]
                keep = np.arange(len(a)) - np.searchsorted(a, a) < k
                yield pa.record_batch([pa.array(query[a[keep]]), pa.array(ids[b[keep]]), pa.array(exact[keep])], names=["query", "id", "score"])

    found = pairs.mapInArrow(run, "query bigint, id bigint, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def merged_by_index(targets: DataFrame, features: DataFrame, index: str = "idx") -> DataFrame:
    """targets with value of the row their index points to; -1 (no match) takes 0."""
    return targets.join(features.withColumnRenamed("id", index), index, "left").withColumn("value", F.when(F.col(index) < 0, 0.0).otherwise(F.coalesce("value", F.lit(0.0))))


def clamped_score(a: Column, b: Column, limit: float = 12.0) -> Column:
    """Scaled dot product of two arrays, within +-limit."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.least(F.greatest(d / F.sqrt(F.size(a).cast("double")), F.lit(-limit)), F.lit(limit))


def masked_mean(value: Column, keep: Column) -> Column:
    """Aggregate: the mean of the kept rows' values, 0 if there is none."""
    return F.coalesce(F.avg(F.when(keep, value)), F.lit(0.0))


def wave_encoding(x: Column, parts: int, base: float = 10_000.0) -> Column:
    """Sines and cosines in turn of 2 pi x over powers of the base."""
    waves = []
    for i in range(parts):
        angle = x * (2 * math.pi) / (base ** (2 * (i // 2) / parts))
        waves.append(F.sin(angle) if i % 2 == 0 else F.cos(angle))
    return F.array(*waves)


def inverse_sigmoid(x: Column, eps: float = 1e-3) -> Column:
    x = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return F.log(F.greatest(x, F.lit(eps)) / F.greatest(1 - x, F.lit(eps)))
