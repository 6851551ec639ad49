"""Labels on a face graph: adjacency, components, cleaning, filling, splitting, submeshes, energy.

Faces are rows (by, f, v array<int>), labels rows (by, f, label), adjacency rows (by, src, dst) with both directions.
Unlabelled faces have no row in labels. Ties go to the smallest label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetflow.operators.graph import components
from facetflow.session import cut

BY = ("mesh",)


def edges(faces: DataFrame, by=BY) -> DataFrame:
    """(by, a, b, f), a < b: each face's sides."""
    n = F.size("v")
    sides = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.least(F.get("v", i), F.get("v", (i + 1) % n)).alias("a"), F.greatest(F.get("v", i), F.get("v", (i + 1) % n)).alias("b")))
    return faces.where(n >= 2).select(*by, "f", F.explode(sides).alias("e")).select(*by, "e.a", "e.b", "f").distinct()


def adjacency(faces: DataFrame, rule: str = "two", by=BY) -> DataFrame:
    """(by, src, dst): faces that share a side. rule two: sides of exactly two faces; all: all pairs on a side."""
    own = edges(faces, by)
    if rule == "two":
        pairs = own.groupBy(*by, "a", "b").agg(F.count("*").alias("n"), F.min("f").alias("src"), F.max("f").alias("dst")).where("n = 2").select(*by, "src", "dst")
    elif rule == "all":
        other = own.withColumnRenamed("f", "dst")
        pairs = own.withColumnRenamed("f", "src").join(other, [*by, "a", "b"]).where("src < dst").select(*by, "src", "dst")
    else:
        raise ValueError("rule is two or all")
    return pairs.unionByName(pairs.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def label_components(labels: DataFrame, adjacent: DataFrame, by=BY) -> DataFrame:
    """(by, f, label, comp): comp is the least face that can be reached over faces of the same label."""
    a = labels.select(*by, F.col("f").alias("src"), F.col("label").alias("l1"))
    b = labels.select(*by, F.col("f").alias("dst"), F.col("label").alias("l2"))
    same = adjacent.where("src < dst").join(a, [*by, "src"]).join(b, [*by, "dst"]).where("l1 = l2")
    node = lambda c: F.struct(*by, F.col(c).alias("f"))
    found = components(same.select(node("src").alias("src"), node("dst").alias("dst")))
    named = found.select(*[F.col(f"node.{c}") for c in by], F.col("node.f").alias("f"), F.col("component.f").alias("comp"))
    return labels.join(named, [*by, "f"], "left").withColumn("comp", F.coalesce("comp", "f"))


def without_small(parts: DataFrame, areas: DataFrame, size: float = 0.025, area: float = 0.025, by=BY) -> DataFrame:
    """(by, f, label, comp) without components that have both less than `size` of the largest one's faces and less than `area` of the largest area."""
    own = parts.join(areas, [*by, "f"]).groupBy(*by, "comp").agg(F.count("*").alias("faces"), F.sum("area").alias("area"))
    most = own.groupBy(*by).agg(F.max("faces").alias("m_faces"), F.max("area").alias("m_area"))
    small = own.join(most, list(by)).where((F.col("faces") < size * F.col("m_faces")) & (F.col("area") < area * F.col("m_area")))
    return parts.join(small.select(*by, "comp"), [*by, "comp"], "left_anti").select(*by, "f", "label", "comp")


def fill_holes(labels: DataFrame, adjacent: DataFrame, rounds: int = 64, by=BY) -> DataFrame:
    """labels with faces without a row given the most common non-zero label of their neighbours, round by round, until nothing changes or `rounds` have passed."""
    now = cut(labels.select(*by, "f", "label"))
    for _ in range(rounds):
        open_ = adjacent.select(*by, F.col("src").alias("f"), "dst").join(now.select(*by, "f"), [*by, "f"], "left_anti")
        seen = open_.join(now.where("label <> 0").select(*by, F.col("f").alias("dst"), "label"), [*by, "dst"])
        new = seen.groupBy(*by, "f", "label").agg(F.count("*").alias("n")).groupBy(*by, "f").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
        new = cut(new)
        if new.isEmpty():
            break
        now = cut(now.unionByName(new))
    return now


def fill_rest(labels: DataFrame, faces: DataFrame, value: int = 0, by=BY) -> DataFrame:
    return faces.select(*by, "f").join(labels.select(*by, "f", "label"), [*by, "f"], "left").select(*by, "f", F.coalesce("label", F.lit(value)).alias("label"))


def split(parts: DataFrame, by=BY) -> DataFrame:
    """(by, f, label) with a label for each component: a label's component of the least face keeps it, others and all of label 0 get the next numbers above the mesh's greatest label, in order of their least face."""
    own = parts.select(*by, "label", "comp").distinct()
    first = F.row_number().over(Window.partitionBy(*by, "label").orderBy("comp")) == 1
    own = own.withColumn("keeps", first & (F.col("label") != 0))
    top = F.max("label").over(Window.partitionBy(*by))
    new = F.sum(F.when(F.col("keeps"), 0).otherwise(1)).over(Window.partitionBy(*by).orderBy("comp").rowsBetween(Window.unboundedPreceding, 0))
    own = own.select(*by, "comp", F.when(F.col("keeps"), F.col("label")).otherwise(top + new).cast("long").alias("label"))
    return parts.select(*by, "f", "comp").join(own, [*by, "comp"]).select(*by, "f", "label")


def counts(labels: DataFrame, by=BY) -> DataFrame:
    return labels.groupBy(*by, "label").agg(F.count("*").alias("n"))


def dense(labels: DataFrame, by=BY, column: str = "label") -> DataFrame:
    """The column as 0, 1, 2 ... in ascending order of its values. Ranks the distinct values only."""
    rank = labels.select(*by, column).distinct().withColumn("_rank", F.dense_rank().over(Window.partitionBy(*by).orderBy(column)) - 1)
    return labels.join(rank, [*by, column]).withColumn(column, F.col("_rank")).drop("_rank")


def colours(label: Column, background: int = 0) -> Column:
    """Red, green and blue (0 to 255) by a hash of the label; the background is black."""
    part = lambda k: F.pmod(label.cast("long") * F.lit(k) + F.lit(k // 7), F.lit(256)).cast("int")
    return F.when(label == background, F.array(F.lit(0), F.lit(0), F.lit(0))).otherwise(F.array(part(97), part(57), part(193)))


def submeshes(faces: DataFrame, labels: DataFrame, by=BY) -> tuple[DataFrame, DataFrame]:
    """(faces (by, label, f, v), vertices (by, label, v, old)): each label's faces with its own vertex numbers, in ascending order of the old ones."""
    corners = faces.join(labels, [*by, "f"]).select(*by, "label", "f", F.posexplode("v").alias("place", "old"))
    vertices = corners.select(*by, "label", "old").distinct().withColumn("v", F.row_number().over(Window.partitionBy(*by, "label").orderBy("old")) - 1)
    own = corners.join(vertices, [*by, "label", "old"]).groupBy(*by, "label", "f").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]).alias("v"))
    return own, vertices.select(*by, "label", "v", "old")


def parts_of(faces: DataFrame, labels: DataFrame, least: int = 1, by=BY) -> tuple[DataFrame, DataFrame]:
    """submeshes() of labels above 0 that have `least` faces and more."""
    sizes = labels.where("label <> 0").groupBy(*by, "label").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return submeshes(faces, labels.join(sizes.drop("_n"), [*by, "label"], "left_semi"), by)


def carried(vertices: DataFrame, values: DataFrame, by=BY) -> DataFrame:
    """Submesh vertices (by, label, v, old) with what the mesh's vertices carry: values (by, v, ..), as texture places and colours; nulls where there is none."""
    return vertices.join(values.withColumnRenamed("v", "old"), [*by, "old"], "left")


def numbered_components(parts: DataFrame, by=BY) -> DataFrame:
    """parts (by, f, comp) with their components numbered from 0 in the order in which faces come to them."""
    firsts = parts.groupBy(*by, "comp").agg(F.min("f").alias("_first"))
    numbers = firsts.withColumn("part", (F.row_number().over(Window.partitionBy(*by).orderBy("_first")) - 1).cast("int"))
    return parts.join(numbers.drop("_first"), [*by, "comp"]).select(*by, "f", "part")


def smoothness(angle: Column, weight: float = 6.0) -> Column:
    """Cost of a boundary at a side with this dihedral angle: flat sides cost most."""
    return -F.log(angle / F.lit(3.141592653589793) + F.lit(1e-20)) * weight


def energy(labels: DataFrame, initial: DataFrame, sides: DataFrame, weight: float = 6.0, by=BY) -> DataFrame:
    """(by, data, smooth, energy): faces that left their initial label, and the smoothness of the sides (by, src, dst, angle; src < dst) between labels."""
    data = labels.join(initial.select(*by, "f", F.col("label").alias("was")), [*by, "f"]).groupBy(*by).agg(F.sum((F.col("label") != F.col("was")).cast("double")).alias("data"))
    a, b = labels.select(*by, F.col("f").alias("src"), F.col("label").alias("l1")), labels.select(*by, F.col("f").alias("dst"), F.col("label").alias("l2"))
    ends = sides.join(a, [*by, "src"]).join(b, [*by, "dst"]).where("l1 <> l2")
    smooth = ends.groupBy(*by).agg(F.sum(smoothness(F.col("angle"), weight)).alias("smooth"))
    total = data.join(smooth, list(by), "left").withColumn("smooth", F.coalesce("smooth", F.lit(0.0)))
    return total.withColumn("energy", F.col("data") + F.col("smooth"))


def closest_weight(results: DataFrame, target: int, by=BY) -> DataFrame:
    """(by, weight): the weight whose number of labels (by, weight, labels) is closest to the target; ties to the smallest weight."""
    return results.groupBy(*by).agg(F.min_by("weight", F.struct(F.abs(F.col("labels") - target), "weight")).alias("weight"))


def crawled_weight(results: DataFrame, target: int, tolerance: int = 1, steps: int = 8, seed: float = 6.0, by=BY) -> DataFrame:
    """(by, weight): walk a grid of weights from the seed towards fewer labels where there are too many and more where too few, up to `steps` steps, until within the tolerance.

    The grid is one ordered array a mesh (its length is the number of weights tried).
    """
    grid = results.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("weight", "labels"))).alias("grid"))
    last = F.size("grid") - 1
    start = F.least(last, F.size(F.filter("grid", lambda g: g["weight"] < seed)))
    off = lambda i: F.get("grid", i)["labels"] - F.lit(target)
    step = lambda i, _: F.when(F.abs(off(i)) <= tolerance, i).when(off(i) > 0, F.least(i + 1, last)).otherwise(F.greatest(i - 1, F.lit(0)))
    at = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return grid.select(*by, F.get("grid", at)["weight"].alias("weight"))
