"""Lifting of per-view labels to faces: votes, cross-view overlaps, ratio threshold, mutual best links, components.

Every function takes the columns `by` that tell meshes apart, so that all windows and aggregates are within a mesh.
Ties go to the smallest label.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetflow.operators.graph import components
from facetflow.session import cut

BY = ("mesh",)


def front_facing(nx: Column, ny: Column, nz: Column, pose: Column, least: float = 0.0) -> Column:
    """Whether a normal looks at a camera whose pose is a row-major 4 x 4 array: |n . third column| > least."""
    return F.abs(nx * pose[2] + ny * pose[6] + nz * pose[10]) > least


def label_ids(segs: DataFrame, by=BY) -> DataFrame:
    """(by, view, raw, label): each view's non-zero labels in ascending order, numbered on from those of earlier views, from 1."""
    own = segs.where((F.col("raw") != 0) & F.col("raw").isNotNull()).select(*by, "view", "raw").distinct()
    sizes = own.groupBy(*by, "view").count()
    earlier = Window.partitionBy(*by).orderBy("view").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "view", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy(*by, "view").orderBy("raw"))
    return own.join(offsets, [*by, "view"]).select(*by, "view", "raw", (F.col("offset") + rank).alias("label"))


def votes(pixels: DataFrame, least: int = 16, by=BY) -> DataFrame:
    """(by, view, f, label, n) for pixels (by, view, f, label) of front-facing surface: counts above `least`; face -1 and label 0 have none."""
    return pixels.where((F.col("f") != -1) & (F.col("label") != 0)).groupBy(*by, "view", "f", "label").agg(F.count("*").alias("n")).where(F.col("n") > least)


def winners(votes: DataFrame, by=BY) -> DataFrame:
    """(by, view, f, label) of most votes."""
    return votes.groupBy(*by, "view", "f").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))


def overlaps(winners: DataFrame, by=BY) -> DataFrame:
    """(by, l1, l2, n): faces that carry l1 in an earlier and l2 in a later view. An equi-join on the face."""
    a, b = winners.select(*by, "f", F.col("view").alias("v1"), F.col("label").alias("l1")), winners.select(*by, "f", F.col("view").alias("v2"), F.col("label").alias("l2"))
    return a.join(b, [*by, "f"]).where(F.col("v1") < F.col("v2")).groupBy(*by, "l1", "l2").agg(F.count("*").alias("n"))


def ratios(overlaps: DataFrame, least: int = 32, by=BY) -> DataFrame:
    """(by, l1, l2, n, ratio), both directions: an overlap above `least` over all such overlaps of l1."""
    some = overlaps.where(F.col("n") > least)
    both = some.unionByName(some.select(*by, F.col("l2").alias("l1"), F.col("l1").alias("l2"), "n"))
    return both.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "l1")))


def degrees(overlaps: DataFrame, ratios: DataFrame, by=BY) -> DataFrame:
    """(by, label, degree): partners left to each label that met another one, 0 for those that lost all."""
    met = overlaps.select(*by, F.col("l1").alias("label")).unionByName(overlaps.select(*by, F.col("l2").alias("label"))).distinct()
    left = ratios.groupBy(*by, F.col("l1").alias("label")).agg(F.count("*").alias("degree"))
    return met.join(left, [*by, "label"], "left").select(*by, "label", F.coalesce("degree", F.lit(0)).alias("degree"))


def promiscuous(degrees: DataFrame, percentile: float = 0.95, floor: float = 16.0, by=BY) -> DataFrame:
    """(by, label) of more partners than the percentile of all degrees and the floor."""
    limit = degrees.groupBy(*by).agg(F.greatest(F.percentile("degree", percentile), F.lit(floor)).alias("limit"))
    return degrees.join(limit, list(by)).where(F.col("degree") > F.col("limit")).select(*by, "label")


def without(ratios: DataFrame, labels: DataFrame, by=BY) -> DataFrame:
    """ratios without rows of these labels on either side; what is left keeps its ratio."""
    for side in ("l1", "l2"):
        ratios = ratios.join(labels.select(*by, F.col("label").alias(side)), [*by, side], "left_anti")
    return ratios


def ratio_threshold(ratios: DataFrame, resolution: int = 100, share: float = 0.125, floor: float = 0.075, by=BY) -> DataFrame:
    """(by, threshold): the upper edge of the histogram bin in which the running count reaches `share` of all ratios, at least `floor`."""
    bins = ratios.groupBy(*by, F.floor(F.col("ratio") * resolution).alias("bin")).agg(F.count("*").alias("n"))
    run = Window.partitionBy(*by)
    walked = bins.select(*by, "bin", F.sum("n").over(run.orderBy("bin")).alias("cum"), F.sum("n").over(run).alias("total"))
    return walked.where(F.col("cum") >= share * F.col("total")).groupBy(*by).agg(F.greatest((F.min("bin") + 1) / F.lit(resolution), F.lit(floor)).alias("threshold"))


def mutual(ratios: DataFrame, thresholds: DataFrame, by=BY) -> DataFrame:
    """(by, l1, l2) whose ratios both ways are above the threshold; both directions."""
    strong = ratios.join(thresholds, list(by)).where(F.col("ratio") > F.col("threshold")).select(*by, "l1", "l2")
    return strong.join(strong.select(*by, F.col("l2").alias("l1"), F.col("l1").alias("l2")), [*by, "l1", "l2"], "left_semi")


def hooks(edges: DataFrame, by=BY) -> DataFrame:
    """(by, label, hook): the least label that links lead to."""
    node = lambda c: F.struct(*by, F.col(c).alias("label"))
    found = components(edges.select(node("l1").alias("src"), node("l2").alias("dst")))
    return found.select(*[F.col(f"node.{c}") for c in by], F.col("node.label").alias("label"), F.col("component.label").alias("hook"))


def lifted(winners: DataFrame, votes: DataFrame, hooks: DataFrame, merge: str = "last_view", by=BY) -> DataFrame:
    """(by, f, label): the hook of a face's label. merge: last_view takes the last view's winner, sum the label of most votes of all views."""
    if merge == "last_view":
        own = winners.groupBy(*by, "f").agg(F.max_by("label", "view").alias("label"))
        return own.join(hooks, [*by, "label"], "left").select(*by, "f", F.coalesce("hook", "label").alias("label"))
    if merge != "sum":
        raise ValueError("merge is last_view or sum")
    hooked = votes.join(hooks, [*by, "label"], "left").withColumn("label", F.coalesce("hook", "label"))
    return hooked.groupBy(*by, "f", "label").agg(F.sum("n").alias("n")).groupBy(*by, "f").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))


@dataclass
class Lift:
    """All steps, each made when it is asked for; pixels (by, view, f, label). What several later steps read is cut off, so it is made once."""

    pixels: DataFrame
    vote: int = 16
    pair: int = 32
    resolution: int = 100
    share: float = 0.125
    floor: float = 16.0
    by: tuple[str, ...] = BY

    @cached_property
    def votes(self) -> DataFrame:
        return votes(self.pixels, self.vote, self.by)

    @cached_property
    def winners(self) -> DataFrame:
        return winners(self.votes, self.by)

    @cached_property
    def overlaps(self) -> DataFrame:
        return overlaps(self.winners, self.by)

    @cached_property
    def _winners(self) -> DataFrame:
        return cut(self.winners)

    @cached_property
    def _overlaps(self) -> DataFrame:
        return cut(overlaps(self._winners, self.by))

    @cached_property
    def ratios(self) -> DataFrame:
        return ratios(self.overlaps, self.pair, self.by)

    @cached_property
    def degrees(self) -> DataFrame:
        return degrees(self._overlaps, ratios(self._overlaps, self.pair, self.by), self.by)

    @cached_property
    def left(self) -> DataFrame:
        return without(ratios(self._overlaps, self.pair, self.by), promiscuous(self.degrees, 0.95, self.floor, self.by), self.by)

    @cached_property
    def _left(self) -> DataFrame:
        return cut(self.left)

    @cached_property
    def threshold(self) -> DataFrame:
        return ratio_threshold(self.left, self.resolution, self.share, by=self.by)

    @cached_property
    def edges(self) -> DataFrame:
        return mutual(self._left, ratio_threshold(self._left, self.resolution, self.share, by=self.by), self.by)

    @cached_property
    def hooks(self) -> DataFrame:
        return hooks(self.edges, self.by)

    def lifted(self, merge: str = "last_view") -> DataFrame:
        return lifted(self._winners, self.votes, self.hooks, merge, self.by)


def label_statistics(labels: DataFrame, by=BY) -> DataFrame:
    return labels.groupBy(*by, "label").agg(F.count("*").alias("faces"))
