"""Masks as pixel rows (by, mask, y, x), label maps as (by, y, x, label), run lengths, boxes and their overlaps."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetflow.operators.graph import components, least_reached
from facetflow.session import cut

BY = ("img",)
CONFLICTS = 200_000  # up to which a group's may meet in one task
TILE = 256  # places of a side of the tiles whose pixels one task joins
LOT = 100_000  # pixels that a task joins at once, if a tile has no more


def areas(masks: DataFrame, by=BY) -> DataFrame:
    return masks.groupBy(*by, "mask").agg(F.count("*").alias("area"))


def painted(masks: DataFrame, sort_by_area: bool = True, by=BY) -> DataFrame:
    """(by, y, x, rank): masks painted one over the other, in order of falling area (ties: the smaller mask first) or of number; the last one stays."""
    sizes = areas(masks, by)
    order = Window.partitionBy(*by).orderBy(F.desc("area"), "mask") if sort_by_area else Window.partitionBy(*by).orderBy("mask")
    return masks.join(sizes.withColumn("rank", F.row_number().over(order)), [*by, "mask"]).groupBy(*by, "y", "x").agg(F.max("rank").alias("rank"))


def with_foreground(pixels: DataFrame, ranks: DataFrame, by=BY) -> DataFrame:
    """(by, y, x, label): rank + 1 where painted, 1 for other foreground, 0 for background; pixels (by, y, x, foreground)."""
    return pixels.join(ranks, [*by, "y", "x"], "left").select(*by, "y", "x", F.when(F.col("foreground"), F.coalesce("rank", F.lit(0)) + 1).otherwise(0).alias("label"))


def decomposed(label_map: DataFrame, by=BY) -> DataFrame:
    """Masks of a label map's non-zero labels."""
    return label_map.where("label <> 0").select(*by, F.col("label").alias("mask"), "y", "x")


def neighbours(pixels: DataFrame, keys: list[str], eight: bool = True) -> DataFrame:
    """(keys, y, x, y2, x2): pairs of neighbouring pixels with the same keys, each once."""
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    moved = pixels.select(*keys, "y", "x", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])).alias("s")).select(*keys, "y", "x", (F.col("y") + F.col("s.a")).alias("y2"), (F.col("x") + F.col("s.b")).alias("x2"))
    return moved.join(pixels.select(*keys, F.col("y").alias("y2"), F.col("x").alias("x2")), [*keys, "y2", "x2"])


def _in_tiles(pixels: DataFrame, keys: list[str], eight: bool) -> DataFrame:
    """pixels (keys, y, x) with cy, cx (the first pixel) and area of their connected component within their tile of TILE by TILE places."""
    tile = lambda c: F.floor((F.col(c) + TILE // 2) / TILE)
    kinds = dict(pixels.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, "y", "x")) + f", cy {kinds['y']}, cx {kinds['x']}, area bigint"
    steps = [1, TILE + 2] + ([TILE + 3, TILE + 1] if eight else [])  # a tile's places are numbered with a margin

    def changes(rows: pa.Table) -> np.ndarray:
        """Whether a row is the first of its tile."""
        first = np.zeros(rows.num_rows, dtype=bool)
        first[:1] = True
        for c in (*keys, "_ty", "_tx"):
            codes = rows[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            first[1:] |= codes[1:] != codes[:-1]
        return first

    def solved(rows: pa.Table) -> pa.RecordBatch:
        group = np.cumsum(changes(rows))
        y, x = (rows[c].combine_chunks() for c in ("y", "x"))
        known = np.flatnonzero(~(y.is_null().to_numpy(zero_copy_only=False) | x.is_null().to_numpy(zero_copy_only=False)))
        within = lambda v: (v.take(pa.array(known)).to_numpy().astype(np.int64) + TILE // 2) % TILE + 1
        place, at, own = np.unique((group[known] * (TILE + 2) + within(y)) * (TILE + 2) + within(x), return_index=True, return_inverse=True)
        ends = []
        for step in steps:
            other = np.searchsorted(place, place + step)
            hit = np.flatnonzero(place[np.minimum(other, len(place) - 1)] == place + step)
            ends.append((hit, other[hit]))
        least = least_reached(*(np.concatenate(e) for e in zip(*ends, strict=True)), len(place))[own]
        first, area = np.arange(rows.num_rows), np.ones(rows.num_rows, dtype=np.int64)
        first[known], area[known] = known[at[least]], np.bincount(least, minlength=len(place))[least]
        lost = np.setdiff1d(first, known) if len(known) < len(first) else first[:0]  # pixels without a place join only those of the same
        if len(lost):
            same = Counter(named := list(zip(group[lost], y.take(pa.array(lost)).to_pylist(), x.take(pa.array(lost)).to_pylist(), strict=True)))
            area[lost] = [same[n] for n in named]
        firsts = pa.array(first)
        return pa.record_batch([*(rows[c].combine_chunks() for c in keys), y, x, y.take(firsts), x.take(firsts), pa.array(area)], names=[*keys, "y", "x", "cy", "cx", "area"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, enough = [], 0, LOT
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= enough:
                rows = pa.Table.from_batches(held)
                last = int(np.flatnonzero(changes(rows))[-1])  # the last tile may go on
                if last:
                    yield solved(rows.slice(0, last))
                held, n = rows.slice(last).combine_chunks().to_batches(), n - last
                enough = max(LOT, 2 * n)
        if n:
            yield solved(pa.Table.from_batches(held))

    own = pixels.select(*keys, "y", "x", tile("y").alias("_ty"), tile("x").alias("_tx"))
    return own.repartition(*keys, "_ty", "_tx").sortWithinPartitions(*keys, "_ty", "_tx", "y", "x").mapInArrow(run, schema)


def pixel_components(pixels: DataFrame, keys: list[str], eight: bool = True) -> DataFrame:
    """pixels with comp (its first pixel, struct y, x) and area of their connected component among pixels of the same keys; those with a null key are left out.

    A task joins the pixels of a tile; only components that touch a tile's border are edges of a graph, so a small image takes no rounds.
    """
    at = lambda c: F.pmod(F.col(c) + TILE // 2, F.lit(TILE))
    border = at("y").isin(0, TILE - 1) | at("x").isin(0, TILE - 1)
    comp = F.struct(F.col("cy").alias("y"), F.col("cx").alias("x")).alias("comp")
    for k in keys:
        pixels = pixels.where(F.col(k).isNotNull())
    local = _in_tiles(pixels, keys, eight)
    if pixels.where(border).isEmpty():
        return local.select(*keys, "y", "x", comp, "area")
    local = cut(local)
    edge = local.where(border).select(*keys, "y", "x", "cy", "cx")
    one, two = edge.withColumnsRenamed({"cy": "ay", "cx": "ax"}), edge.select(*keys, F.col("y").alias("y2"), F.col("x").alias("x2"), "cy", "cx")
    pairs = neighbours(edge, keys, eight).join(one, [*keys, "y", "x"]).join(two, [*keys, "y2", "x2"]).where("ay <> cy OR ax <> cx")
    node = lambda y, x: F.struct(*keys, F.col(y).alias("y"), F.col(x).alias("x"))
    found = components(pairs.select(node("ay", "ax").alias("src"), node("cy", "cx").alias("dst")))
    found = found.select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.y").alias("cy"), F.col("node.x").alias("cx"), F.struct(F.col("component.y").alias("y"), F.col("component.x").alias("x")).alias("_comp"))
    firsts = local.where("y = cy AND x = cx").select(*keys, "cy", "cx", "area").distinct()
    sums = firsts.join(found, [*keys, "cy", "cx"]).groupBy(*keys, "_comp").agg(F.sum("area").alias("_area"))
    whole = found.join(sums, [*keys, "_comp"])
    return local.join(whole, [*keys, "cy", "cx"], "left").select(*keys, "y", "x", F.coalesce("_comp", comp).alias("comp"), F.coalesce("_area", "area").alias("area"))


def without_islands(masks: DataFrame, least: int, rescue: bool = True, by=BY) -> DataFrame:
    """masks without 8-connected parts of fewer than `least` pixels; rescue: a mask of small parts only keeps its largest (ties: the first)."""
    parts = pixel_components(masks, [*by, "mask"])
    sizes = parts.select(*by, "mask", "comp", "area").distinct()
    order = Window.partitionBy(*by, "mask").orderBy(F.desc("area"), "comp")
    keep = sizes.withColumn("r", F.row_number().over(order)).where((F.col("area") >= least) | ((F.col("r") == 1) & F.lit(rescue)))
    return parts.join(keep.select(*by, "mask", "comp"), [*by, "mask", "comp"]).select(*by, "mask", "y", "x")


def with_holes_filled(masks: DataFrame, pixels: DataFrame, least: int, by=BY) -> DataFrame:
    """masks with the 8-connected parts of their outside that have fewer than `least` pixels; pixels (by, y, x) is the whole image."""
    outside = masks.select(*by, "mask").distinct().join(pixels.select(*by, "y", "x"), list(by)).join(masks, [*by, "mask", "y", "x"], "left_anti")
    holes = pixel_components(outside, [*by, "mask"]).where(F.col("area") < least)
    return masks.select(*by, "mask", "y", "x").unionByName(holes.select(*by, "mask", "y", "x"))


def cleaned_map(label_map: DataFrame, least: int, by=BY) -> DataFrame:
    """A label map whose labels, 0 too, lose small islands and have small holes filled; a pixel that several labels claim takes the greatest, one that none claims 0."""
    masks = label_map.select(*by, F.col("label").alias("mask"), "y", "x")
    claims = with_holes_filled(without_islands(masks, least, rescue=False, by=by), label_map, least, by)
    top = claims.groupBy(*by, "y", "x").agg(F.max("mask").alias("label"))
    return label_map.select(*by, "y", "x").join(top, [*by, "y", "x"], "left").select(*by, "y", "x", F.coalesce("label", F.lit(0)).alias("label"))


def cleaned_once(masks: DataFrame, pixels: DataFrame, least: int, by=BY) -> tuple[DataFrame, DataFrame]:
    """(masks after filling holes and removing islands, (by, mask, score): 1 if a mask is as it was, else 0), for suppression that prefers unchanged ones."""
    after = without_islands(with_holes_filled(masks, pixels, least, by), least, True, by)
    was = masks.groupBy(*by, "mask").agg(F.count("*").alias("n0"))
    now = after.groupBy(*by, "mask").agg(F.count("*").alias("n1"))
    same = after.join(masks, [*by, "mask", "y", "x"]).groupBy(*by, "mask").agg(F.count("*").alias("n2"))
    score = was.join(now, [*by, "mask"], "left").join(same, [*by, "mask"], "left").select(*by, "mask", ((F.col("n0") == F.col("n1")) & (F.col("n0") == F.col("n2"))).cast("int").alias("score"))
    return after, score


def run_lengths(masks: DataFrame, sizes: DataFrame, by=BY) -> DataFrame:
    """(by, mask, counts array<int>, area): lengths of runs of 0 and 1 in turn, column by column, beginning with a run of 0 (perhaps empty); sizes (by, h, w)."""
    own = masks.join(sizes, list(by)).withColumn("at", F.col("x") * F.col("h") + F.col("y"))
    w = Window.partitionBy(*by, "mask").orderBy("at")
    marked = own.withColumn("start", (F.coalesce(F.col("at") - F.lag("at").over(w), F.lit(-1)) != 1).cast("int")).withColumn("run", F.sum("start").over(w))
    runs = marked.groupBy(*by, "mask", "run").agg(F.min("at").alias("a"), F.max("at").alias("b"), F.first(F.col("h") * F.col("w")).alias("n"))
    before = F.col("a") - F.coalesce(F.lag("b").over(Window.partitionBy(*by, "mask").orderBy("run")), F.lit(-1)) - 1
    rows = runs.withColumn("gap", before).groupBy(*by, "mask").agg(F.array_sort(F.collect_list(F.struct("run", "gap", (F.col("b") - F.col("a") + 1).alias("len")))).alias("r"), (F.first("n") - F.max("b") - 1).alias("rest"), F.sum(F.col("b") - F.col("a") + 1).cast("long").alias("area"))
    counts = F.flatten(F.transform("r", lambda s: F.array(s["gap"].cast("int"), s["len"].cast("int"))))
    return rows.select(*by, "mask", F.when(F.col("rest") > 0, F.concat(counts, F.array(F.col("rest").cast("int")))).otherwise(counts).alias("counts"), "area")


def from_run_lengths(rle: DataFrame, sizes: DataFrame, by=BY) -> DataFrame:
    """Mask pixels of run lengths."""
    runs = rle.select(*by, "mask", "counts", F.posexplode("counts").alias("k", "n"))
    starts = F.aggregate(F.slice("counts", F.lit(1), F.col("k")), F.lit(0), lambda s, x: s + x)
    on = runs.where("k % 2 = 1 AND n > 0").select(*by, "mask", F.explode(F.sequence(starts, starts + F.col("n") - 1)).alias("at")).join(sizes, list(by))
    return on.select(*by, "mask", F.expr("cast(at % h AS int)").alias("y"), F.expr("cast(at div h AS int)").alias("x"))


def packed_counts(counts: Column) -> Column:
    """Run lengths as text: from the fourth on a length less the one two before, five bits a character from the lowest, 32 if more follow, from character 48 on."""

    @F.pandas_udf("string")
    def pack(rows: pd.Series) -> pd.Series:
        rows = rows.map(lambda r: np.zeros(0, dtype=np.int64) if r is None else np.asarray(r, dtype=np.int64))
        sizes = rows.map(len).to_numpy()
        if not sizes.sum():
            return pd.Series([""] * len(rows))
        values = np.concatenate(rows.to_list())
        at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        values = np.where(at > 2, values - np.append([0, 0], values[:-2]), values)
        digits, more = [], np.ones(len(values), dtype=bool)
        while more.any():
            low, values = values & 31, values >> 5
            goes_on = more & np.where(low & 16, values != -1, values != 0)
            digits.append(np.where(more, low + np.where(goes_on, 32, 0) + 48, 0))
            more = goes_on
        text = np.stack(digits, axis=1).astype(np.uint8)
        each = np.cumsum((text > 0).sum(axis=1))
        ends = np.append(0, each)[np.cumsum(sizes)]
        whole = text[text > 0].tobytes().decode("ascii")
        return pd.Series([whole[a:b] for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)])

    return pack(counts)


def unpacked_counts(text: Column) -> Column:
    """Run lengths from packed_counts(); text that ends within a number, or has other characters, raises an error."""

    @F.pandas_udf("array<int>")
    def unpack(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            raw = np.frombuffer((row or "").encode("ascii", "replace"), dtype=np.uint8).astype(np.int64) - 48
            if len(raw) and (raw.min() < 0 or raw.max() > 63 or raw[-1] & 32):
                raise ValueError(f"not run lengths: {row[:40]!r}")
            last = (raw & 32) == 0
            number = np.cumsum(np.append(0, last[:-1])) if len(raw) else raw
            first = np.flatnonzero(np.append(True, last[:-1])) if len(raw) else raw
            place = np.arange(len(raw)) - first[number] if len(raw) else raw
            values = np.zeros(len(first), dtype=np.int64)
            np.add.at(values, number, (raw & 31) << (5 * place))
            ends = np.flatnonzero(last)
            values = np.where(raw[ends] & 16, values - (1 << (5 * (place[ends] + 1))), values) if len(raw) else values
            for parity in (1, 2):  # each length is that two before and a difference, from the fourth on
                values[parity::2] = np.cumsum(values[parity::2])
            out.append(values.astype(np.int32))
        return pd.Series(out)

    return unpack(text)


def run_length_area(counts: Column) -> Column:
    return F.aggregate(F.filter(counts, lambda x, i: i % 2 == 1), F.lit(0), lambda s, x: s + x)


def boxes(masks: DataFrame, exclusive: bool = False, everyone: DataFrame | None = None, by=BY) -> DataFrame:
    """(by, mask, x0, y0, x1, y1): the last pixel's place, or one beyond it. Masks without pixels have no row, or, if in `everyone` (by, mask), all zeros."""
    more = 1 if exclusive else 0
    if everyone is not None:
        found = everyone.select(*by, "mask").distinct().join(boxes(masks, exclusive, by=by), [*by, "mask"], "left")
        return found.fillna(0, ["x0", "y0", "x1", "y1"])
    return masks.groupBy(*by, "mask").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + more).alias("x1"), (F.max("y") + more).alias("y1"))


# --- boxes as four columns ------------------------------------------------------------------------

def converted(box: list[Column], source: str, target: str) -> list[Column]:
    """Between xyxy, xywh and cxcywh."""
    a, b, c, d = box
    corners = {"xyxy": [a, b, c, d], "xywh": [a, b, a + c, b + d], "cxcywh": [a - c / 2, b - d / 2, a + c / 2, b + d / 2]}[source]
    x0, y0, x1, y1 = corners
    return {"xyxy": corners, "xywh": [x0, y0, x1 - x0, y1 - y0], "cxcywh": [(x0 + x1) / 2, (y0 + y1) / 2, x1 - x0, y1 - y0]}[target]


def box_area(b: list[Column]) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: list[Column], b: list[Column]) -> Column:
    side = lambda i: F.greatest(F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]), F.lit(0.0))
    return side(0) * side(1)


def box_iou(a: list[Column], b: list[Column], eps: float = 0.0) -> Column:
    both = intersection(a, b)
    union = box_area(a) + box_area(b) - both
    return both / (union + eps) if eps else F.when(union > 0, both / union).otherwise(0.0)


def generalised_iou(a: list[Column], b: list[Column]) -> Column:
    both = intersection(a, b)
    union = box_area(a) + box_area(b) - both
    hull = (F.greatest(a[2], b[2]) - F.least(a[0], b[0])) * (F.greatest(a[3], b[3]) - F.least(a[1], b[1]))
    return both / union - (hull - union) / hull


def near_crop_edge(box: list[Column], crop: list[Column], image: list[Column], within: float = 20.0) -> Column:
    """Whether a side lies on the crop's edge but not on the image's."""
    hit = F.lit(False)
    for b, c, i in zip(box, crop, image, strict=True):
        hit = hit | ((F.abs(b - c) <= within) & ~(F.abs(b - i) <= within))
    return hit


def near_border(box: list[Column], margin: float = 0.025) -> Column:
    """Whether the centre of a box in shares of the image lies less than the margin from the border."""
    cx, cy = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    return (cx < margin) | (cx > 1 - margin) | (cy < margin) | (cy > 1 - margin)


def overlapping_boxes(boxes: DataFrame, size: float, least: float = 0.0, by=BY) -> DataFrame:
    """(by, a, b, iou), a < b, of boxes (by, id, x0, y0, x1, y1) that overlap with an IoU above `least`.

    A range join: boxes meet in the cells of a grid of this size, in the cell of the intersection's first corner only, so each pair is made once.
    """
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size).cast("int"), F.floor(F.col(hi) / size).cast("int"))
    own = boxes.select(*by, "id", "x0", "y0", "x1", "y1", F.explode(cells("x0", "x1")).alias("gx")).select("*", F.explode(cells("y0", "y1")).alias("gy"))
    other = own.select(*by, "gx", "gy", *[F.col(c).alias(f"{c}_b") for c in ("id", "x0", "y0", "x1", "y1")])
    a, b = [F.col(c) for c in ("x0", "y0", "x1", "y1")], [F.col(f"{c}_b") for c in ("x0", "y0", "x1", "y1")]
    here = (F.floor(F.greatest("x0", "x0_b") / size) == F.col("gx")) & (F.floor(F.greatest("y0", "y0_b") / size) == F.col("gy"))
    iou = box_iou(a, b)
    return own.join(other, [*by, "gx", "gy"]).where((F.col("id") < F.col("id_b")) & here).select(*by, F.col("id").alias("a"), F.col("id_b").alias("b"), iou.alias("iou")).where(F.col("iou") > least)


def overlapping_masks(masks: DataFrame, by=BY) -> DataFrame:
    """(by, a, b, both, iou, iom), a < b, of masks that share pixels: over the union, and over the smaller one."""
    sizes = areas(masks, by)
    b = masks.select(*by, "y", "x", F.col("mask").alias("b"))
    pairs = masks.withColumnRenamed("mask", "a").join(b, [*by, "y", "x"]).where("a < b").groupBy(*by, "a", "b").agg(F.count("*").alias("both"))
    own = pairs.join(sizes.select(*by, F.col("mask").alias("a"), F.col("area").alias("na")), [*by, "a"]).join(sizes.select(*by, F.col("mask").alias("b"), F.col("area").alias("nb")), [*by, "b"])
    union = F.greatest(F.col("na") + F.col("nb") - F.col("both"), F.lit(1))
    return own.select(*by, "a", "b", "both", (F.col("both") / union).alias("iou"), (F.col("both") / (F.least("na", "nb") + 1e-8)).alias("iom"))


def undisputed(scores: DataFrame, conflicts: DataFrame, by=BY) -> DataFrame:
    """(by, id) of scores (by, id, score) that greedy suppression keeps: by falling score (ties: the smaller id), what conflicts (by, a, b) with nothing kept.

    In rounds on the graph of conflicts: what no better one that is still undecided conflicts with is kept, and what conflicts with it dropped.
    A round reads the conflicts that are left; once they are few enough one task decides them. What conflicts with nothing is never joined again.
    """
    keys = [*by, "id"]
    place = F.struct((-F.col("score")).alias("s"), "id")
    ranked = scores.select(*keys, place.alias("p"))
    sides = conflicts.select(*by, "a", "b").join(ranked.toDF(*by, "a", "pa"), [*by, "a"]).join(ranked.toDF(*by, "b", "pb"), [*by, "b"]).where("a <> b")
    better = F.col("pa") < F.col("pb")
    open_ = cut(sides.select(*by, F.when(better, F.col("pa")).otherwise(F.col("pb")).alias("up"), F.when(better, F.col("pb")).otherwise(F.col("pa")).alias("down")).distinct())
    out = ranked.join(open_.select(*by, F.col("up.id").alias("id")).unionByName(open_.select(*by, F.col("down.id").alias("id"))).distinct(), keys, "left_anti").select(*keys)
    while (count := open_.count()) > CONFLICTS:
        ups, downs = open_.select(*by, F.col("up").alias("p")).distinct(), open_.select(*by, F.col("down").alias("p")).distinct()
        kept = cut(ups.join(downs, [*by, "p"], "left_anti"))
        gone = cut(open_.join(kept.withColumnRenamed("p", "up"), [*by, "up"], "left_semi").select(*by, F.col("down").alias("p")).distinct())
        rest = open_.join(gone.withColumnRenamed("p", "up"), [*by, "up"], "left_anti").join(gone.withColumnRenamed("p", "down"), [*by, "down"], "left_anti").join(kept.withColumnRenamed("p", "up"), [*by, "up"], "left_anti")
        left = cut(rest)
        # what only dropped ones spoke against is kept as well
        free = downs.unionByName(ups).distinct().join(gone.unionByName(kept), [*by, "p"], "left_anti").join(left.select(*by, F.col("up").alias("p")).unionByName(left.select(*by, F.col("down").alias("p"))).distinct(), [*by, "p"], "left_anti")
        out = out.unionByName(cut(kept.unionByName(free)).select(*by, "p.id"))
        open_ = left
    if count:
        kinds = dict(scores.dtypes)

        def decided(rows: pd.DataFrame) -> pd.DataFrame:
            worse: dict = {}
            for s, i, t, j in zip(rows["us"], rows["ui"], rows["ds"], rows["di"], strict=True):
                worse.setdefault((s, i), []).append((t, j))
                worse.setdefault((t, j), [])
            gone, kept = set(), []
            for p in sorted(worse):
                if p not in gone:
                    kept.append(p[1])
                    gone.update(worse[p])
            out = pd.DataFrame({"id": kept})
            for c in reversed(by):
                out.insert(0, c, rows[c].iloc[0])
            return out

        slim = open_.select(*by, F.col("up.s").alias("us"), F.col("up.id").alias("ui"), F.col("down.s").alias("ds"), F.col("down.id").alias("di"))
        out = out.unionByName(slim.groupBy(*by).applyInPandas(decided, ", ".join(f"{c} {kinds[c]}" for c in keys)))
    return out


def suppressed(boxes: DataFrame, threshold: float, least_score: float | None = None, by=BY, cell: float | None = None) -> DataFrame:
    """boxes (by, id, x0..y1, score) that greedy suppression keeps: by falling score (ties: the smaller id), a box stays if its IoU with all kept ones is at most the threshold.

    Overlaps are found by a grid of this cell size, by default the boxes' mean longer side, and decided in rounds, so an image's boxes spread over tasks.
    """
    own = boxes if least_score is None else boxes.where(F.col("score") > least_score)
    if cell is None:
        side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
        cell = own.agg(F.avg(F.when(side > 0, side))).first()[0] or 1.0
    pairs = overlapping_boxes(own.select(*by, "id", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]), float(cell), threshold, by)
    return own.join(undisputed(own, pairs, by), [*by, "id"], "left_semi").select(*by, "id", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], "score")


def suppressed_by_matrix(scores: DataFrame, overlaps: DataFrame, threshold: float, by=BY) -> DataFrame:
    """(by, id) that greedy suppression keeps, given pairs (by, a, b, iou) instead of boxes."""
    return undisputed(scores, overlaps.where(F.col("iou") > threshold), by)


def cleaned_and_suppressed(masks: DataFrame, pixels: DataFrame, least: int, threshold: float, by=BY) -> DataFrame:
    """(by, mask, y, x): masks cleaned of holes and islands, then those that box suppression keeps, where masks that cleaning left as they were count as better than changed ones (ties: the smaller)."""
    after, score = cleaned_once(masks, pixels, least, by)
    after = cut(after)
    own = boxes(after, by=by).join(score, [*by, "mask"]).withColumnRenamed("mask", "id")
    kept = suppressed(own, threshold, by=by).select(*by, F.col("id").alias("mask"))
    return after.join(kept, [*by, "mask"], "left_semi")


def stability(pixels: DataFrame, threshold: float, offset: float, symmetric: bool = True, by=BY) -> DataFrame:
    """(by, mask, score): pixels of logits above threshold + offset (symmetric; else above the threshold) over those above threshold - offset; 0 without any."""
    top, low = F.count_if(F.col("logit") > threshold + (offset if symmetric else 0)), F.count_if(F.col("logit") > threshold - offset)
    return pixels.groupBy(*by, "mask").agg(F.when(low > 0, top / low).otherwise(0.0).alias("score"))


def filtered(masks: DataFrame, least_iou: float, least_stability: float, least_area: int = 0, strict: bool = True) -> DataFrame:
    """Masks above the thresholds. strict: iou must be above, stability at least its own; else both and the area at least."""
    iou = F.col("iou") > least_iou if strict else F.col("iou") >= least_iou
    return masks.where(iou & (F.col("stability") >= least_stability) & (F.col("area") >= least_area))


def exclusive(pixels: DataFrame, clamp: float = -10.0, by=BY) -> DataFrame:
    """pixels (by, mask, y, x, logit) where only the mask of the highest logit (ties: the smallest) keeps it, others are at most `clamp`."""
    best = pixels.groupBy(*by, "y", "x").agg(F.max_by("mask", F.struct("logit", -F.col("mask"))).alias("best"))
    return pixels.join(best, [*by, "y", "x"]).withColumn("logit", F.when(F.col("mask") == F.col("best"), F.col("logit")).otherwise(F.least("logit", F.lit(clamp)))).drop("best")


def shrunk(pixels: DataFrame, ratio: float = 0.3, by=BY) -> DataFrame:
    """(by, mask, before, after, suppressed): masks that lose too much of their positive area to exclusivity."""
    own = exclusive(pixels, by=by).where("logit > 0").groupBy(*by, "mask").agg(F.count("*").alias("after"))
    was = pixels.where("logit > 0").groupBy(*by, "mask").agg(F.count("*").alias("before"))
    return was.join(own, [*by, "mask"], "left").select(*by, "mask", "before", F.coalesce("after", F.lit(0)).alias("after")).withColumn("suppressed", F.col("after") < ratio * F.col("before"))


def winners_by_score(pixels: DataFrame, scores: DataFrame, by=BY) -> DataFrame:
    """(by, mask, y, x): each positive pixel goes to the object of the highest score (ties: the smallest)."""
    return pixels.where("logit > 0").join(scores, [*by, "mask"]).groupBy(*by, "y", "x").agg(F.max_by("mask", F.struct("score", -F.col("mask"))).alias("mask")).select(*by, "mask", "y", "x")


def holes_and_sprinkles(pixels: DataFrame, most: int, by=BY) -> DataFrame:
    """pixels (by, mask, y, x, logit) with logit 0.1 in holes of at most `most` pixels and -0.1 in sprinkles of at most `most` pixels and half the mask's area."""
    positive = pixels.where("logit > 0")
    holes = pixel_components(pixels.where("logit <= 0"), [*by, "mask"]).where(F.col("area") <= most).select(*by, "mask", "y", "x", F.lit(True).alias("hole"))
    total = positive.groupBy(*by, "mask").agg(F.count("*").alias("total"))
    small = pixel_components(positive, [*by, "mask"]).join(total, [*by, "mask"]).where(F.col("area") <= F.least(F.lit(most), F.expr("total div 2"))).select(*by, "mask", "y", "x", F.lit(True).alias("sprinkle"))
    on = [*by, "mask", "y", "x"]
    return pixels.join(holes, on, "left").join(small, on, "left").withColumn("logit", F.when(F.col("hole"), 0.1).when(F.col("sprinkle"), -0.1).otherwise(F.col("logit"))).drop("hole", "sprinkle")


def union(masks: DataFrame, by=BY) -> DataFrame:
    return masks.select(*by, "y", "x").distinct()


def boundary(masks: DataFrame, by=BY) -> DataFrame:
    """(by, mask, y, x): pixels that differ from the right, lower or lower right neighbour within the mask's image; sizes are those of a column frame h, w."""
    steps = F.array(*[F.struct(F.lit(-a).alias("a"), F.lit(-b).alias("b")) for a, b in ((0, 0), (0, 1), (1, 0), (1, 1))])
    # how many of a pixel's own and three next places are in the mask: a boundary has some but not all
    spread = masks.select(*by, "mask", "h", "w", "y", "x", F.explode(steps).alias("s")).select(*by, "mask", "h", "w", (F.col("y") + F.col("s.a")).alias("y"), (F.col("x") + F.col("s.b")).alias("x")).where("y >= 0 AND x >= 0")
    inside = spread.groupBy(*by, "mask", "h", "w", "y", "x").agg(F.count("*").alias("n"))
    places = F.when(F.col("y") == F.col("h") - 1, 1).otherwise(2) * F.when(F.col("x") == F.col("w") - 1, 1).otherwise(2)
    return inside.where(F.col("n") < places).select(*by, "mask", "y", "x")


def dilated(pixels: DataFrame, radius: int, keys: list[str]) -> DataFrame:
    """Pixels within a disc about each pixel."""
    disc = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in disc])
    return pixels.select(*keys, "y", "x", F.explode(steps).alias("s")).select(*keys, (F.col("y") + F.col("s.a")).alias("y"), (F.col("x") + F.col("s.b")).alias("x")).distinct()


def boundary_f(est: DataFrame, ref: DataFrame, radius: int, everyone: DataFrame | None = None, by=BY) -> DataFrame:
    """(by, mask, f): agreement of two sets of boundary pixels within the radius. One empty gives 0; both empty give 1 for the masks of `everyone` (by, mask), else no row."""
    keys = [*by, "mask"]
    hit = lambda a, b: a.join(dilated(b, radius, keys), [*keys, "y", "x"], "left_semi").groupBy(*keys).agg(F.count("*").alias("hits"))
    size = lambda a: a.groupBy(*keys).agg(F.count("*").alias("n"))
    p = size(est).join(hit(est, ref), keys, "left").select(*keys, (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("p"))
    r = size(ref).join(hit(ref, est), keys, "left").select(*keys, (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("r"))
    both = p.join(r, keys, "full")
    found = both.select(*keys, F.coalesce(F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))), F.lit(0.0)).alias("f"))
    return found if everyone is None else everyone.select(*keys).distinct().join(found, keys, "left").select(*keys, F.coalesce("f", F.lit(1.0)).alias("f"))


def distance_transform(masks: DataFrame, sizes: DataFrame, by=BY) -> DataFrame:
    """(by, mask, y, x, d): Euclidean distance of each mask pixel from the nearest pixel outside; null if there is none.

    Two passes, over columns and over rows, so that a line and never an image meets in one task: the distance to the nearest outside pixel of the column, then the
    least of these and the steps along the row.
    """
    keys = [*by, "mask"]
    column, run = Window.partitionBy(*keys, "x").orderBy("y"), Window.partitionBy(*keys, "x", "run")
    own = masks.join(sizes, list(by)).select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"))
    own = own.withColumn("run", F.col("y") - F.row_number().over(column))
    first, last = F.min("y").over(run), F.max("y").over(run)
    far = F.least(F.when(first > 0, F.col("y") - first + 1), F.when(last < F.col("h") - 1, last - F.col("y") + 1))
    rows = own.withColumn("g", far).groupBy(*keys, "y", "w").agg(F.array_sort(F.collect_list(F.struct("x", "g"))).alias("line"))

    @F.pandas_udf("array<double>")
    def along(lines: pd.Series, widths: pd.Series) -> pd.Series:
        out = []
        for line, w in zip(lines, widths, strict=True):
            x = np.array([p["x"] for p in line])
            best = np.zeros(w)
            best[x] = [np.inf if p["g"] is None else float(p["g"]) ** 2 for p in line]
            start = best.copy()
            for k in range(1, w):
                if best.max() <= k * k:
                    break
                best[k:] = np.minimum(best[k:], start[:-k] + k * k)
                best[:-k] = np.minimum(best[:-k], start[k:] + k * k)
            out.append(np.where(np.isfinite(best[x]), np.sqrt(best[x]), np.nan))
        return pd.Series(out)

    found = rows.withColumn("d", along("line", "w")).select(*keys, "y", F.explode(F.arrays_zip("line", "d")).alias("p"))
    return found.select(*keys, "y", F.col("p.line.x").alias("x"), F.when(~F.isnan("p.d"), F.col("p.d")).alias("d"))


def error_prompts(est: DataFrame, ref: DataFrame, sizes: DataFrame, by=BY) -> DataFrame:
    """(by, mask, y, x, positive): the place farthest inside what est misses (positive) or has too much of ref, whichever is deeper; ties: misses, then the first pixel."""
    keys = [*by, "mask"]
    on = [*keys, "y", "x"]
    missed = distance_transform(ref.select(*on).join(est.select(*on), on, "left_anti"), sizes, by).withColumn("positive", F.lit(1))
    extra = distance_transform(est.select(*on).join(ref.select(*on), on, "left_anti"), sizes, by).withColumn("positive", F.lit(0))
    both = missed.unionByName(extra).where("d IS NOT NULL")
    return both.groupBy(*keys).agg(F.max_by(F.struct("y", "x", "positive"), F.struct("d", "positive", -F.col("y"), -F.col("x"))).alias("b")).select(*keys, "b.y", "b.x", (F.col("b.positive") == 1).alias("positive"))


def inside_samples(masks: DataFrame, sizes: DataFrame, n: int, seed: int = 0, by=BY) -> DataFrame:
    """(by, mask, k, sx, sy): n pixels of a mask by a hash, without repetition, as shares of the image, in order of x then y."""
    keys = [*by, "mask"]
    pick = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*keys, "y", "x")])))
    own = masks.withColumn("r", F.row_number().over(pick)).where(F.col("r") <= n).join(sizes, list(by))
    place = Window.partitionBy(*keys).orderBy("x", "y")
    return own.select(*keys, (F.row_number().over(place) - 1).alias("k"), (F.col("x") / (F.col("w") - 1)).alias("sx"), (F.col("y") / (F.col("h") - 1)).alias("sy"))


def best_candidate(candidates: DataFrame, by=BY) -> DataFrame:
    """(by, mask): of candidates (by, mask, both, n, n_ref, score) the one of the highest IoU with the truth (union at least 1); by score if every IoU of the whole table is 0. Ties: the smallest."""
    iou = candidates.withColumn("iou", F.col("both") / F.greatest(F.col("n") + F.col("n_ref") - F.col("both"), F.lit(1)))
    any_hit = F.broadcast(iou.agg((F.max("iou") > 0).alias("hit")))  # one row
    value = F.when(F.col("hit"), F.col("iou")).otherwise(F.col("score"))
    return iou.join(any_hit).groupBy(*by).agg(F.max_by("mask", F.struct(value, -F.col("mask"))).alias("mask"))


def point_grid(spark: SparkSession, n: int) -> DataFrame:
    """(x, y): n x n centres of cells of the unit square."""
    at = lambda c: (F.col(c) + 0.5) / n
    return spark.range(n * n).select(F.expr(f"id % {n}").alias("i"), F.expr(f"id div {n}").alias("j")).select(at("i").alias("x"), at("j").alias("y"))


def crop_boxes(spark: SparkSession, h: int, w: int, layers: int, overlap: float = 512 / 1500) -> DataFrame:
    """(layer, x0, y0, x1, y1): the whole image, then (2 ** i) ** 2 overlapping crops of each layer i."""
    rows = [(0, 0, 0, w, h)]
    for layer in range(1, layers + 1):
        n = 2**layer
        over = int(overlap * min(h, w) * (2 / n))
        cw, ch = -(-(over * (n - 1) + w) // n), -(-(over * (n - 1) + h) // n)
        rows += [(layer, x, y, min(x + cw, w), min(y + ch, h)) for x in ((cw - over) * i for i in range(n)) for y in ((ch - over) * i for i in range(n))]
    return spark.createDataFrame(rows, "layer int, x0 int, y0 int, x1 int, y1 int")


def uncropped(box: list[Column], crop: list[Column]) -> list[Column]:
    """A box or points (x, y, ..) of a crop (x0, y0, ..) in the image's coordinates."""
    return [c + crop[i % 2] for i, c in enumerate(box)]


def uncropped_masks(masks: DataFrame, crops: DataFrame, by=BY) -> DataFrame:
    """(by, mask, y, x): pixels of masks of crops (by, crop, mask, y, x) in the image; crops (by, crop, x0, y0, x1, y1). Pixels outside their crop are left out."""
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.col("x1") - F.col("x0")) & (F.col("y") < F.col("y1") - F.col("y0"))
    return masks.join(crops, [*by, "crop"]).where(inside).select(*by, "mask", (F.col("y") + F.col("y0")).alias("y"), (F.col("x") + F.col("x0")).alias("x"))


def layered_points(images: DataFrame, n: int, layers: int, shrink: int = 2) -> DataFrame:
    """images with layer, x, y: for each layer of crops from 0 on a grid of n // shrink ** layer points a side over the unit square."""
    def grid(layer: int, m: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(m * m - 1)), lambda i: F.struct(F.lit(layer).alias("layer"), ((i % m + 0.5) / m).alias("x"), ((F.floor(i / m) + 0.5) / m).alias("y")))

    rows = F.flatten(F.array(*[grid(layer, n // shrink**layer) for layer in range(layers + 1) if n // shrink**layer]))
    return images.withColumn("_p", F.explode(rows)).select(*images.columns, "_p.*")


def scaled_box(box: list[Column], w: Column, h: Column) -> list[Column]:
    """A box of shares of the image in pixels."""
    return [c * (h if i % 2 else w) for i, c in enumerate(box)]


def jittered(boxes: DataFrame, sizes: DataFrame, share: float = 0.1, most: float = 20.0, seed: int = 0, by=BY) -> DataFrame:
    """boxes (by, mask, x0, y0, x1, y1) with each side moved, by a hash, up to this share of the box's width or height, `most` pixels at most, within the image; sizes (by, h, w)."""
    draw = lambda c: 2 * F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(c), *[F.col(k).cast("string") for k in (*by, "mask")])), 1, 8), 16, 10).cast("double") / float(1 << 32) - 1
    own = boxes.join(sizes, list(by))
    reach = {"x": F.least((F.col("x1") - F.col("x0")) * share, F.lit(most)), "y": F.least((F.col("y1") - F.col("y0")) * share, F.lit(most))}
    end = {"x": F.col("w") - 1, "y": F.col("h") - 1}
    return own.select(*by, "mask", *[F.greatest(F.least(F.col(c) + draw(c) * reach[c[0]], end[c[0]].cast("double")), F.lit(0.0)).alias(c) for c in ("x0", "y0", "x1", "y1")])


def uniform_prompts(est: DataFrame, ref: DataFrame, pixels: DataFrame, seed: int = 0, by=BY) -> DataFrame:
    """(by, mask, y, x, positive): of the pixels in which est and ref differ one by a hash, positive where est misses it; of masks without any, a pixel outside the mask, not positive. pixels (by, y, x) is the whole image."""
    keys, on = [*by, "mask"], [*by, "mask", "y", "x"]
    missed = ref.select(*on).join(est.select(*on), on, "left_anti").withColumn("positive", F.lit(True))
    extra = est.select(*on).join(ref.select(*on), on, "left_anti").withColumn("positive", F.lit(False))
    wrong = missed.unionByName(extra)
    right = ref.select(*keys).distinct().join(wrong.select(*keys).distinct(), keys, "left_anti")
    outside = right.join(pixels.select(*by, "y", "x"), list(by)).join(ref.select(*on), on, "left_anti").withColumn("positive", F.lit(False))
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in on]))
    return wrong.unionByName(outside.select(*wrong.columns)).groupBy(*keys).agg(F.min_by(F.struct("y", "x", "positive"), F.struct(draw, "y", "x")).alias("b")).select(*keys, "b.*")


def scaled_points(x: Column, y: Column, w: Column, h: Column, resolution: int) -> list[Column]:
    return [x / w * resolution, y / h * resolution]


def box_prompt(box: list[Column]) -> Column:
    """A box as two corner points labelled 2 and 3."""
    return F.array(F.struct(box[0].alias("x"), box[1].alias("y"), F.lit(2).alias("label")), F.struct(box[2].alias("x"), box[3].alias("y"), F.lit(3).alias("label")))


# --- cues, annotations and candidates ---------------------------------------------------------------

def of_cues(cues: dict[str, DataFrame], by=BY) -> DataFrame:
    """Masks of several cues as one table: pixels (by, cue, mask, y, x), masks numbered from 1 in order of cue and mask."""
    rows = None
    for name, own in cues.items():
        own = own.select(*by, F.lit(name).alias("cue"), F.col("mask").alias("_old"), "y", "x")
        rows = own if rows is None else rows.unionByName(own)
    numbers = rows.select(*by, "cue", "_old").distinct().withColumn("mask", F.row_number().over(Window.partitionBy(*by).orderBy("cue", "_old")))
    return rows.join(numbers, [*by, "cue", "_old"]).select(*by, "cue", "mask", "y", "x")


def annotation_kind(json: Column) -> Column:
    """What an annotation is: polygons (a list), counts (an object with a list of counts), coded (with a string of them), none."""
    counts = F.get_json_object(json, "$.counts")
    return F.when(F.ltrim(json).startswith("["), "polygons").when(counts.startswith("["), "counts").when(counts.isNotNull(), "coded").otherwise("none")


def best_of_queries(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cand, logit, multi): of each query the candidate of the highest logit (ties: the smaller), and all of them by candidate."""
    rows = F.array_sort(F.collect_list(F.struct("cand", "logit")))
    return candidates.groupBy(*keys).agg(F.max_by(F.struct("cand", "logit"), F.struct("logit", -F.col("cand"))).alias("b"), rows.alias("multi")).select(*keys, "b.cand", "b.logit", "multi")
