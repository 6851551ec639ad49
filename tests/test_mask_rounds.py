"""Suppression in rounds, distances by lines, packed run lengths and running counts against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetflow.operators import masks, tracking


def greedy(boxes, threshold):
    kept = []
    for _, i, x0, y0, x1, y1 in sorted((-s, i, *b) for i, s, *b in boxes):
        def iou(k):
            w, h = min(x1, k[3]) - max(x0, k[1]), min(y1, k[4]) - max(y0, k[2])
            both = max(w, 0) * max(h, 0)
            return both / ((x1 - x0) * (y1 - y0) + (k[3] - k[1]) * (k[4] - k[2]) - both)

        if all(iou(k) <= threshold for k in kept):
            kept.append((i, x0, y0, x1, y1))
    return sorted(k[0] for k in kept)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_suppression_in_rounds(spark, monkeypatch, limit):
    monkeypatch.setattr(masks, "CONFLICTS", limit)
    r = random.Random(1)
    rows = []
    for img, n in ((0, 400), (1, 30), (2, 1)):
        for i in range(n):
            x, y, w, h = r.uniform(0, 100), r.uniform(0, 100), r.choice([4, 10, 60]), r.choice([5, 9, 40])
            rows.append((img, i, r.randint(0, 20) / 20, x, y, x + w, y + h))
    table = spark.createDataFrame(rows, "img int, id bigint, score double, x0 double, y0 double, x1 double, y1 double")
    found = masks.suppressed(table, 0.3).collect()
    for img in range(3):
        assert sorted(b["id"] for b in found if b["img"] == img) == greedy([b[1:] for b in rows if b[0] == img], 0.3)
    assert masks.suppressed(table.limit(0), 0.3).count() == 0


def test_distances_by_lines(spark):
    r = np.random.default_rng(2)
    images = {0: r.random((23, 17)) < 0.8, 1: np.ones((4, 5), dtype=bool), 2: r.random((9, 30)) < 0.97}
    rows = [(0, m, int(y), int(x)) for m, image in images.items() for y, x in np.argwhere(image)]
    table = spark.createDataFrame([(m, 1, y, x) for _, m, y, x in rows], "img int, mask int, y int, x int")
    sizes = spark.createDataFrame([(m, *image.shape) for m, image in images.items()], "img int, h int, w int")
    found = {(d["img"], d["y"], d["x"]): d["d"] for d in masks.distance_transform(table, sizes).collect()}
    assert len(found) == len(rows)
    for m, image in images.items():
        outside = np.argwhere(~image)
        for y, x in np.argwhere(image):
            expected = np.sqrt(((outside - [y, x]) ** 2).sum(axis=1)).min() if len(outside) else None
            assert found[m, y, x] == (pytest.approx(expected) if expected is not None else None)


def test_packed_counts(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([0, 1, 15, 16, 17, 511, 512, 2**20, 2**31 - 1, r.randint(0, 10**6)]) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 4, 5, 40, 300])]
    table = spark.createDataFrame(rows, "i int, counts array<int>").withColumn("text", masks.packed_counts(F.col("counts")))
    assert {d["i"]: d["again"] for d in table.select("i", masks.unpacked_counts(F.col("text")).alias("again")).collect()} == dict(rows)
    # by hand: 0, 2, 5 stand as they are; 6 is 4 above 2
    assert spark.createDataFrame([([0, 2, 5, 6],)], "counts array<int>").select(masks.packed_counts(F.col("counts"))).first()[0] == "0254"
    with pytest.raises(Exception, match="not run lengths"):
        spark.createDataFrame([("0o",), ("T",)], "t string").select(masks.unpacked_counts(F.col("t"))).collect()


def test_running_count_over_ranges(spark):
    rows = [(s, f) for s in range(3) for f in range(0, 400 * (s + 1), s + 1)]
    table = spark.createDataFrame(rows, "session int, frame bigint").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = tracking.running_count(table, ["session"], [F.col("frame")], F.col("frame") % 2 == 0, "n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, found)) == sorted((s, f, sum(g <= f and g % 2 == 0 for t, g in rows if t == s)) for s, f in rows)


def test_eviction_keeps_columns(spark):
    out = spark.createDataFrame([(0, 1, f, "x", True) for f in range(20)], "session int, obj int, frame bigint, row string, fix boolean")
    fixes = spark.createDataFrame([(0, 1, 5), (0, 1, 5), (0, 1, 30), (0, 2, 10)], "session int, obj int, at bigint")
    kept = tracking.evicted(out, fixes, 3)
    assert kept.columns == out.columns and sorted(r["frame"] for r in kept.collect()) == [0, 1, *range(9, 20)]
