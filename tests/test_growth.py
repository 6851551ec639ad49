"""What larger tables showed: assignments without overlap, components over tiles, estimates."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from facetflow.operators import masks, tracking
from facetflow.plans import mask_queries, mesh_queries
from facetflow.sources import meshes


def test_pairs_without_overlap_are_assigned(spark):
    rows = [(1, 1, 1, 2, 0.0), (1, 1, 2, 1, 0.0), (1, 2, 1, 1, 0.0), (1, 2, 1, 2, 0.7), (1, 2, 3, 1, 0.0), (1, 3, 1, 1, 0.5), (1, 3, 2, 1, 0.6)]
    found = tracking.assigned(spark.createDataFrame(rows, "session int, frame int, trk int, det int, iou double"), 0.0)
    assert sorted(tuple(r) for r in found.select("frame", "trk", "det", "iou").collect()) == [(1, 1, 2, 0.0), (1, 2, 1, 0.0), (2, 1, 2, 0.7), (2, 3, 1, 0.0), (3, 2, 1, 0.6)]


def flooded(pixels, eight):
    """(first pixel, area) of each pixel's component, by walking."""
    found, left = {}, set(pixels)
    while left:
        todo, own = [min(left)], set()
        while todo:
            y, x = todo.pop()
            if (y, x) in left:
                left.remove((y, x))
                own.add((y, x))
                todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if eight or not a * b]
        found |= {p: (min(own), len(own)) for p in own}
    return found


@pytest.mark.parametrize("eight", [True, False])
@pytest.mark.parametrize("tile, lot", [(8, 50), (256, 100_000)])
def test_components_over_tiles(spark, monkeypatch, eight, tile, lot):
    monkeypatch.setattr(masks, "TILE", tile)
    monkeypatch.setattr(masks, "LOT", lot)
    draw = random.Random(7)
    images = {("a", 1): 0.45, ("a", None): 0.6, ("b", 1): 0.5}
    own = {k: [(y, x) for y in range(-15, 25) for x in range(-9, 30) if draw.random() < share] for k, share in images.items()}
    rows = [(i, m, y, x) for (i, m), pixels in own.items() for y, x in pixels] + [("a", 2, None, 3), ("a", 2, None, 4), ("a", 2, 5, 4)]
    found = masks.pixel_components(spark.createDataFrame(rows, "img string, mask int, y int, x int"), ["img", "mask"], eight)
    got = {(r["img"], r["mask"], r["y"], r["x"]): (tuple(r["comp"]), r["area"]) for r in found.collect()}
    want = {("a", 2, y, x): ((y, x), 1) for y, x in [(None, 3), (None, 4), (5, 4)]}
    for (i, m), pixels in own.items():
        want |= {(i, m, *p): v for p, v in flooded(pixels, eight).items()} if m is not None else {}
    assert got == want and len(got) == found.count()


def test_small_images_take_no_rounds(spark, small, monkeypatch):
    def none(*_):
        raise AssertionError("components of a graph")

    monkeypatch.setattr(masks, "components", none)
    assert masks.pixel_components(mask_queries.discs(spark, small), ["img", "mask"]).count() == mask_queries.discs(spark, small).count()


@pytest.mark.parametrize("rows", [mask_queries.grid, mask_queries.discs, mask_queries.logits, mesh_queries.vertices, mesh_queries.quads, mesh_queries.faces, mesh_queries.face_labels, mesh_queries.sides])
def test_estimates_are_of_rows_made(spark, tmp_path, rows):
    """A table of 15,000 bytes must not pass for as small as what it is made of, or a large one is broadcast."""
    folder = f"{tmp_path}/{rows.__name__}"
    spark.range(400).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{folder}/supplier.parquet")
    found = rows(spark, folder)
    assert int(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >= 8 * found.count()


def test_files_are_written_by_several_tasks(spark, tmp_path):
    lines = spark.range(40).select(F.col("id").alias("mesh"), F.lit(0).alias("part"), F.lit(0).alias("id"), F.lit("v 0 0 0").alias("line"))
    meshes.write_obj(lines, f"{tmp_path}/out")
    files = glob.glob(f"{tmp_path}/out/mesh=*/part-*.txt")
    assert len(files) == 40 and len({f.rpartition("/")[2][:10] for f in files}) > 1


def test_absent_results_are_made_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(tracking, "BLOCK", 2)
    rows = [(1, o, f, "cond" if f % 2 else "non", f) for o in (1, 2) for f in range(5) if (o + f) % 3] + [(2, 1, None, "non", 7)]
    outputs = spark.createDataFrame(rows, "session int, obj int, frame int, kind string, area int")
    found = sorted((tuple(r) for r in tracking.consolidated(outputs, outputs, outputs).collect()), key=repr)
    there = {(s, f, o): (k, a) for s, o, f, k, a in rows if f is not None}
    assert found == sorted([(1, f, o, *there.get((1, f, o), ("absent", 0))) for o in (1, 2) for f in range(5)] + [(2, None, 1, "absent", 0)], key=repr)
