"""Known results on tiny inputs, and invariants."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetflow.operators import features, geometry, graph, labels, lifting, masks, metrics, mincut, pixels, skew, text, tracking
from facetflow.sources import meshes


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def path(spark, n):
    return spark.createDataFrame([(0, a, b) for i in range(n - 1) for a, b in ((i, i + 1), (i + 1, i))], "mesh int, src int, dst int")


def labelled(spark, values):
    return spark.createDataFrame([(0, i, v) for i, v in enumerate(values) if v is not None], "mesh int, f int, label int")


def test_agreement(spark):
    own = spark.createDataFrame([(0, a, b) for a, b in zip([0, 0, 1, 1, 2, 2], [0, 1, 3, 2, 2, 2], strict=True)], "mesh int, est int, ref int")
    r = metrics.agreement(own).first()
    expected = {"hamming_rm": 1 / 6, "hamming_rf": 1 / 3, "hamming": 1 / 4, "inverse_rand": 4 / 15, "lce": 1 / 12, "gce": 2 / 9}
    assert all(math.isclose(r[k], v) for k, v in expected.items())
    assert metrics.bounds(metrics.agreement(own)).count() == 0
    cells = metrics.margins(own).collect()
    assert {sum(c["n"] for c in cells if c["level"] == k) for k in range(4)} == {6}


@pytest.fixture(scope="module")
def octahedron(spark):
    vertices = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate([(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)])], "mesh int, v int, x double, y double, z double")
    faces = spark.createDataFrame([(0, i, list(f)) for i, f in enumerate([(0, 2, 4), (0, 4, 3), (0, 3, 5), (0, 5, 2), (1, 4, 2), (1, 3, 4), (1, 5, 3), (1, 2, 5)])], "mesh int, f int, v array<int>")
    return vertices, faces


def test_cut_discrepancy(spark, octahedron):
    vertices, faces = octahedron
    est, ref = labelled(spark, [0, 0, 0, 0, 1, 1, 1, 1]), labelled(spark, [0, 1, 1, 0, 0, 1, 1, 0])
    assert rows(geometry.cut_vertices(faces, est), "v") == [(v,) for v in (2, 3, 4, 5)]
    assert rows(geometry.cut_vertices(faces, ref), "v") == [(v,) for v in (0, 1, 4, 5)]
    assert math.isclose(geometry.cut_discrepancy(faces, vertices, est, ref).first()["value"], math.sqrt(1.5))
    assert geometry.cut_discrepancy(faces, vertices, est, labelled(spark, [0] * 8)).first()["value"] == 0


def test_run_lengths(spark):
    for pixels, counts, area in ((["011", "001"], [2, 1, 1, 2], 3), (["11", "11"], [0, 4], 4)):
        own = spark.createDataFrame([(0, 1, y, x) for y, line in enumerate(pixels) for x, c in enumerate(line) if c == "1"], "img int, mask int, y int, x int")
        size = spark.createDataFrame([(0, len(pixels), len(pixels[0]))], "img int, h int, w int")
        r = masks.run_lengths(own, size).first()
        assert (r["counts"], r["area"]) == (counts, area)
        assert rows(masks.from_run_lengths(masks.run_lengths(own, size), size), "y", "x") == rows(own, "y", "x")


def test_painted(spark):
    own = spark.createDataFrame([(0, 1, 0, x) for x in range(4)] + [(0, 2, 0, x) for x in (2, 3)], "img int, mask int, y int, x int")
    pixels = spark.createDataFrame([(0, 0, x, x != 5) for x in range(6)], "img int, y int, x int, foreground boolean")
    assert [r[1] for r in rows(masks.with_foreground(pixels, masks.painted(own)), "x", "label")] == [2, 2, 3, 3, 1, 0]


@pytest.mark.parametrize(("before", "after"), [([1, 1, 2, 1, 0, 0], [1, 1, 2, 3, 4, 4]), ([0, 0, 1, 0], [2, 2, 1, 3])])
def test_split(spark, before, after):
    own = labelled(spark, before)
    found = rows(labels.split(labels.label_components(own, path(spark, len(before)))), "f", "label")
    assert [v for _, v in found] == after


@pytest.mark.parametrize(("start", "rounds", "after"), [([1, None, None, None, 2], 64, [1, 1, 1, 2, 2]), ([0, None, None, None, 2], 64, [0, 2, 2, 2, 2]), ([1, None, None, None, 2], 1, [1, 1, None, 2, 2])])
def test_holes(spark, start, rounds, after):
    found = dict(rows(labels.fill_holes(labelled(spark, start), path(spark, 5), rounds), "f", "label"))
    assert [found.get(i) for i in range(5)] == after


def test_suppression(spark):
    own = spark.createDataFrame([(0, *r) for r in [("a", 0.0, 0.0, 10.0, 10.0, 0.9), ("b", 1.0, 1.0, 11.0, 11.0, 0.8), ("c", 20.0, 20.0, 30.0, 30.0, 0.7), ("d", 0.0, 0.0, 10.0, 5.0, 0.6)]], "img int, id string, x0 double, y0 double, x1 double, y1 double, score double")
    assert rows(masks.suppressed(own, 0.5), "id") == [("a",), ("c",), ("d",)]
    pairs = masks.overlapping_boxes(own, 7.0)
    assert rows(masks.suppressed_by_matrix(own.select("img", "id", "score"), pairs, 0.5), "id") == [("a",), ("c",), ("d",)]
    assert {(r["a"], r["b"]): round(r["iou"], 6) for r in pairs.collect()} == {("a", "b"): 0.680672, ("a", "d"): 0.5, ("b", "d"): round(36 / 114, 6)}


def test_counters(spark):
    def frames(values):
        return spark.createDataFrame([(0, 1, i, bool(v)) for i, v in enumerate(values)], "session int, obj int, frame int, matched boolean")

    found = rows(tracking.keep_alive(frames([1, 1, 1, 0, 0, 0, 0, 0, 1]), 0, 2, -1), "frame", "alive")
    assert [v for _, v in found] == [1, 2, 2, 1, 0, -1, -1, -1, 0]
    found = rows(tracking.confirmed(frames([1, 1, 0, 1, 1, 1, 0]), 3), "frame", "run", "confirmed")
    assert [r[1] for r in found] == [1, 2, 0, 1, 2, 3, 0] and [r[2] for r in found] == [False] * 5 + [True, True]


@pytest.mark.parametrize(("ratios", "threshold"), [([1.0, 1.0], 1.01), ([1 / 6] * 6, 0.17), ([0.02] + [0.5] * 7, 0.075), ([0.3, 0.3] + [0.6] * 7, 0.31)])
def test_ratio_threshold(spark, ratios, threshold):
    own = spark.createDataFrame([(0, i, r) for i, r in enumerate(ratios)], "mesh int, l1 int, ratio double")
    assert math.isclose(lifting.ratio_threshold(own).first()["threshold"], threshold)


def test_closest_frames(spark):
    for q, frames, k, expected in ((10, [0, 4, 9, 10, 13, 20], 4, [4, 9, 10, 13]), (5, [6, 7, 8, 9], 3, [6, 7, 8])):
        own = spark.createDataFrame([(0, f) for f in frames], "session int, frame int")
        assert [f for (f,) in rows(tracking.closest_frames(spark.createDataFrame([(0, q)], "session int, q int"), own, k), "frame")] == expected


def test_last_view_wins(spark):
    votes = spark.createDataFrame([(0, 0, 0, 1, 50), (0, 1, 0, 2, 3)], "mesh int, view int, f int, label int, n int")
    none = spark.createDataFrame([], "mesh int, label int, hook int")
    assert lifting.lifted(lifting.winners(votes), votes, none).first()["label"] == 2
    assert lifting.lifted(lifting.winners(votes), votes, none, merge="sum").first()["label"] == 1


def test_components_in_any_order(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(20)] + [(7, 7), (None, 3)]
    for _ in range(2):
        r.shuffle(edges)
        found = dict(rows(graph.components(spark.createDataFrame(edges, "src int, dst int")), "node", "component"))
        assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(20)}
    assert graph.components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_expansion_is_the_cheapest_move():
    r = np.random.default_rng(2)
    for _ in range(20):
        n = 6
        ends = np.array(list(itertools.combinations(range(n), 2)))[r.random(15) < 0.4].reshape(-1, 2)
        cost, was = r.random(len(ends)) * 2, r.integers(0, 3, n)
        label = r.integers(0, 3, n)
        moved = mincut._expand(label, was, ends, cost, 1)
        best = min(mincut._energy(np.where(np.array(take), 1, label), was, ends, cost) for take in itertools.product([False, True], repeat=n))
        assert mincut._energy(moved, was, ends, cost) <= best + 1e-4


def test_assignment_is_the_best():
    r = np.random.default_rng(3)
    for n, m in ((3, 3), (2, 4), (4, 2), (1, 1)):
        cost = r.random((n, m))
        best = min(sum(cost[i, p[i]] for i in range(n)) if n <= m else sum(cost[p[j], j] for j in range(m)) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        assert math.isclose(sum(cost[a, b] for a, b in tracking._assigned(cost)), best)


def test_spanning_tree_and_linkage(spark):
    own = spark.createDataFrame([(0, a, b, float(w)) for a, b, w in [(0, 1, 1), (1, 2, 5), (0, 2, 4), (2, 3, 2), (4, 5, 3)]], "mesh int, src int, dst int, w double")
    tree = features.spanning_tree(own)
    assert rows(tree, "src", "dst") == [(0, 1), (0, 2), (2, 3), (4, 5)]
    nodes = spark.createDataFrame([(0, i) for i in range(6)], "mesh int, n int")
    assert rows(features.single_linkage(tree, nodes, 2.5), "n", "cluster") == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 4), (5, 5)]


@pytest.mark.parametrize("linkage", ["average", "complete", "single", "ward"])
def test_agglomeration(spark, linkage):
    own = spark.createDataFrame([(0, i, [x, 0.0]) for i, x in enumerate([0.0, 0.1, 0.2, 5.0, 5.1, 9.0])], "mesh int, f bigint, v array<double>")
    found = [c for _, c in rows(features.agglomerated(own, None, 3, linkage), "f", "cluster")]
    assert found == [0, 0, 0, 1, 1, 2]


def test_mesh_files(spark, tmp_path):
    (tmp_path / "a.obj").write_text("# x\nv 0 0 0\nv 1 0 0\nv 0 1 0\nvn 0 0 1\nf 1//1 2//1 3//1\nf -3 -2 -1\n")
    (tmp_path / "b.off").write_text("OFF\n3 1 0\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")
    (tmp_path / "c.ply").write_text("ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")
    vertices, faces = meshes.mesh(spark, str(tmp_path))
    assert rows(faces.withColumn("v", F.array_join("v", ",")), "mesh", "f", "v") == [("a", 0, "0,1,2"), ("a", 1, "0,1,2"), ("b", 0, "0,1,2"), ("c", 0, "0,1,2")]
    assert vertices.count() == 9 and meshes.listed(spark, str(tmp_path)).count() == 3
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "m.seg").write_text("3\n4\n4\n")
    (tmp_path / "s" / "n.json").write_text('{"0": 1, "1": 2, "3": 2}')
    assert rows(meshes.line_labels(spark, f"{tmp_path}/s/*.seg"), "mesh", "f", "label") == [("m", 0, 3), ("m", 1, 4), ("m", 2, 4)]
    assert rows(meshes.gaps(meshes.json_labels(spark, f"{tmp_path}/s/*.json")), "mesh", "faces", "last") == [("n", 3, 3)]


def test_channel_sets():
    assert text.channel_sets("x\n- matte, sdf, mask\n") == [["matte", "sdf", "mask"]]
    for bad in ("", "- matte, sdf", "- a, b, c"):
        with pytest.raises(ValueError):
            text.channel_sets(bad)


def test_byte_pairs(spark):
    merges = [("t", "h"), ("th", "e</w>")]
    own = spark.createDataFrame([(["the", "é"],)], "words array<string>")
    ids = own.select(text.byte_pairs(merges, 8)("words").alias("ids")).first()["ids"]
    assert len(ids) == 8 and ids[0] == 514 and ids[1] == 513 and text.decoded(ids[1:4], merges) == "the é"
    assert len(set(text.byte_letters().values())) == 256


def test_keep_alive_over_chunks(spark):
    """Counted frame by frame, at chunks of any size."""
    moves = [(i * 7919 % 13) < 6 for i in range(200)]
    frames = spark.createDataFrame([("s", 1, i, m) for i, m in enumerate(moves)], "session string, obj int, frame bigint, matched boolean")
    value, expected = 0, []
    for m in moves:
        value = max(-1, min(5, value + (1 if m else -1)))
        expected.append(value)
    for chunk in (3, 64, 1000):
        assert [r["alive"] for r in tracking.keep_alive(frames, 0, 5, -1, chunk).orderBy("frame").collect()] == expected


def test_hot_keys_meet_in_parts(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), "id").where("k < 2 OR id < 10")
    single = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k bigint, name string")
    hot = skew.parts_of(rows.groupBy("k").count(), "k", "count", 100)
    assert hot.count() == 2 and hot.agg(F.min("parts")).first()[0] > 10
    assert skew.parts_of(rows.groupBy("k").count(), "k", "count", 10_000) is None
    assert skew.met(rows, single, None, "k", "id").count() == rows.count()
    found = skew.met(rows, single, hot, "k", "id")
    assert found.count() == rows.count() and found.where("(k = 0) <> (name = 'a')").count() == 0
    assert skew.dealt(rows, hot, "k", "id").select("k", "part").distinct().count() > 20


def test_unfinished_iterations_raise(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    with pytest.raises(RuntimeError):
        graph.components(edges, rounds=1)


def test_sessions(spark):
    types = ["add", "start", "add", "remove", "add", "reset", "add", "close", "close", "add"]
    for n, expected in ((1, (False, [])), (3, (True, [1])), (4, (True, [])), (5, (True, [1])), (6, (True, [])), (7, (True, [1])), (9, (False, [])), (10, (False, []))):
        rows = spark.createDataFrame([("s", i, t, 1) for i, t in enumerate(types[:n])], "session string, seq int, type string, obj int")
        assert [(r["open"], r["objs"]) for r in tracking.session_states(rows).collect()] == [expected]


def test_dendrogram_cut_stops_at_the_number(spark):
    merges = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 2, 3.0), (0, 2, 3, 2.0)], "mesh int, src long, dst long, w double")
    nodes = spark.createDataFrame([(0, i) for i in range(4)], "mesh int, n long")
    assert sorted((r["n"], r["cluster"]) for r in features.dendrogram_cut(merges, nodes, 2).collect()) == [(0, 0), (1, 0), (2, 2), (3, 2)]


def test_pixel_functions(spark):
    row = spark.range(1).select(
        pixels.packed(F.array(F.lit(300.0)), True).alias("grey"),
        pixels.packed(F.array().cast("array<double>"), False).alias("none"),
        pixels.linspace(F.lit(1.0), F.lit(2.0), 5).alias("line"),
        pixels.padded_concat(F.array(F.lit(1.0), F.lit(9.0)), F.array(F.lit(False), F.lit(True)), F.array(F.lit(2.0)), F.array(F.lit(False))).alias("both"),
        pixels.shaded(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0)), [F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))], F.array(F.lit(0.0), F.lit(1.0))).alias("dark"),
    ).first()
    assert row["grey"] == [1.0] * 3 and row["none"] == [0.0] * 3 and row["line"] == [1.0, 1.25, 1.5, 1.75, 2.0] and row["both"] == [1.0, 2.0, 0.0] and row["dark"] == 0.0


def test_pre_tokens_of_any_script(spark):
    row = spark.range(1).select(text.pre_tokens(F.lit("привет! łódź it's 42½ ok")).alias("t")).first()
    assert row["t"] == ["привет", "!", "łódź", "it", "'s", "4", "2", "½", "ok"]


def test_empty_masks(spark):
    none = spark.createDataFrame([], "img int, mask int, y int, x int")
    one, everyone = spark.createDataFrame([(0, 1, 2, 3)], none.schema), spark.createDataFrame([(0, 1), (0, 2)], "img int, mask int")
    assert rows(masks.boxes(one, everyone=everyone), "mask", "x0", "y0", "x1", "y1") == [(1, 3, 2, 3, 2), (2, 0, 0, 0, 0)]
    assert rows(masks.boundary_f(one, none, 1, everyone), "mask", "f") == [(1, 0.0), (2, 1.0)]


def test_view_along_up_moves_the_eye(spark):
    own = spark.createDataFrame([(0.0, 3.0, 0.0), (0.0, 0.0, 3.0)], "x double, y double, z double")
    poses = [r["p"] for r in own.select(geometry.look_at([F.col(c) for c in "xyz"], [F.lit(0.0)] * 3).alias("p")).collect()]
    assert [poses[0][i] for i in (3, 7, 11)] == [1e-6, 3.000001, 1e-6] and [poses[1][i] for i in (3, 7, 11)] == [0.0, 0.0, 3.0]
    assert [round(v, 6) for v in poses[1]] == [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 3, 0, 0, 0, 1]
