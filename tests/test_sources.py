"""Mesh files of all kinds, also odd and cut short; frames as batch and stream; sinks that skip, keep or replace."""

import io
import json
import struct
import zipfile

import numpy as np
import pytest

from facetflow.session import cached
from facetflow.sources import frames, mesh_formats, mesh_source, meshes
from facetflow.sources.mesh_formats import decoded, made, triangles
from facetflow.streaming.tracks import run_once

CUBE = triangles([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0.5]], [0, 1, 2, 0, 2, 3])


def same(a, b):
    return np.allclose(a.points, b.points) and a.sizes.tolist() == b.sizes.tolist() and a.corners.tolist() == b.corners.tolist()


@pytest.mark.parametrize("kind", sorted(mesh_formats.ENCODERS))
def test_round_trip_and_cut_short(kind):
    raw = mesh_formats.ENCODERS[kind](CUBE)
    assert same(decoded(kind, raw), CUBE)
    for n in (0, 10, len(raw) // 2, len(raw) - 8):
        with pytest.raises(ValueError):
            decoded(kind, raw[:n])


def test_ply_of_any_order():
    ascii_ = b"ply\nformat ascii 1.0\nelement vertex 3\nproperty float z\nproperty float x\nproperty float y\nelement edge 1\nproperty int a\nproperty int b\nelement face 2\nproperty uchar flag\nproperty list uchar int vertex_indices\nend_header\n3 1 2\n6 4 5\n9 7 8\n0 1\n7 3 0 1 2\n7 3 2 1 0\n"
    expected = made([[1, 2, 3], [4, 5, 6], [7, 8, 9]], [3, 3], [0, 1, 2, 2, 1, 0])
    assert same(decoded("ply", ascii_), expected)
    for order, name in (("<", "little"), (">", "big")):
        head = f"ply\r\nformat binary_{name}_endian 1.0\r\nelement face 3\r\nproperty uchar flag\r\nproperty list uchar int vertex_index\r\nelement vertex 4\r\nproperty double x\r\nproperty double y\r\nproperty double z\r\nproperty uchar red\r\nend_header\r\n".encode()
        faces = struct.pack(f"{order}BB3i", 9, 3, 0, 1, 2) + struct.pack(f"{order}BB4i", 9, 4, 3, 2, 1, 0) + struct.pack(f"{order}BB3i", 9, 3, 2, 1, 3)
        points = b"".join(struct.pack(f"{order}3dB", i, i + 1, i + 2, 7) for i in range(4))
        found = decoded("ply", head + faces + points)
        assert found.sizes.tolist() == [3, 4, 3] and found.corners.tolist() == [0, 1, 2, 3, 2, 1, 0, 2, 1, 3] and found.points[3].tolist() == [3, 4, 5]
        for raw in (head + faces, head + faces[:7], head + faces + points[:-1]):
            with pytest.raises(ValueError):
                decoded("ply", raw)
    assert same(decoded("ply", mesh_formats.to_ply(CUBE, ">")), CUBE)


def test_stl_of_text_and_gltf_of_nodes_and_3mf_of_components():
    text = "solid a\n" + "".join(f"facet normal 0 0 1\nouter loop\n{''.join(f'vertex {x} {y} {z}\n' for x, y, z in CUBE.points[[a, b, c]].tolist())}endloop\nendfacet\n" for a, b, c in ((0, 1, 2), (0, 2, 3))) + "endsolid a\n"
    assert same(decoded("stl", text.encode()), CUBE)
    head = json.loads(mesh_formats.to_gltf(CUBE))
    head["nodes"] = [{"children": [1], "translation": [10, 0, 0], "rotation": [0, 0, 2**-0.5, 2**-0.5]}, {"mesh": 0, "scale": [2, 2, 2]}, {"mesh": 0}]
    head["scenes"][0]["nodes"] = [0, 2]
    found = decoded("gltf", json.dumps(head).encode())
    assert len(found.points) == 8 and np.allclose(found.points[1], [10, 2, 0]) and np.allclose(found.points[5], [1, 0, 0]) and found.corners.max() == 7
    head["nodes"][1]["children"] = [0]
    with pytest.raises(ValueError):
        decoded("gltf", json.dumps(head).encode())
    raw = mesh_formats.to_3mf(CUBE)
    with zipfile.ZipFile(io.BytesIO(raw)) as packed:
        model = packed.read("3D/3dmodel.model").decode()
    model = model.replace("</resources>", '<object id="2"><components><component objectid="1" transform="1 0 0 0 1 0 0 0 1 5 0 0"/><component objectid="1"/></components></object></resources>').replace('<item objectid="1"/>', '<item objectid="2" transform="1 0 0 0 1 0 0 0 1 0 7 0"/>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as packed:
        packed.writestr("3D/3dmodel.model", model)
    found = decoded("3mf", out.getvalue())
    assert len(found.points) == 8 and found.points[0].tolist() == [5, 7, 0] and found.points[4].tolist() == [0, 7, 0]


def test_source_plans_partitions_and_fails_on_broken_files(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"m{i}.stl").write_bytes(mesh_formats.to_stl(CUBE))
    (tmp_path / "other.txt").write_text("no mesh")
    mesh_source.register(spark)
    rows = spark.read.format("meshes").option("partitionBytes", 400).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 3 and rows.count() == 5 * (4 + 2)
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted(map(tuple, meshes.elements(spark, str(tmp_path)).collect()), key=repr)
    points, _ = meshes.mesh(spark, str(tmp_path), normalise="cube")
    assert max(abs(r["x"]) for r in points.collect()) == pytest.approx(0.999)
    (tmp_path / "broken.glb").write_bytes(mesh_formats.to_glb(CUBE)[:50])
    for read in (spark.read.format("meshes").load(str(tmp_path)), meshes.elements(spark, str(tmp_path))):
        with pytest.raises(Exception, match="broken.glb"):
            read.collect()


def test_frames_resume_without_loss_or_repeat(spark, tmp_path):
    frames.register(spark)
    folder = str(tmp_path / "in")
    write = lambda numbers: frames.write_frames(spark.createDataFrame([(s, n, f"{s}{n}".encode()) for s in "ab" for n in numbers], "session string, frame bigint, content binary"), folder)
    stream = lambda: spark.readStream.format("frames").option("framesPerSecond", 10).load(folder)
    assert write(range(3, 12)) == 18
    assert spark.read.format("frames").load(folder).count() == 18
    first = run_once(stream(), f"{tmp_path}/run")
    assert first.count() == 18
    write([12, 13])
    (tmp_path / "in" / "a" / "notes.txt").write_text("x")
    found = run_once(stream(), f"{tmp_path}/run").collect()
    assert sorted((r["session"], r["frame"]) for r in found) == [(s, n) for s in "ab" for n in range(3, 14)]
    assert all(bytes(r["content"]).decode() == f"{r['session']}{r['frame']}" and r["ts"].timestamp() == pytest.approx(r["frame"] / 10) for r in found)


def test_cache_is_kept_or_replaced(spark, tmp_path):
    path, made_ = str(tmp_path / "cache"), []

    def make(n):
        return lambda: made_.append(n) or spark.range(n)

    assert cached(spark, path, make(3)).count() == 3
    assert cached(spark, path, make(5)).count() == 3 and made_ == [3]
    assert cached(spark, path, make(5), overwrite=True).count() == 5 and made_ == [3, 5]
    assert cached(spark, path, lambda: spark.read.parquet(path).limit(2), overwrite=True).count() == 2
    (tmp_path / "cache" / "_SUCCESS").unlink()
    assert cached(spark, path, make(4)).count() == 4
