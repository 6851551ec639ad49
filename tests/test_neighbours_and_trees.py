"""Neighbours, spanning trees, joining edges and clusters against plain versions."""

import itertools
import random

import numpy as np
import pytest

from facetflow.operators import features, graph

POINTS = "mesh int, f bigint, x double, y double, z double"


def cloud(seed, n, mesh):
    r = random.Random(seed)
    rows = [(mesh, i * 3 + 1, r.gauss(0, 1), r.gauss(0, 1), r.gauss(0, 0.01)) for i in range(n - 12)]
    rows += [(mesh, 10_000 + i, 50.0 + i * i, -3.0, 0.0) for i in range(6)] + [(mesh, 20_000 + i, 7.0, 7.0, 7.0) for i in range(6)]  # far ones, and one place for several
    return rows


def d2(a, b):
    return (a[2] - b[2]) * (a[2] - b[2]) + (a[3] - b[3]) * (a[3] - b[3]) + (a[4] - b[4]) * (a[4] - b[4])


@pytest.mark.parametrize("k", [1, 4, 30])
def test_nearest_is_exact(spark, k):
    rows = cloud(1, 150, 0) + cloud(2, 40, 1) + [(2, 1, 0.0, 0.0, 0.0), (3, 1, 1.0, 1.0, 1.0), (3, 2, 1.0, 1.0, 1.0)]
    found = features.nearest(spark.createDataFrame(rows, POINTS).withColumnRenamed("f", "id"), k)
    expected = []
    for mesh in range(4):
        own = [r for r in rows if r[0] == mesh]
        for a in own:
            best = sorted((d2(b, a), b[1]) for b in own if b is not a)[:k]
            expected += [(mesh, a[1], other, rank) for rank, (_, other) in enumerate(best, 1)]
    assert sorted((r["mesh"], r["id"], r["other"], r["rank"]) for r in found.collect()) == sorted(expected)


def kruskal(edges, start):
    comp, out = dict(start), []
    for w, a, b in sorted(edges):
        if comp[a] != comp[b]:
            low, high = sorted((comp[a], comp[b]))
            comp = {n: low if c == high else c for n, c in comp.items()}
            out.append((a, b, w))
    return out, comp


@pytest.mark.parametrize("limits", [{}, {"TREE": 20, "TASK": 5}])
def test_spanning_tree_as_by_kruskal(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(features if name == "TREE" else graph, name, value)
    r = random.Random(3)
    rows = [(mesh, *sorted(r.sample(range(60), 2)), float(r.randint(1, 20))) for mesh in range(2) for _ in range(150)]
    parts = [(mesh, n, n // 4 * 4) for mesh in range(2) for n in range(40)]
    edges, known = spark.createDataFrame(rows, "mesh int, src bigint, dst bigint, w double"), spark.createDataFrame(parts, "mesh int, n bigint, c bigint")
    for given in (None, known):
        found = sorted(map(tuple, features.spanning_tree(edges, parts=given).collect()))
        expected = []
        for mesh in range(2):
            start = {n: n for n in range(60)} | ({n: c for m, n, c in parts if m == mesh} if given is not None else {})
            least = {}
            for m, a, b, w in rows:
                if m == mesh:
                    least[a, b] = min(w, least.get((a, b), w))
            expected += [(mesh, a, b, w) for a, b, w in kruskal([(w, a, b) for (a, b), w in least.items()], start)[0]]
        assert found == sorted(expected)


def test_components_of_any_type(spark, monkeypatch):
    pairs = [("b", "c"), ("é", "a"), ("c", "z"), ("q", "q"), ("é", "ü"), (None, "a")]
    rows = spark.createDataFrame(pairs, "src string, dst string")
    few = sorted(map(tuple, graph.components(rows).collect()))
    monkeypatch.setattr(graph, "TASK", 0)
    assert few == sorted(map(tuple, graph.components(rows).collect())) == [("a", "a"), ("b", "b"), ("c", "b"), ("z", "b"), ("é", "a"), ("ü", "a")]


def test_joining_edges(spark):
    rows = cloud(5, 90, 0) + cloud(6, 60, 1)
    parts = [(m, f, f // 60 * 60) for m, f, *_ in rows]
    points, comps = spark.createDataFrame(rows, POINTS), spark.createDataFrame(parts, "mesh int, f bigint, comp bigint")
    one = [tuple(r) for r in features.joining_edges(points, comps, 3, whole=False).collect()]
    all_ = [tuple(r) for r in features.joining_edges(points, comps, 3).collect()]
    for mesh in range(2):
        own = [r for r in rows if r[0] == mesh]
        near = {tuple(sorted((a[1], o))): d for a in own for d, o in sorted((d2(b, a), b[1]) for b in own if b is not a)[:3]}
        expected, _ = kruskal([(d**0.5, a, b) for (a, b), d in near.items()], {f: c for m, f, c in parts if m == mesh})
        assert sorted((a, b) for m, a, b, _ in one if m == mesh) == sorted((a, b) for a, b, _ in expected)
        _, comp = kruskal([(w, a, b) for m, a, b, w in all_ if m == mesh], {f: c for m, f, c in parts if m == mesh})
        assert len(set(comp.values())) == 1 and {(a, b) for m, a, b, _ in one if m == mesh} <= {(a, b) for m, a, b, _ in all_ if m == mesh}
    tree = features.component_edges(points, comps, 100)
    assert tree.where("mesh = 0").count() == len({c for m, _, c in parts if m == 0}) - 1
    assert features.component_edges(points, comps, 2, with_neighbours=True).count() >= tree.count() - 2


def plain_clusters(x, may, clusters, linkage):
    """Greedy over all pairs; distances of sides only where `may` is given."""
    own = {i: [i] for i in range(len(x))}
    dist = {(i, j): float(np.sqrt(((x[i] - x[j]) ** 2).sum())) for i, j in itertools.combinations(range(len(x)), 2) if may is None or (i, j) in may or (j, i) in may}
    while len(own) > clusters and dist:
        (i, j), d = min(dist.items(), key=lambda e: (e[1], e[0]))
        fresh = {}
        for k in own:
            if k not in (i, j):
                p, q = dist.get((min(i, k), max(i, k))), dist.get((min(j, k), max(j, k)))
                if p is None and q is None:
                    continue
                n, m = len(own[i]), len(own[j])
                if linkage == "ward":
                    s = len(own[k])
                    new = (((n + s) * p * p + (m + s) * q * q - s * d * d) / (n + m + s)) ** 0.5
                elif p is None or q is None:
                    new = p if q is None else q
                else:
                    new = (n * p + m * q) / (n + m) if linkage == "average" else max(p, q) if linkage == "complete" else min(p, q)
                fresh[min(i, k), max(i, k)] = new
        dist = {e: v for e, v in dist.items() if i not in e and j not in e} | fresh
        own[i] += own.pop(j)
    return sorted(sorted(v) for v in own.values())


@pytest.mark.parametrize(("linkage", "touch"), [("average", True), ("complete", True), ("single", True), ("average", False), ("complete", False), ("ward", False)])
def test_clusters_as_by_the_plain_way(spark, linkage, touch):
    r = np.random.default_rng(7)
    x = r.standard_normal((128, 5))
    sides = [(int(a), int(b)) for a, b in r.integers(0, 128, (260, 2)) if a != b]
    vectors = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "mesh int, f bigint, v array<double>")
    adjacent = spark.createDataFrame([(0, a, b) for a, b in sides], "mesh int, src bigint, dst bigint") if touch else None
    found = {}
    for row in features.agglomerated(vectors, adjacent, 7, linkage).collect():
        found.setdefault(row["cluster"], []).append(row["f"])
    expected = plain_clusters(x, set(sides) if touch else None, 7, linkage)
    assert sorted(map(sorted, found.values())) == expected
    sweep = features.cut_to(features.merges(vectors, adjacent, linkage), vectors, [3, 7, 128]).groupBy("clusters").agg({"cluster": "max"}).collect()
    assert {r["clusters"]: r["max(cluster)"] + 1 for r in sweep}[128] == 128


def test_many_faces_in_little_memory():
    r = np.random.default_rng(8)
    n = 15_000
    x = r.standard_normal((n, 16))
    a = np.concatenate([np.arange(n - 1), np.arange(n - 125)])
    b = np.concatenate([np.arange(1, n), np.arange(125, n)])
    assert len(features._touching(x, a, b, "average")) == n - 1
