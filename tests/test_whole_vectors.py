"""Vector queries over whole tables."""

from facetflow.plans import catalog


def test_index_merge_takes_all_values(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    values = {r["vec_id"]: round(r["embedding"][3] + 0.5, 6) for r in rows}
    found = catalog.QUERIES["index_merge"](spark, small).collect()
    assert max(r["idx"] for r in found) > 50
    assert all(abs(r["value"] - values.get(r["idx"], 0.0)) < 2e-6 for r in found)


def test_spanning_tree_holds_all_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "label").collect()
    ids = {r["vec_id"] for r in rows}
    edges = sorted((r["label"] % 2, ((i := r["vec_id"]) * 7919 + s * 104729) % 10007 / 10.0, i, i + s) for r in rows for s in (2, 6, 14) if r["vec_id"] + s in ids)
    root, total = {}, 0.0

    def find(x):
        while (up := root.get(x, x)) != x:
            x = up
        return x

    count = 0
    for mesh, w, a, b in edges:
        a, b = find((mesh, a)), find((mesh, b))
        if a != b:
            root[a], total, count = b, total + w, count + 1
    found = catalog.QUERIES["mst_edges"](spark, "/root/testdata/sf0.1").collect()
    assert len(found) == count and abs(sum(r["w"] for r in found) - total) < 1e-6 and max(r["dst"] for r in found) > 500
