"""Similar short texts that share a bucket with a hub that takes neither in."""

import math

import numpy as np
import xxhash

from facetflow.llm import near_dup


def test_short_texts_away_from_hubs(spark):
    rows, texts = [], []
    for group in range(60):
        a = [f"g{group}a{i}" for i in range(8)]  # 4 runs, all of which the next has, of 5
        for words in ([f"g{group}h{i}" for i in range(8)], a, [*a, "more"]):
            rows.append((len(rows), " ".join(words)))
            texts.append((bytearray(xxhash.xxh3_128_digest(rows[-1][1].encode())), rows[-1][0], len(words) - 4, [group]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    own = spark.createDataFrame(texts, "text_key binary, id bigint, n bigint, sketch array<bigint>")
    found = near_dup.links(own, docs, "doc_id", "text", 0.8).where("similar").collect()
    ids = {bytes(k): i for k, i, _, _ in texts}
    assert {tuple(sorted((ids[bytes(r["a"])], ids[bytes(r["b"])]))) for r in found} == {(3 * g + 1, 3 * g + 2) for g in range(60)}


def test_first_shingles_of_similar_texts_meet():
    r = np.random.default_rng(4)
    for _ in range(500):
        n = int(r.integers(1, 60))
        a = r.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.concatenate([a[: math.ceil(0.8 * n)], r.integers(0, 1 << 62, n // 8).astype(np.uint64)])
        common = np.unique(r.choice(a, n // 2)).view(np.int64)
        places = r.permutation(len(common)) + 1
        if near_dup.aligned(a, b):
            first = [set(near_dup.least_first(x, common, places, 0.8).tolist()) for x in (a, b)]
            assert first[0] & first[1]
