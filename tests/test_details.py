"""Small functions and errors that no query shows."""

import json

import pytest
from pyspark.sql import functions as F

from facetflow.operators import features, geometry, masks, text, tracking
from facetflow.plans import catalog
from facetflow.sources import meshes


def test_columns_in_the_order_of_their_numbers(spark):
    own = spark.createDataFrame([(1.0, 2.0, 3.0, 9)], "features_10 double, features_2 double, features_0 double, features_x int")
    assert own.select(features.numbered_columns(own)).first()[0] == [3.0, 2.0, 1.0]


def test_pose_convention_turns_back(spark):
    pose = F.array(*[F.lit(float(i + 1)) for i in range(16)])
    once = spark.range(1).select(geometry.turned_convention(pose).alias("p"), geometry.turned_convention(geometry.turned_convention(pose)).alias("q")).first()
    assert once["p"] == [1, -2, -3, 4, 5, -6, -7, 8, 9, -10, -11, 12, 13, -14, -15, 16] and once["q"] == [float(i + 1) for i in range(16)]


def test_points_and_boxes_as_prompts(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    row = spark.range(1).select(F.array(*masks.scaled_points(*lit(320, 120, 640, 480), 1024)).alias("p"), masks.box_prompt(lit(1, 2, 3, 4)).alias("b"), F.array(*masks.scaled_box(lit(0.5, 0.25, 1, 1), F.lit(640), F.lit(480))).alias("s"), F.array(*masks.uncropped(lit(1, 2, 3, 4), lit(10, 20))).alias("u")).first()
    assert row["p"] == [512.0, 256.0] and [tuple(p) for p in row["b"]] == [(1.0, 2.0, 2), (3.0, 4.0, 3)]
    assert row["s"] == [320.0, 120.0, 640.0, 480.0] and row["u"] == [11.0, 22.0, 13.0, 24.0]


def test_crowd_annotations(spark, tmp_path):
    answer = lambda **c: {"answerContent": {k: {"label": v} for k, v in c.items()}}
    (tmp_path / "chair_1.json").write_text(json.dumps({"answers": [answer(a="b", c="a"), answer(a="c")], "more": 1}))
    (tmp_path / "cup.json").write_text(json.dumps({"answers": []}))
    assert sorted(map(tuple, meshes.annotations(spark, str(tmp_path)).collect())) == [("chair_1", "a"), ("chair_1", "b"), ("chair_1", "c")]


def test_unknown_object_is_an_error(spark):
    out = spark.createDataFrame([(0, 1, 5), (0, 2, 5)], "session int, obj int, frame int")
    objects = out.select("session", "obj")
    assert tracking.without_objects(out, objects, objects.where("obj = 1")).count() == 1
    with pytest.raises(ValueError, match="no such object"):
        tracking.without_objects(out, objects, spark.createDataFrame([(0, 3)], "session int, obj int"))


def test_boxes_of_empty_masks(spark):
    own = spark.createDataFrame([(0, 1, 2, 3)], "img int, mask int, y int, x int")
    everyone = spark.createDataFrame([(0, 1), (0, 2)], "img int, mask int")
    assert sorted(map(tuple, masks.boxes(own, everyone=everyone).collect())) == [(0, 1, 3, 2, 3, 2), (0, 2, 0, 0, 0, 0)]
    assert sorted(map(tuple, masks.boxes(own, True, everyone).collect())) == [(0, 1, 3, 2, 4, 3), (0, 2, 0, 0, 0, 0)]


def test_byte_pairs_of_a_public_vocabulary(spark, small):
    """Equal to the tokenizers library on whole documents, and back again."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").join(catalog.QUERIES["vocabulary_pairs"](spark, small), "doc_id").collect()
    for r in docs:
        expected = plain.encode(r["text"].lower(), add_special_tokens=False).ids
        assert r["ids"] == [49406, *expected, 49407], r["doc_id"]
    assert "".join(text.decoded(docs[0]["ids"], path).split()) == "".join(docs[0]["text"].lower().split())
