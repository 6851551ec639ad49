"""Scores of the training table itself: as by a model of all n-grams, with little on disk."""

import math
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facetflow.llm import lm
from facetflow.session import shared_dir


def stored_bytes(spark):
    return sum(f.stat().st_size for f in Path(shared_dir(spark).removeprefix("file:")).rglob("*") if f.is_file())


def test_no_files_of_all_n_grams(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(2000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    before = stored_bytes(spark)
    assert lm.held_out_scores(docs).count() == len(texts)
    assert stored_bytes(spark) - before < 0.5 * sum(map(len, texts))


@pytest.mark.parametrize(("hot", "order"), [(24, 3), (500, 3), (10**12, 2), (10**12, 3), (10**12, 4)])
def test_hot_words_as_by_a_whole_model(spark, small, monkeypatch, hot, order):
    rng = random.Random(2)
    some = [(None, "null key"), (1, None), (1, ""), (2, "a " * 3000), (3, "a b " * 900), (3, "a b " * 900), (4, "never seen before")] + [(i, " ".join(rng.choices("abcde", k=300))) for i in range(5, 60)]
    docs = spark.createDataFrame(some, "doc_id bigint, text string").union(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(100))
    monkeypatch.setattr(lm, "HOT", hot)
    columns = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
    found = lm.held_out_scores(docs, order=order).select(*columns).collect()
    whole = lm.scored(docs, lm.fit(docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(0)) != 1), order=order)).collect()
    assert len(found) == len(whole) == docs.count()
    for a, b in zip(sorted(found, key=str), sorted(whole, key=str), strict=True):
        assert a[:4] == b[:4]
        assert all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a[4:], b[4:], strict=True))


class Task:
    @classmethod
    def get(cls):
        return cls

    @staticmethod
    def partitionId():
        return 3


def test_blocks_hold_every_token_once(monkeypatch, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(400)], k=rng.randrange(900))) for _ in range(20)] + [None, ""]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts), pa.array([i % 3 > 0 for i in range(len(texts))])], names=["key", "text", "train"])
    monkeypatch.setattr(lm, "TaskContext", Task)
    rows = lm.word_counts(5)(iter([pa.record_batch([batch.column(1)], names=["text"])]))
    found = list(lm.word_files(str(tmp_path), 5, 25)(rows))
    hot = lm.hot_flags([i for b in found for i in b["hot"][0].as_py()])
    assert 2 < hot.sum() < 402 and sum(b["words"][0].as_py() for b in found) == 401
    n = sum(b["occurrences"][0].as_py() for b in found)
    assert n == sum(len((t or "").split()) + 1 for t in texts)

    def held():
        out = []
        for b in lm.dealt_tokens(str(tmp_path), 3, 5, hot, n, 401)(iter([batch])):
            part, x = b["part"][0].as_py(), lm.block(b["data"][0].as_py())
            if len(x) > 2:
                out += [(x[0], int(text), bool(train), *map(int, words)) for text, train, *words in zip(x[2], x[3], *x[1], strict=True)]
                before = x[1][1]
                assert set(lm.part_of(lm.mix64(before[~lm.are_hot(before, hot)]), 5).tolist()) <= {part}
            else:
                out.append((x[0], len(pa.ipc.open_stream(x[1]).read_all())))
        return sorted(out)

    whole = held()
    assert len(whole) == n + 1 and (3 << 32, len(texts)) in whole
    monkeypatch.setattr(lm, "WINDOW", 70)
    monkeypatch.setattr(lm, "BLOCK", 500)
    assert held() == whole


def test_integers_taken_apart():
    for kind in (np.uint8, np.uint16, np.uint32, np.uint64, np.float64):
        x = np.arange(0, 200, dtype=kind) ** 2 if kind != np.uint8 else np.arange(200, dtype=kind)
        assert (lm.joined(lm.planes(x), kind) == x).all()
        assert (lm.joined(lm.planes(np.stack([x, x], axis=1)[:, 0]), kind) == x).all()  # a column of a table
        if kind != np.float64:
            assert (lm.climbed(*lm.steps(x), kind) == x).all()
    assert len(lm.climbed(*lm.steps(np.zeros(0, dtype=np.uint32)), np.uint32)) == 0
