"""Quality by nearest-neighbour voting in a latent semantic space."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetflow.llm.common import fold

DIMENSIONS, LATENT, PER_LABEL, NEIGHBOURS = 4096, 48, 2000, 15
SHAPES = 1024  # the first dimensions are for shapes, the rest for words
MEMO = 300_000

LOWER, UPPER, DIGITS = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")


def shape(word: str) -> str:
    """Runs of small letters, capitals and digits become one sign each; the rest stays, at most 8 signs of it."""
    return DIGITS.sub("9", UPPER.sub("A", LOWER.sub("a", word)))[:8]


class Words(dict):
    """word -> its shape's and its own dimension, packed; forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        own = zlib.crc32(word.lower().encode("utf-8", "surrogatepass"))
        packed = zlib.crc32(b"s" + shape(word).encode("utf-8", "surrogatepass")) % (1 << 20) << 32 | own
        self[word] = packed
        return packed


def features(texts: list[str | None], memo: Words) -> np.ndarray:
    """Counts (texts x DIMENSIONS): shapes of words, of neighbouring pairs, a word that repeats the one before, and the words themselves."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    for i, text in enumerate(texts):
        words = (text or "").split()
        if words:
            packed = np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words))
            shapes, own = packed >> 32, packed & 0xFFFFFFFF
            pairs = (shapes[:-1] * 1000003 + shapes[1:]) % (SHAPES - 1)
            same = int((own[:-1] == own[1:]).sum())
            found = np.concatenate([shapes % (SHAPES - 1), pairs, own % (DIMENSIONS - SHAPES) + SHAPES])
            out[i] = np.bincount(found, minlength=DIMENSIONS)
            out[i, SHAPES - 1] = 2 * same
    return out


def weighted(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Shares of the shapes by square root, and words by log count and rarity; either part has length 1, words count a third."""
    x = np.sqrt(counts)
    x[:, SHAPES:] = np.log1p(counts[:, SHAPES:]) * rarity[SHAPES:]
    for part, much in ((slice(0, SHAPES), 1.0), (slice(SHAPES, None), 0.33)):
        size = np.linalg.norm(x[:, part], axis=1, keepdims=True)
        x[:, part] *= much / np.where(size > 0, size, 1)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 1e-12, size, 1)


@dataclass
class Model:
    """Bounded by its parameters: DIMENSIONS x LATENT numbers and at most 2 x PER_LABEL latent vectors, by their documents' ids."""

    rarity: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def scores(self, texts: list[str | None], memo: Words) -> np.ndarray:
        """Of each text the similarity-weighted share of label 1 among its nearest labelled vectors; 0.5 without words or labels."""
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return np.full(len(texts), 0.5)
        counts = features(texts, memo)
        # double precision and rounding: a text's votes don't hang on what else is in its batch
        cosines = np.round(unit(weighted(counts, self.rarity).astype(np.float64) @ self.axes) @ self.vectors.T, 9)
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        if k < len(self.labels):
            last = np.take_along_axis(cosines, near, axis=1).min(axis=1, keepdims=True)
            for row in np.flatnonzero((cosines >= last).sum(axis=1) > k):  # a tie at the last place: the smaller ids vote
                near[row] = np.argsort(-cosines[row], kind="stable")[:k]
        w = np.clip(np.take_along_axis(cosines, near, axis=1), 0, 1).astype(np.float64) ** 8
        total = w.sum(axis=1)
        votes = (w * self.labels[near]).sum(axis=1)
        return np.where((total > 0) & (counts.sum(axis=1) > 0), np.clip(votes / np.where(total > 0, total, 1), 0, 1), 0.5)


def labelled(docs: DataFrame, labels: DataFrame, key: str, label: str, text: str, per_label: int, held_out: bool = True) -> DataFrame:
    """id, label and text of at most per_label documents a label, the first by a hash of the key; held_out: none from fold 1 of 3. A document's label is the least of its rows, and of repeated ids the least text counts."""
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    if held_out:
        known = known.where(fold("id", 3) != 1)
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    first = [known.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(per_label) for v in (0, 1)]
    ids = F.broadcast(first[0].unionByName(first[1]))  # at most 2 x per_label rows
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(ids, "id").groupBy("id", "label").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", text: str = "text", per_label: int = PER_LABEL, seed: int = 5, held_out: bool = True) -> Model:
    """Latent semantic vectors of a bounded sample of labelled documents (per_label a label), made in tasks and gathered as sparse counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                counts = features(part.column(2).to_pylist(), memo)
                cells = [np.flatnonzero(c).astype(np.int32) for c in counts]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(cells, pa.list_(pa.int32())), pa.array([c[i] for c, i in zip(counts, cells, strict=True)], pa.list_(pa.float32()))], names=["id", "label", "cells", "counts"])

    sample = labelled(docs, labels, key, label, text, per_label, held_out).select("id", "label", "text")
    rows = sample.mapInArrow(run, f"id {sample.schema['id'].dataType.simpleString()}, label int, cells array<int>, counts array<float>").toArrow().sort_by("id")
    n = rows.num_rows
    counts = np.zeros((n, DIMENSIONS), dtype=np.float32)
    for i, (cells, values) in enumerate(zip(rows["cells"], rows["counts"], strict=True)):
        counts[i, cells.values.to_numpy()] = values.values.to_numpy()
    rarity = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    x = weighted(counts, rarity)
    del counts
    width = max(1, min(LATENT, n, DIMENSIONS))
    probe = x.T @ (x @ np.random.default_rng(seed).standard_normal((DIMENSIONS, width + 8), dtype=np.float32))
    for _ in range(3):
        probe, _ = np.linalg.qr(x.T @ (x @ probe))
    basis, _ = np.linalg.qr(probe)
    _, _, axes = np.linalg.svd(x @ basis, full_matrices=False)
    axes = (basis @ axes[:width].T).astype(np.float64)
    latent = np.concatenate([x[i : i + 256].astype(np.float64) @ axes for i in range(0, n, 256)]) if n else np.zeros((0, width))
    return Model(rarity, axes, unit(latent), rows["label"].to_numpy().astype(np.float64) if n else np.zeros(0))


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, score (0 to 1, higher: label 1 likelier; 0.5 for null and empty texts). Repeated rows give repeated rows; other columns are ignored. Narrow."""
    kind, shared = docs.schema[key].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.record_batch([part.column(0), pa.array(shared.value.scores(part.column(1).to_pylist(), memo), pa.float64())], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")


def kept(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores at least `least`, all columns as they are. Null and empty texts score 0.5; repeated rows stay repeated; an empty table stays empty."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield part.filter(pa.array(shared.value.scores(part.column(at).to_pylist(), memo) >= least))

    return docs.mapInArrow(run, docs.schema)


def classified(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out (crc32 of the key modulo 3 is 1), score, predicted (1 if score >= 0.5) for every row of docs; see fit and scored.

    The k labelled vectors of the largest cosines vote, of equal ones those of the smaller ids; whole texts of any length count. Null and empty texts score 0.5, repeated rows alike.
    An empty table gives an empty result; without labels all score 0.5. Other columns are ignored.
    """
    return scored(docs, fit(docs, labels, key=key, text=text), key, text).select(key, (fold(key, 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
