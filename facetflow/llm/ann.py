"""Approximate nearest neighbours by cosine: randomly rotated one-bit codes, then exact reranking."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame

from facetflow.llm.vectors import search_all


@functools.lru_cache(maxsize=4)
def rotation(length: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every worker."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((length, length)))
    return q * np.sign(np.diag(r))


def scaled(v: np.ndarray) -> np.ndarray:
    """Vectors in double precision, divided by the power of two next to their largest component: cosines stay, squares cannot overflow."""
    v = v.astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def words_of(signs: np.ndarray) -> np.ndarray:
    """Booleans (rows x length) as rows of 64-bit words."""
    packed = np.packbits(signs, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def packer(seed: int):
    def pack_index(ids: np.ndarray, vectors: np.ndarray) -> tuple:
        """A block of the index: the signs of the rotated unit vectors as bits, how many are set, each code's inner product with its vector (the correction), and the vectors as they came."""
        v = scaled(vectors)
        turned = (v / norms(v)[:, None]) @ rotation(v.shape[1], seed)
        codes = words_of(turned > 0)
        return ids, np.ascontiguousarray(codes.T), np.bitwise_count(codes).sum(axis=1, dtype=np.int64), np.abs(turned).sum(axis=1) / np.sqrt(v.shape[1]), vectors

    return pack_index


def query_packer(seed: int, planes: int = 8):
    def pack_query(ids: np.ndarray, vectors: np.ndarray) -> tuple:
        """Query vectors, and their rotated unit vectors as steps of `planes` bits above the least component: bit planes, least component, step, sum of components."""
        v = scaled(vectors)
        turned = (v / norms(v)[:, None]) @ rotation(v.shape[1], seed)
        low, step = turned.min(axis=1), np.maximum(np.ptp(turned, axis=1) / ((1 << planes) - 1), 1e-300)
        u = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
        return ids, v, np.stack([words_of(u >> j & 1) for j in range(planes)], axis=1), low, step, turned.sum(axis=1)

    return pack_query


def searcher(k: int, bound: float):
    def search(index: tuple, queries: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, codes, set_bits, correction, vectors = index
        n, length = vectors.shape
        root = np.sqrt(length)
        spread = bound * np.sqrt(np.maximum(1 - correction**2, 0)) / correction / np.sqrt(max(1, length - 1))
        outs: tuple[list, list, list] = ([], [], [])
        for qid, q, planes, low, step, whole in zip(*queries, strict=True):
            own = norms(q[None, :])

            def cosines(rows: np.ndarray) -> np.ndarray:
                v = scaled(vectors[rows])
                return (v * q).sum(axis=1) / (norms(v) * own)  # noqa: B023

            # inner product of the code's set bits with the query's steps, by popcounts of a plane at a time
            steps = np.zeros(n, dtype=np.int64)
            for j, plane in enumerate(planes):
                for code, word in zip(codes, plane, strict=True):
                    if word:
                        steps += np.bitwise_count(code & word).astype(np.int64) << j
            guess = (2 * (low * set_bits + step * steps) - whole) / (root * correction)
            high = guess + spread + step * root / 2 / correction
            guess[ids == qid] = high[ids == qid] = -np.inf
            # the k-th exact score of the likeliest rows is what the rest has to reach
            likely = np.argpartition(-guess, 4 * k)[: 4 * k] if n > 4 * k else np.arange(n)
            likely = likely[ids[likely] != qid]
            score = cosines(likely)
            least = np.partition(score, len(score) - k)[len(score) - k] if len(score) >= k else -np.inf
            rows = np.setdiff1d(np.flatnonzero((high >= least) & (ids != qid)), likely, assume_unique=True)
            rows, score = np.concatenate([likely, rows]), np.concatenate([score, cosines(rows)])
            best = np.lexsort((ids[rows], -score))[:k]
            for out, x in zip(outs, (np.full(len(best), qid), ids[rows][best], score[best]), strict=True):
                out.append(x)
        return tuple(np.concatenate(o) if o else np.zeros(0) for o in outs)

    return search


def nearest(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", every: int = 50, k: int = 5, seed: int = 7, bound: float = 3.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose key is divisible by `every` the k nearest other rows found by cosine, nearest first, ties to the smaller vec_id.

    Every row is indexed and every code is looked at, by popcounts of packed words. Of a block the rows of the highest estimates are
    reranked with their original vectors; then each whose estimate plus `bound` times its standard error reaches the k-th of these, so that a true
    neighbour is missed only when its estimate is too low by more than that. Scores are exact cosines in double precision.
    Vectors null, empty, zero or with null or non-finite components take no part, nor do rows with a null key; vectors of
    another length than the query's have no cosine with it. A row of the query's own key is no candidate; a repeated row asks, and is a
    candidate, once for each row, and a key that asks several times has its k best of all pairs. An empty table gives an empty result. Other columns are ignored.
    """
    return search_all(vectors, key, column, every, k, packer(seed), query_packer(seed), searcher(k, bound), "double", nonzero=True)
