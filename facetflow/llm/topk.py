"""Exact top-k search by integer inner product over a bit-sliced index."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from facetflow.llm.vectors import search_all

def quantised(v: np.ndarray) -> np.ndarray:
    """floor(256 * x) of each component, exactly; an array of Python integers where a long is too short."""
    m, e = np.frexp(v.astype(np.float64))
    if not len(v) or e.max() <= 52:
        return np.floor(256.0 * v.astype(np.float64)).astype(np.int64)
    whole = [int(math.ldexp(x, 53)) << (y - 45) if y >= 45 else math.floor(math.ldexp(x, y + 8)) for x, y in zip(m.ravel().tolist(), e.ravel().tolist(), strict=True)]
    return np.array(whole, dtype=object).reshape(v.shape)


def bits(column: np.ndarray, words: int) -> np.ndarray:
    """Booleans as a bitmap of 64-bit words, row i at bit i % 64 of word i // 64."""
    out = np.zeros(words * 8, dtype=np.uint8)
    packed = np.packbits(column, bitorder="little")
    out[: len(packed)] = packed
    return out.view(np.uint64)


def pack_index(ids: np.ndarray, vectors: np.ndarray) -> tuple:
    """A block of the index: for each attribute its least value and the bitmaps of its distance from it, least significant first."""
    x = quantised(vectors)
    low = x.min(axis=0)
    x = x - low
    words = -(-len(ids) // 64)
    widths = [int(v).bit_length() for v in x.max(axis=0)]
    slices = [bits((x[:, d] >> b & 1).astype(bool), words) for d, width in enumerate(widths) for b in range(width)]
    return ids, low.tolist(), widths, np.array(slices, dtype=np.uint64).reshape(-1, words)


def pack_query(ids: np.ndarray, vectors: np.ndarray) -> tuple:
    return ids, quantised(vectors).tolist()


def added(slices: np.ndarray, column: dict[int, list[int]]) -> list[np.ndarray]:
    """Bitmaps of a sum, least significant first. column[w]: the rows of `slices` that count 2**w each.

    Full adders turn three bitmaps of a weight into one and a carry, all triples of a weight at a time.
    """
    out, carried = [], []
    weight, last = 0, max(column, default=-1)
    while weight <= last or carried:
        own = [slices[column[weight]]] if weight in column else []
        now = np.concatenate(own + carried) if own or carried else None
        carried = []
        if now is None:
            out.append(np.zeros(slices.shape[1], dtype=np.uint64))
        else:
            while len(now) > 1:
                if len(now) == 2:
                    carried.append((now[:1] & now[1:]))
                    now = now[:1] ^ now[1:]
                    break
                n = len(now) // 3
                a, b, c = now[:n], now[n : 2 * n], now[2 * n : 3 * n]
                either = a ^ b
                carried.append((a & b) | (either & c))
                now = np.concatenate([either ^ c, now[3 * n :]])
            out.append(now[0])
        weight += 1
    return out


def first_rows(sums: list[np.ndarray], inside: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap of rows surely among the k largest, bitmap of the rows tied at the boundary), from the most significant bitmap downward."""
    sure, tied = np.zeros_like(inside), inside
    for s in reversed(sums):
        more = sure | (tied & s)
        n = int(np.bitwise_count(more).sum())
        if n > k:
            tied = tied & s
        else:
            sure = more
            tied = tied & ~s
            if n == k:
                return sure, np.zeros_like(inside)
    return sure, tied


def rows_of(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:n])


def value_at(sums: list[np.ndarray], row: int) -> int:
    return sum((int(s[row >> 6]) >> (row & 63) & 1) << w for w, s in enumerate(sums))


def searcher(k: int):
    def search(index: tuple, queries: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, low, widths, slices = index
        n, words = len(ids), slices.shape[1]
        both = np.concatenate([slices, ~slices])  # the second half stands for (2**width - 1) - distance
        first = np.concatenate([[0], np.cumsum(widths)]).astype(int)
        everyone = bits(np.ones(n, dtype=bool), words)
        order = np.argsort(ids, kind="stable")
        own_ids = ids[order]
        outs: tuple[list, list, list] = ([], [], [])
        for qid, weights in zip(queries[0].tolist(), queries[1], strict=True):
            column: dict[int, list[int]] = {}
            base = sum(w * v for w, v in zip(weights, low, strict=True))
            for d, (w, width) in enumerate(zip(weights, widths, strict=True)):
                if w and width:
                    at = first[d] if w > 0 else first[d] + len(slices)
                    base += 0 if w > 0 else w * ((1 << width) - 1)
                    for j in range(abs(w).bit_length()):
                        if abs(w) >> j & 1:
                            for b in range(width):
                                column.setdefault(j + b, []).append(at + b)
            sums = added(both, column)
            inside = everyone
            a, b = np.searchsorted(own_ids, [qid, qid + 1])
            if b > a:
                inside = everyone.copy()
                for row in order[a:b]:
                    inside[row >> 6] &= ~np.uint64(1 << (int(row) & 63))
            sure, tied = first_rows(sums, inside, k)
            rows = rows_of(sure, n)
            ties = rows_of(tied, n)
            ties = ties[np.argsort(ids[ties], kind="stable")][: k - len(rows)]
            for row in np.concatenate([rows, ties]).tolist():
                score = base + value_at(sums, row)
                if not -(1 << 63) <= score < 1 << 63:
                    raise OverflowError(f"the score of {qid} and {ids[row]} needs more than 64 bits")
                for out, x in zip(outs, (qid, ids[row], score), strict=True):
                    out.append(x)
        return tuple(np.array(o, dtype=np.int64) for o in outs)

    return search


def top_k(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose key is divisible by `every` the k other rows of the largest inner product of floor(256 * x), exactly; ties go to the smaller vec_id.

    Vectors null, empty or with null or non-finite components take no part, nor do rows with a null key. Vectors of another length
    than the query's have no inner product with it. Components of any size are exact; OverflowError if a score among a
    block's best needs more than 64 bits. A row of the query's own key is no candidate; a repeated row asks, and is a candidate, once for
    each row, and a key that asks several times has its k best of all pairs. An empty table gives an empty result; fewer candidates than k give all.
    Other columns are ignored. Work is queries times rows by definition, in bitmaps; nothing is collected and a block hands on k rows a query.
    """
    return search_all(vectors, key, column, every, k, pack_index, pack_query, searcher(k), "bigint")


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
