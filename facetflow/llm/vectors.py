"""Searches of a stated query set against all vectors, slot by slot.

Rows are packed into blocks as they stream from the scan. Each slot of the index holds blocks of one
vector length and of bounded size; a task keeps its slot's blocks and lets all query blocks stream past them, so an index
block is shuffled once and a query block once a slot. Only the best few rows of each query and slot go on.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, QUERY_ROWS = 16_384, 512
SLOT_CELLS, LEAST_ROWS = 1 << 26, 2048  # components a slot holds at most (or one block), rows it is worth a task for
MOST_LENGTHS = 10_000  # different lengths of vectors: their counts are collected, more raise ValueError


def usable(vectors: DataFrame, key: str, column: str, nonzero: bool = False) -> DataFrame:
    """Rows that take part, with columns id, v (array of the column's own numbers) and n (its length).

    Null ids, null or empty vectors and vectors with null or non-finite components take no part; nonzero: nor do zero vectors.
    """
    finite = lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= F.lit(1.7976931348623157e308))  # noqa: E731  NaN is above all numbers
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & (F.size("v") > 0))
    if nonzero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.withColumn("n", F.size("v"))


def packed(rows: DataFrame, size: Callable[[int], int], pack: Callable[[np.ndarray, np.ndarray], tuple]) -> DataFrame:
    """rows as blocks (n, at, block) of vectors of one length, size(n) rows at most; pack(ids, vectors) makes them. Blocks of a length are numbered by partition (`at`), those of one partition one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        rows_held: dict[int, int] = {}

        def out(n: int) -> pa.RecordBatch:
            nonlocal made
            parts = held.pop(n)
            rows_held.pop(n)
            block = pickle.dumps(pack(np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])), protocol=5)
            made += 1
            return pa.record_batch([pa.array([n], pa.int32()), pa.array([first + made - 1], pa.int64()), pa.array([block], pa.binary())], names=["n", "at", "block"])

        for batch in batches:
            lengths = batch.column(2).to_numpy()
            for n in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == n)) if len(lengths) and (lengths != n).any() else batch
                step = min(size(n), 1024)
                for start in range(0, own.num_rows, step):
                    part = own.slice(start, step)
                    if rows_held.get(n, 0) + part.num_rows > size(n):
                        yield out(n)
                    held.setdefault(n, []).append((part.column(0).to_numpy(), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)))
                    rows_held[n] = rows_held.get(n, 0) + part.num_rows
            while sum(n * r for n, r in rows_held.items()) > 2 * SLOT_CELLS:  # many lengths
                yield out(max(rows_held, key=lambda n: n * rows_held[n]))
        for n in list(held):
            yield out(n)

    return rows.select("id", "v", "n").mapInArrow(run, "n int, at bigint, block binary")


def searched(rows: DataFrame, asking: DataFrame, k: int, pack_index: Callable, pack_query: Callable, search: Callable[[tuple, tuple], tuple[np.ndarray, np.ndarray, np.ndarray]], kind: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of search(index block, query block) -> (query ids, vec ids, scores) over all rows (id, v, n) of a query's length."""
    spark = rows.sparkSession
    counts = {r["n"]: r["count"] for r in rows.groupBy("n").count().limit(MOST_LENGTHS + 1).collect()}
    if len(counts) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    tasks = 2 * spark.sparkContext.defaultParallelism
    size = {n: min(max(LEAST_ROWS, -(-c // tasks)), max(1, SLOT_CELLS // n)) for n, c in counts.items()}  # rows of a slot
    first, slots = {}, 0
    for n, c in sorted(counts.items()):
        first[n] = slots
        slots += -(-c // size[n])
    of_length = spark.createDataFrame([(n, first[n], -(-c // size[n])) for n, c in counts.items()], "n int, first int, slots int")
    index = packed(rows, lambda n: min(BLOCK_ROWS, size[n]), pack_index).join(F.broadcast(of_length), "n").select((F.col("first") + F.col("at") % F.col("slots")).cast("int").alias("slot"), F.lit(0).alias("kind"), "block")
    queries = packed(asking, lambda n: min(QUERY_ROWS, max(1, SLOT_CELLS // n)), pack_query).join(F.broadcast(of_length), "n")
    queries = queries.select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("slots") - 1)).alias("slot"), F.lit(1).alias("kind"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, blocks = None, []
        for batch in batches:
            for own, role, block in zip(*batch.columns, strict=True):
                if own.as_py() != slot:
                    slot, blocks = own.as_py(), []
                if role.as_py() == 0:  # a slot's index blocks come first
                    blocks.append(pickle.loads(block.as_py()))
                    continue
                query = pickle.loads(block.as_py())
                found = [search(b, query) for b in blocks]
                if found:
                    q, v, s = (np.concatenate(c) for c in zip(*found, strict=True))
                    yield pa.record_batch([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64() if kind == "bigint" else pa.float64())], names=["query_id", "vec_id", "score"])

    dealt = index.unionByName(queries).repartitionById(max(slots, 1), F.col("slot")).sortWithinPartitions("slot", "kind")
    found = dealt.mapInArrow(run, f"query_id bigint, vec_id bigint, score {kind}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_all(vectors: DataFrame, key: str, column: str, every: int, k: int, pack_index: Callable, pack_query: Callable, search: Callable, kind: str, nonzero: bool = False) -> DataFrame:
    rows = usable(vectors, key, column, nonzero)
    return searched(rows, rows.where(F.col("id") % every == 0), k, pack_index, pack_query, search, kind)
