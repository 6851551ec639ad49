"""Graphs as edge tables: components by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetflow.operators.skew import met, parts_of
from facetflow.session import cut


SMALL = 1_000_000  # edges up to which all of a node's may meet in one task
TASK = 200_000  # edges up to which one task finds all components


def _stars(edges: DataFrame, large: bool, count: int) -> DataFrame:
    """One step on `count` edges (u, v), u > v. Large: each node's greater neighbours move to its least neighbour (or itself). Small: a node and its lesser neighbours move to the least of them."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    if count <= SMALL:  # no node has more edges than that
        joined = both.join(least, "u")
    else:
        least = cut(least)
        joined = met(both, least.select("u", "m"), parts_of(least, "u", "degree", 10_000), "u", "v")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    else:
        moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def roots(parent: np.ndarray) -> np.ndarray:
    """The root of each node, by doubling the steps."""
    while True:
        above = parent[parent]
        if (above == parent).all():
            return parent
        parent = above


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of nodes 0 to n - 1 the least that edges a - b reach: roots are hung below the least root that an edge leads to, until none can be."""
    parent = np.arange(n)
    while True:
        x, y = parent[a], parent[b]
        open_ = x != y
        if not open_.any():
            return parent
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        parent = roots(parent)


def _in_one_task(edges: DataFrame) -> DataFrame:
    """Components of few edges (u, v), which are read by one task."""
    kind = edges.schema["u"].dataType.simpleString()

    def order(value) -> tuple:
        """Sorts as Spark does: null first, structs by their fields."""
        return tuple((v is not None, order(v) if isinstance(v, dict) else v) for v in (value.values() if isinstance(value, dict) else [value]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if whole:
            both = pa.concat_arrays([pa.concat_arrays([b.column(i) for b in whole]) for i in (0, 1)])
            if pa.types.is_integer(both.type):
                names, at = np.unique(both.to_numpy(zero_copy_only=False), return_inverse=True)
                found = pa.array(names, both.type)
            else:
                own: dict = {}
                values = [order(v) for v in both.to_pylist()]
                first = {v: i for i, v in reversed(list(enumerate(values)))}
                for i, v in enumerate(sorted(first)):
                    own[v] = i
                at, found = np.array([own[v] for v in values]), both.take(pa.array([first[v] for v in sorted(first)]))
            least = least_reached(at[: len(at) // 2], at[len(at) // 2 :], len(found))
            yield pa.record_batch([found, found.take(pa.array(least))], names=["node", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 100) -> DataFrame:
    """(node, component) of every node that has an edge to another; component is the least node that can be reached.

    Edges are undirected; repeated edges, loops and edges with null ends count for nothing. Alternates large and
    small stars (rounds grow with the square of the logarithm of the size), cutting the lineage each round with a checkpoint;
    RuntimeError if `rounds` of them don't end it. Up to TASK edges are read by one task instead, if `rounds` allows for any such graph.
    """
    now = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)) & F.lit(True)).toDF("u", "v", "ok").where("ok").drop("ok").distinct()
    now = cut(now)
    # a forest of stars with unchanged edges stays so; an order-free digest of the edges tells
    count = now.count()
    if count <= TASK and rounds >= TASK.bit_length():  # as many as any such graph may need
        return _in_one_task(now)
    digest = lambda edges: tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    state = digest(now)
    for _ in range(rounds):
        before = state
        near = _stars(now, True, before[0])
        now = cut(_stars(near if before[0] <= SMALL else cut(near), False, before[0]))
        state = digest(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
