"""Small helpers that several operators of this folder use."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.session import shared_dir

U64 = np.uint64


def fold(key: str, k: int) -> Column:
    """crc32 of the key's decimal text modulo k; a null key falls in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(k), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posix_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder name under the shared folder as a plain path, for files that workers memory-map.

    The shared folder must be mounted on every machine (a file: path); others raise ValueError.
    """
    url = urlparse(shared_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder; spark.checkpoint.dir is {url.scheme}:")
    return f"{url.path}/{what}-{uuid.uuid4().hex}"


def chunks(texts: list[str | None], limit: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """(start, texts) of consecutive texts of about `limit` characters together; whole texts, null as empty."""
    start, size, out = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if out and size + len(t) > limit:
            yield start, out
            start, size, out = i, 0, []
        out.append(t)
        size += len(t)
    if out:
        yield start, out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them evenly (the splitmix finaliser)."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x
