"""Vectors of list columns as numpy matrices, and stated query sets in broadcast blocks of checked size."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.llm.common import fresh_path

#: Rows and bytes of a block of queries that is broadcast.
BLOCK_ROWS, BLOCK_BYTES = 1024, 8 << 20


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of doubles) for each length of the list column's vectors; those null, empty or with null or non-finite components are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    values = np.asarray(column.values.to_numpy(zero_copy_only=False), np.float64)  # nulls become nan
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        part = values[offsets[rows][:, None] + np.arange(n)]
        good = np.isfinite(part).all(axis=1)
        if good.any():
            yield rows[good], part[good]


def in_blocks(queries: DataFrame, ident: str, most: int, name: str) -> tuple[DataFrame, int]:
    """queries (one row an id) written in blocks by a hash of the id, half full on average, and the number of blocks."""
    spark = queries.sparkSession
    path = fresh_path(spark, name + "_rows")
    queries.write.parquet(path)
    whole = spark.read.schema(queries.schema).parquet(path)
    blocks = max(1, -(-2 * whole.count() // most)) if whole.count() > most else 1
    path = fresh_path(spark, name)
    whole.withColumn("block", F.pmod(F.xxhash64(ident), F.lit(blocks)).cast("int")).repartition("block").write.partitionBy("block").parquet(path)
    return spark.read.schema(whole.withColumn("block", F.lit(0)).schema).parquet(path), blocks


def rows_of_block(blocked: DataFrame, block: int, most: int) -> list:
    """The rows of one block, whose bound is checked before they are broadcast."""
    rows = blocked.where(F.col("block") == block).drop("block").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} queries in block {block}: more blocks are needed")
    return rows


def rows_at_once(bytes_a_row: int) -> int:
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, bytes_a_row)))


def each_block(blocks: int, solve: Callable[[int], DataFrame | None], schema: str, like: DataFrame, name: str) -> DataFrame:
    """The rows that solve gives for every block, written one block at a time, so that plans do not grow with their number."""
    spark = like.sparkSession
    path = fresh_path(spark, name)
    spark.createDataFrame([], schema).write.parquet(path)
    for block in range(blocks):
        if (found := solve(block)) is not None:
            found.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def best_first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k rows of each group, by higher score, ties by the smaller id."""
    order = np.lexsort((ids, -score, group))
    at = group[order]
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    rank = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
    return order[rank < k]


def binomial_floor(n: int, p: float, sure: float) -> int:
    """The largest l for which a binomial count of n trials reaches l with probability `sure` at least."""
    below, l = 0.0, 0
    while l < n:
        below += math.comb(n, l) * p**l * (1 - p) ** (n - l)
        if 1 - below < sure:
            break
        l += 1
    return l
