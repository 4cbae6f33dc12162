"""Exact vector search, best-per-group and top-k operators."""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_QUERY_ROWS, ROWS_AT_ONCE = 1000, 2048
# small helpers travel with the tasks, so that workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def search_width(top_k: int, n: int) -> int:
    """How many neighbours to fetch for a final top_k."""
    return min(max(5 * top_k, top_k, 20), n)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties by the smaller id."""
    at = np.arange(len(score))
    if len(score) > k:  # everything that ties with the k-th best stays until ids decide
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((ids[at], -score[at]))][:k]


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, q_id: str, q_vec: str, c_id: str, c_vec: str, per_query_limit: int = MAX_QUERY_ROWS) -> DataFrame:
    """Exact inner-product top-k: every stated query against all rows.

    The query side is a stated set of at most per_query_limit rows (checked), so it goes to every task as
    one matrix. A task multiplies its rows block by block and keeps the k best of each query, so that no more than k rows
    a query and task are shuffled. Scores count to ten decimals, so that equal vectors tie; ties go to the smaller corpus id. Ids are longs.
    """
    rows = queries.where(F.col(q_vec).isNotNull()).select(q_id, q_vec).limit(per_query_limit + 1).collect()
    if len(rows) > per_query_limit:
        raise ValueError(f"more than {per_query_limit} query rows; search in blocks of {per_query_limit}")
    asked = np.array([r[0] for r in rows], np.int64)
    matrix = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)
    shared = queries.sparkSession.sparkContext.broadcast((asked, matrix))
    schema = pa.schema([("query_id", pa.int64()), ("match_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        asked, matrix = shared.value
        kept, kept_ids = np.zeros((len(asked), 0)), np.zeros((len(asked), 0), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(i, ROWS_AT_ONCE)
                ids, vectors = part.column(0).to_numpy(), part.column(1)
                block = vectors.flatten().to_numpy().astype(np.float64).reshape(len(ids), -1)
                score = np.round(matrix @ block.T, 10)
                score, every = np.concatenate([kept, score], axis=1), np.concatenate([kept_ids, np.broadcast_to(ids, score.shape)], axis=1)
                order = np.stack([_best(score[j], every[j], k) for j in range(len(asked))])
                kept, kept_ids = np.take_along_axis(score, order, 1), np.take_along_axis(every, order, 1)
        width = kept.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, width)), pa.array(kept_ids.reshape(-1)), pa.array(kept.reshape(-1))], schema=schema)

    found = corpus.where(F.col(c_vec).isNotNull()).select(F.col(c_id).cast("long"), c_vec)
    scored = found.mapInArrow(run, "query_id long, match_id long, score double") if rows else queries.sparkSession.createDataFrame([], "query_id long, match_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "match_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_topk_blocks(queries: DataFrame, corpus: DataFrame, k: int, q_id: str, q_vec: str, c_id: str, c_vec: str, block_rows: int = MAX_QUERY_ROWS) -> DataFrame:
    """vector_topk for any number of distinct query ids: blocks by hash, half full on average.

    Each block's bound is checked by vector_topk when it is broadcast.
    """
    blocks = max(1, -(-2 * queries.count() // block_rows))
    block = F.pmod(F.xxhash64(q_id), F.lit(blocks))
    parts = [vector_topk(queries.where(block == b), corpus, k, q_id, q_vec, c_id, c_vec, block_rows) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def best_per_group(rows: DataFrame, group: Column, order: list[Column], size_name: str = "group_size") -> DataFrame:
    """The first row of each group by order, with the group's size."""
    w = Window.partitionBy(group)
    ranked = rows.withColumn("_rn", F.row_number().over(w.orderBy(*order))).withColumn(size_name, F.count(F.lit(1)).over(w))
    return ranked.where("_rn = 1").drop("_rn")


def top(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    return rows.orderBy(*order).limit(k)
