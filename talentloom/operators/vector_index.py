"""A stored, exact vector index: rows in cells around centroids, with the id map checked when it is loaded.

The best product of a query with any member of a cell is at most its product with the centroid plus the query's length times the
cell's radius (Cauchy and Schwarz). A search first reads the cells of the highest such products that hold k rows, which gives every query its k-th best score, and
then only the cells whose bound reaches that: results equal a scan of all rows. Cells are folders, so cells that no query needs are not read.

Centroids come from a bounded sample (``SAMPLE`` rows by a hash of the id); every row is indexed. A load fails where counts, ids or
dimensions of the parts disagree.
"""

from __future__ import annotations

import json
import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentloom.sources.io import fresh_path

# small helpers travel with the tasks, so that workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
SAMPLE, MAX_CELLS, ROUNDS = 4096, 512, 6
#: Rows of a cell that one task writes: a cell of many copies is split.
ROWS_A_FILE = 1 << 18
MAX_QUERY_ROWS = 1024
HIT_SCHEMA = "query_id long, match_id long, score double"


def centroids_of(sample: np.ndarray, cells: int) -> np.ndarray:
    """Lloyd's rounds from evenly spread rows of the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(ROUNDS):
        near = nearest_cell(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def nearest_cell(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * x @ centres.T, axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def build(vectors: DataFrame, path: str, ident: str, vector: str) -> dict:
    """Write the index of vectors (distinct long ids, lists of one length without nulls) to path; rows without id or vector are left out and counted."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    usable = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull())
    told = usable.agg(F.count("*").alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("dims"), F.count_if(F.exists("v", lambda x: x.isNull() | F.isnan(x))).alias("broken")).first()
    if told["n"] and (told["low"] != told["dims"] or told["dims"] == 0 or told["broken"]):
        raise ValueError("vectors of one length without missing components are needed")
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    cells = max(1, min(MAX_CELLS, math.isqrt(told["n"]), len(sample)))
    centres = centroids_of(np.array([r["v"] for r in sample]), cells) if sample else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        centres = shared.value
        for batch in batches:
            x = _matrix(batch.column("v"))
            cell = nearest_cell(x, centres)
            far = np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far), pa.array(cell.astype(np.int32))], names=["id", "v", "far", "cell"])

    schema = "id long, v array<double>, far double, cell int"
    placed = usable.mapInArrow(assign, schema) if sample else spark.createDataFrame([], schema)
    pieces = max(1, -(-told["n"] // ROWS_A_FILE))
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(pieces))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    back = spark.read.schema(schema).parquet(f"{path}/vectors") if sample else placed
    radius = {r["cell"]: (r["r"], r["n"]) for r in back.groupBy("cell").agg(F.max("far").alias("r"), F.count("*").alias("n")).collect()}  # one row a cell
    table = [(i, c.tolist(), *radius.get(i, (0.0, 0))) for i, c in enumerate(centres)]
    spark.createDataFrame(table, "cell int, centroid array<double>, radius double, n long").write.mode("overwrite").parquet(f"{path}/cells")
    back.select("id").write.mode("overwrite").parquet(f"{path}/ids")
    meta = {"rows": told["n"], "dims": told["dims"] or 0, "cells": len(centres), "left_out": rows.count() - told["n"]}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return meta


class VectorIndex:
    """A loaded index; search it as often as needed."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        cells = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])
        self.centres, self.radius, self.size = (np.array([r[x] for r in cells]) for x in ("centroid", "radius", "n"))
        schema = "id long, v array<double>, far double, cell int"
        self.rows = spark.read.schema(schema).parquet(f"{path}/vectors") if self.meta["rows"] else spark.createDataFrame([], schema)
        ids = spark.read.parquet(f"{path}/ids")
        total = lambda df: df.agg(F.count("*").alias("n"), F.count_distinct("id").alias("distinct"), F.bit_xor(F.xxhash64("id")).alias("sign")).first()
        stored, mapped = total(self.rows), total(ids)
        if tuple(stored) != tuple(mapped) or stored["n"] != self.meta["rows"] or int(self.size.sum()) != self.meta["rows"]:
            raise ValueError("the index and its id map do not belong together")
        if stored["distinct"] != stored["n"]:
            raise ValueError("ids of an index must be distinct")
        if self.meta["rows"] and (wrong := self.rows.where(F.size("v") != self.meta["dims"]).count() or self.centres.shape[1] != self.meta["dims"]):
            raise ValueError(f"{wrong} vectors of another dimension than the index")

    def _scan(self, ids: np.ndarray, asked: np.ndarray, wanted: np.ndarray, k: int) -> DataFrame:
        """The k best of each task for the (query, cell) pairs wanted."""
        cells = np.flatnonzero(wanted.any(axis=0)).tolist()
        shared = self.spark.sparkContext.broadcast((ids, asked, wanted))

        def run(batches):
            ids, asked, wanted = shared.value
            kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            for batch in batches:
                x, own, cell = _matrix(batch.column("v")), batch.column("id").to_numpy(), batch.column("cell").to_numpy()
                for c in np.unique(cell).tolist():
                    at, queries = np.flatnonzero(cell == c), np.flatnonzero(wanted[:, c])
                    score = np.round(asked[queries] @ x[at].T, 10)
                    new = [np.repeat(queries, len(at)), np.tile(own[at], len(queries)), score.reshape(-1)]
                    kept = [np.concatenate(p) for p in zip(kept, new, strict=True)]
                    order = np.lexsort((kept[1], -kept[2], kept[0]))
                    group = kept[0][order]
                    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                    rank = np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)]))
                    kept = [p[order[rank < k]] for p in kept]
            yield pa.RecordBatch.from_arrays([pa.array(ids[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], names=["query_id", "match_id", "score"])

        return self.rows.where(F.col("cell").isin(cells)).select("id", "v", "cell").mapInArrow(run, HIT_SCHEMA)

    def search(self, queries: DataFrame, ident: str, vector: str, k: int) -> tuple[DataFrame, dict]:
        """((query_id, match_id, score, rank), counts of pairs of queries and cells and of those read): inner product, ties by the smaller id.

        Queries (distinct ids) go in blocks of at most MAX_QUERY_ROWS, checked.
        """
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "match_id")
        first_k = lambda df: df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        asked = queries.where(F.col(ident).isNotNull() & F.col(vector).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        if asked.where(F.size("v") != self.meta["dims"]).limit(1).count() and self.meta["rows"]:
            raise ValueError("a query has another dimension than the index")
        n = asked.count()
        blocks = max(1, -(-2 * n // MAX_QUERY_ROWS)) if n > MAX_QUERY_ROWS else 1
        path, counts = fresh_path(self.spark, "index_hits"), {"queries": n, "cells": len(self.centres), "pairs": n * len(self.centres), "read": 0}
        schema = HIT_SCHEMA + ", rank int"
        self.spark.createDataFrame([], schema).write.parquet(path)
        for block in range(blocks if self.meta["rows"] and n else 0):
            rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).limit(MAX_QUERY_ROWS + 1).collect()
            if len(rows) > MAX_QUERY_ROWS:
                raise ValueError(f"more than {MAX_QUERY_ROWS} queries in a block")
            if not rows:
                continue
            ids, q = np.array([r["id"] for r in rows], np.int64), np.array([r["v"] for r in rows])
            bound = q @ self.centres.T + np.sqrt((q * q).sum(axis=1))[:, None] * self.radius + 1e-9
            bound[:, self.size == 0] = -np.inf
            order = np.argsort(-bound, axis=1)
            held = np.cumsum(self.size[order], axis=1)
            ahead = np.empty_like(bound, dtype=bool)
            np.put_along_axis(ahead, order, held - self.size[order] < k, axis=1)  # best cells until they hold k rows
            ahead &= self.size > 0
            near = fresh_path(self.spark, "index_near")
            first_k(self._scan(ids, q, ahead, k)).write.parquet(near)
            found = self.spark.read.schema(schema).parquet(near)
            floor = {r["query_id"]: r["s"] for r in found.where(F.col("rank") == k).select("query_id", F.col("score").alias("s")).collect()}  # one row a query of the block
            least = np.array([floor.get(i, -np.inf) for i in ids.tolist()])
            more = (bound >= least[:, None]) & ~ahead & (self.size > 0)
            counts["read"] += int(ahead.sum() + more.sum())
            both = found.drop("rank")
            if more.any():
                both = both.unionByName(self._scan(ids, q, more, k))
            first_k(both).write.mode("append").parquet(path)
        return self.spark.read.schema(schema).parquet(path), counts
