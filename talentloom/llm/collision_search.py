"""Approximate nearest neighbours (operator 13) by collision-counting hashing.

Each of ``HASHES`` hash functions is a single Gaussian projection, kept as a sorted array. A query opens a window of half-width
``HALF`` * R around its own projection in every array; a vector that lies in the window collides. Virtual rehashing widens R and
only reads what the wider windows add. A vector within distance R collides in each array with the probability that a normal
deviate is below HALF, so its collisions are binomial, and a vector is verified (exact Euclidean distance, in double precision) as soon as it reaches the count
that such a vector reaches with probability ``SURE``. A query ends when its k-th best verified distance is no more than R: then every
nearer vector had that probability to be verified. Later shards of a task start at the k-th best distance found so far.

The index is a table of shards: every row is indexed, in shards of at most ``SHARD_ROWS`` rows, each with the sorted arrays of its distinct
vectors, so that counts and arrays of a vector lie together and a search moves only the best k of each query and task. Copies share one entry and list their
ids in order. Queries go to the shards in blocks of checked size.

Defined cases: rows with a null id, and vectors null, empty, zero or holding null or non-finite components, take no part; rows of the query's own id are never its
neighbours; vectors of another length than the query's are no candidates; repeated rows of other ids count as rows each; a repeated query id asks once, with its least
vector; ties go to the smaller id; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentloom.llm.common import materialize, table
from talentloom.llm.vectors import binomial_floor, each_block, in_blocks, matrices, rows_at_once, rows_of_block

HASHES, HALF, GROW, SURE, SEED = 48, 1.2, 1.25, 0.98, 20
SHARD_ROWS = 4096
NEIGHBOURS = 10
#: Queries that are answered together in a shard, so that their counts stay small.
QUERIES_AT_ONCE = 256
NO_ID = 2**63 - 1
INDEX_SCHEMA = "dims int, members int, ids binary, starts binary, vectors binary, values binary, places binary"
HIT_SCHEMA = "query_id long, vec_id long, score double"


def projections(dims: int, hashes: int = HASHES) -> np.ndarray:
    return np.random.default_rng([SEED, dims]).standard_normal((dims, hashes))


def threshold(hashes: int = HASHES) -> int:
    """Collisions that a vector within R reaches with probability SURE."""
    return binomial_floor(hashes, math.erf(HALF / math.sqrt(2)), SURE)


def _project(vectors: np.ndarray, hashes: int) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(vectors @ projections(vectors.shape[1], hashes))


class Shard:
    """Sorted arrays over the distinct vectors of some rows."""

    def __init__(self, ids, starts, vectors, values, places) -> None:
        self.ids, self.starts, self.vectors, self.values, self.places = ids, starts, vectors, values, places

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, hashes: int) -> Shard:
        distinct, which = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, which.reshape(-1)))
        starts = np.searchsorted(which.reshape(-1)[order], np.arange(len(distinct) + 1))
        values = _project(distinct, hashes).T
        places = np.argsort(values, axis=1, kind="stable")
        return cls(ids[order], starts, distinct, np.take_along_axis(values, places, 1), places)

    def payload(self) -> dict:
        cols = {"ids": self.ids.astype(np.int64), "starts": self.starts.astype(np.int32), "vectors": self.vectors.astype(np.float64), "values": self.values, "places": self.places.astype(np.uint16)}
        return {"dims": self.vectors.shape[1], "members": len(self.ids)} | {k: np.ascontiguousarray(v).tobytes() for k, v in cols.items()}

    @classmethod
    def load(cls, row: dict) -> Shard:
        ids, starts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["starts"], np.int32)
        vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dims"])
        values = np.frombuffer(row["values"], np.float64).reshape(-1, len(vectors))
        return cls(ids, starts, vectors, values, np.frombuffer(row["places"], np.uint16).reshape(values.shape))

    def unit(self) -> float:
        """A radius whose windows hold about a twentieth of the entries: where a search starts that knows no distance yet."""
        n = self.values.shape[1]
        spread = self.values[:, min(n - 1, -(-n * 21 // 40))] - self.values[:, n * 19 // 40]
        return float(np.mean(spread)) / 2 / HALF or float(np.abs(self.values).max()) / 16 or 1.0

    def search(self, asked: np.ndarray, asked_ids: np.ndarray, best: np.ndarray, best_ids: np.ndarray, need: int) -> None:
        """Improve best (queries, k: distances, ascending) and best_ids in place."""
        n, hashes, k = len(self.vectors), len(self.values), best.shape[1]
        centre = _project(asked, hashes)
        radius = np.where(np.isfinite(best[:, -1]), best[:, -1], self.unit())
        counts, checked = np.zeros((len(asked), n), np.uint8), np.zeros((len(asked), n), bool)
        low = np.stack([np.searchsorted(v, centre[:, j]) for j, v in enumerate(self.values)], axis=1)
        high, going = low.copy(), np.arange(len(asked))
        while len(going):
            reach = HALF * radius[going]
            new_low = np.stack([np.searchsorted(v, centre[going, j] - reach) for j, v in enumerate(self.values)], axis=1)
            new_high = np.stack([np.searchsorted(v, centre[going, j] + reach, side="right") for j, v in enumerate(self.values)], axis=1)
            new_low, new_high = np.minimum(new_low, low[going]), np.maximum(new_high, high[going])
            for at, q in enumerate(going.tolist()):
                count = counts[q]
                for places, a, b, c, d in zip(self.places, new_low[at].tolist(), low[q].tolist(), high[q].tolist(), new_high[at].tolist(), strict=True):
                    if a < b:
                        count[places[a:b]] += 1
                    if c < d:
                        count[places[c:d]] += 1
                found = np.flatnonzero((count >= need) & ~checked[q])
                if len(found):
                    checked[q, found] = True
                    self._verify(found, asked[q], asked_ids[q], best[q], best_ids[q], k)
            low[going], high[going] = new_low, new_high
            whole = ((new_low == 0) & (new_high == n)).all(axis=1)
            going = going[~whole & (best[going, -1] > radius[going])]
            radius[going] = np.minimum(radius[going] * GROW, np.maximum(best[going, -1], np.nextafter(radius[going], np.inf)))

    def _verify(self, found, vector, own, best, best_ids, k) -> None:
        gap = self.vectors[found] - vector
        with np.errstate(over="ignore"):
            far = np.sqrt((gap * gap).sum(axis=1))
        near = far <= best[-1]
        found, far = found[near], far[near]
        # of copies only the k + 1 smallest ids can be among the k nearest, one of them being the query's own
        size = np.minimum(self.starts[found + 1] - self.starts[found], k + 1)
        at = np.repeat(self.starts[found], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        ids, far = self.ids[at], np.repeat(far, size)
        other = ids != own
        ids, far = np.concatenate([best_ids, ids[other]]), np.concatenate([best, far[other]])
        order = np.lexsort((ids, far))[:k]
        best[:], best_ids[:] = far[order], ids[order]


def build_index(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", hashes: int = HASHES) -> DataFrame:
    """A written table of shards over all rows that take part."""

    def run(batches):
        held: dict[int, list] = {}

        def emit(part):
            ids, vectors = (np.concatenate(x) for x in zip(*part, strict=True))
            for i in range(0, len(ids), SHARD_ROWS):
                row = Shard.build(ids[i : i + SHARD_ROWS], vectors[i : i + SHARD_ROWS], hashes).payload()
                yield pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, schema=_INDEX)

        for batch in batches:
            for at, part in matrices(batch.column("v")):
                some = (part != 0).any(axis=1)
                if some.any():
                    held.setdefault(part.shape[1], []).append((batch.column("i").to_numpy()[at[some]], part[some]))
            for dims in [d for d, x in held.items() if sum(len(i) for i, _ in x) >= SHARD_ROWS]:
                yield from emit(held.pop(dims))
        for part in held.values():
            yield from emit(part)

    _INDEX = pa.schema([("dims", pa.int32()), ("members", pa.int32()), *((x, pa.binary()) for x in ("ids", "starts", "vectors", "values", "places"))])
    some = rows.select(F.col(ident).cast("long").alias("i"), F.col(vector).alias("v")).where("i is not null and v is not null")
    return materialize(some.mapInArrow(run, INDEX_SCHEMA), "collision_index")


def nearest(index: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, ident: str = "vec_id", vector: str = "embedding", hashes: int = HASHES) -> DataFrame:
    """(query_id, rank, vec_id, score) of every row of queries: its k nearest found, ties by the smaller id."""
    asked = queries.where(F.col(ident).isNotNull() & F.col(vector).isNotNull()).groupBy(F.col(ident).cast("long").alias("query_id")).agg(F.min(vector).alias("v")).withColumn("n", F.size("v"))
    schema = "query_id long, rank int, vec_id long, score double"
    widest = index.agg(F.max("dims")).first()[0]
    if widest is None:
        return index.sparkSession.createDataFrame([], schema)
    most = rows_at_once(8 * (widest + hashes))
    blocked, blocks = in_blocks(asked.where(F.col("n") <= widest), "query_id", most, "queries")
    need = threshold(hashes)

    def solve(block: int) -> DataFrame | None:
        rows = rows_of_block(blocked, block, most)
        groups = {}
        for at, part in matrices(pa.array([r["v"] for r in rows], pa.list_(pa.float64()))):
            some = (part != 0).any(axis=1)
            groups[part.shape[1]] = (np.array([rows[i]["query_id"] for i in at[some]], np.int64), part[some])
        shared = index.sparkSession.sparkContext.broadcast(groups)

        def run(batches):
            groups = shared.value
            best = {d: (np.full((len(i), k), np.inf), np.full((len(i), k), NO_ID)) for d, (i, _) in groups.items()}
            for batch in batches:
                for at in range(batch.num_rows):
                    row = batch.slice(at, 1).to_pylist()[0]
                    if row["dims"] not in groups:
                        continue
                    shard, (ids, vectors), (far, near) = Shard.load(row), groups[row["dims"]], best[row["dims"]]
                    for i in range(0, len(ids), QUERIES_AT_ONCE):
                        part = slice(i, i + QUERIES_AT_ONCE)
                        shard.search(vectors[part], ids[part], far[part], near[part], need)
            for d, (far, near) in best.items():
                some = near != NO_ID
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(groups[d][0], some.sum(axis=1))), pa.array(near[some]), pa.array(far[some])], names=["query_id", "vec_id", "score"])

        w = Window.partitionBy("query_id").orderBy("score", "vec_id")
        found = index.mapInArrow(run, HIT_SCHEMA).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        return found.select("query_id", "rank", "vec_id", "score")

    return each_block(blocks, solve, schema, index, "neighbours")


def op13_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 13: the 10 nearest rows found of every id divisible by 100, over an index of all rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(build_index(rows), rows.where(F.col("vec_id") % 100 == 0))
