"""Hard-negative mining (operator 12) with bit-sliced integer products.

Vectors become integers, floor(``SCALE`` * x). A product with an anchor is built from the candidates' component bit-planes, most significant first
(two's complement: the sign plane counts negatively). After the planes down to 2^p, what is missing of a score lies between (2^p - 1) times
the sum of the anchor's negative components and (2^p - 1) times that of its positive ones, so every score has an interval that
tightens with each plane. A candidate is dropped once its interval cannot qualify: below the k-th best that is sure, or outside
all bands asked for. First planes are one matrix product for all pairs of a tile; when few pairs are left, the others go pair by pair. The last
plane leaves intervals of length zero: scores are exact.

Two passes over the rows: positives of each anchor (the first of its label), then negatives in the band that each positive
opens. Anchors are a stated set; they go to the tasks in blocks of checked size, tasks return the best few of each, and windows merge these.

Defined cases: rows with a null id, a null label, a null or empty vector, or any null or non-finite component take no part; vectors of
another length than the anchor's are no candidates; repeated candidates count as rows each; a repeated anchor id asks
once, with its least label and vector; rows of the anchor's own id are never its positives; a positive score
below zero has an empty band; components or lengths whose products could leave 64 bits are an error; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentloom.llm.common import materialize, table
from talentloom.llm.vectors import best_first, each_block, in_blocks, matrices, rows_at_once, rows_of_block

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Negatives lie between 30 and 90 per cent of the positive's score.
LOW_PER_CENT, HIGH_PER_CENT = 30, 90
TILE_ROWS, TILE_ANCHORS = 2048, 128
#: Share of a tile's pairs under which planes go pair by pair.
FEW = 1 / 32
ROWS_SCHEMA = "vec_id long, label long, bits int, q array<long>"
FOUND_SCHEMA = "anchor_id long, slot int, vec_id long, score long"
NEVER = -(2**62)


def integer_vectors(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Rows that take part, as (vec_id, label, bits: of the widest component in two's complement, q)."""

    def run(batches):
        for batch in batches:
            for at, part in matrices(batch.column("v")):
                q = np.floor(SCALE * part)
                if np.abs(q).max() >= 2.0**30:
                    raise ValueError("components of 2^22 and more are too large for 64-bit products")
                q = q.astype(np.int64)
                top = np.maximum(q, -q - 1).max(axis=1)
                bits = np.ceil(np.log2(top + 1.0)).astype(np.int32) + 1
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, q.size + 1, q.shape[1], dtype=np.int32)), pa.array(q.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("i").take(pa.array(at)), batch.column("l").take(pa.array(at)), pa.array(bits), lists], names=["vec_id", "label", "bits", "q"])

    some = rows.select(F.col(ident).cast("long").alias("i"), F.col(label).cast("long").alias("l"), F.col(vector).alias("v")).where("i is not null and l is not null and v is not null")
    return some.mapInArrow(run, ROWS_SCHEMA)


class Slices:
    """Candidates of one tile as bit-planes against a block of anchors."""

    def __init__(self, anchors: np.ndarray, planes: int) -> None:
        exact = np.float32 if anchors.shape[1] << (planes - 1) < 1 << 24 else np.float64
        self.a, self.planes = anchors.astype(exact), planes
        self.up, self.down = np.maximum(anchors, 0).sum(axis=1), np.minimum(anchors, 0).sum(axis=1)

    def survivors(self, tile: np.ndarray, alive: np.ndarray, low: np.ndarray, high: np.ndarray, sure: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, exact score) of the pairs that may qualify.

        alive: pairs allowed. low, high: (anchors, bands), ends included. sure: the k-th best score that each band has for certain
        (NEVER: not yet); it rises here with the planes.
        """
        total = np.zeros(alive.shape, np.int64)
        pairs = None
        for p in range(self.planes - 1, -1, -1):
            plane, weight, slack = tile >> p & 1, -(1 << p) if p == self.planes - 1 else 1 << p, (1 << p) - 1
            if pairs is None:
                total += (self.a @ plane.T.astype(self.a.dtype)).astype(np.int64) * weight
                most, least = total + slack * self.up[:, None], total + slack * self.down[:, None]
                for band in range(low.shape[1]):
                    self._raise(alive, least, most, low[:, band], high[:, band], sure[:, band], k)
                floor, ceiling = np.maximum(low, sure).min(axis=1), high.max(axis=1)
                alive &= (most >= floor[:, None]) & (least <= ceiling[:, None])
                if p and np.count_nonzero(alive) <= FEW * alive.size:
                    pairs = np.nonzero(alive)
                    score = total[pairs]
            else:
                i, j = pairs
                score = score + (self.a[i] * plane[j]).sum(axis=1, dtype=np.float64).astype(np.int64) * weight
                stay = (score + slack * self.up[i] >= floor[i]) & (score + slack * self.down[i] <= ceiling[i])
                pairs, score = (i[stay], j[stay]), score[stay]
        if pairs is None:
            pairs = np.nonzero(alive)
            score = total[pairs]
        return *pairs, score

    @staticmethod
    def _raise(alive, least, most, low, high, sure, k) -> None:
        """The k-th best lower end among candidates whose whole interval lies in the band."""
        if least.shape[1] < k:
            return
        wide = np.flatnonzero((most[:, 0] - least[:, 0] <= high - low) & (sure == NEVER))  # bands that an interval fits into
        if not len(wide):
            return
        inside = alive[wide] & (least[wide] >= low[wide, None]) & (most[wide] <= high[wide, None])
        ends = np.where(inside, least[wide], NEVER)
        kth = np.partition(ends, ends.shape[1] - k, axis=1)[:, ends.shape[1] - k]
        sure[wide] = np.maximum(sure[wide], kth)


def mine(rows: DataFrame, block: dict, planes: int, k: int, same_label: bool) -> DataFrame:
    """Of each anchor and band the k best rows of each task. block: ids, labels, q, low, high (anchors, bands)."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        block = shared.value
        ids, labels, low, high = (block[x] for x in ("ids", "labels", "low", "high"))
        bands, slices = low.shape[1], {i: Slices(block["q"][i : i + TILE_ANCHORS], planes) for i in range(0, len(ids), TILE_ANCHORS)}
        sure = np.full(low.shape, NEVER)
        kept = [np.zeros(0, np.int64)] * 3  # anchor * bands + band, row id, score
        for batch in batches:
            for at, matrix in matrices(batch.column("q")):
                if matrix.shape[1] != block["q"].shape[1]:
                    continue
                tile, own, kind = matrix.astype(np.int64), batch.column("vec_id").to_numpy()[at], batch.column("label").to_numpy()[at]
                for j in range(0, len(tile), TILE_ROWS):
                    part, part_ids, part_kind = tile[j : j + TILE_ROWS], own[j : j + TILE_ROWS], kind[j : j + TILE_ROWS]
                    fresh = [kept]
                    for i, sliced in slices.items():
                        to = i + len(sliced.a)
                        alike = labels[i:to, None] == part_kind
                        alive = alike & (ids[i:to, None] != part_ids) if same_label else ~alike
                        a, r, s = sliced.survivors(part, alive, low[i:to], high[i:to], sure[i:to].copy(), k)
                        for band in range(bands):
                            fit = (s >= np.maximum(low[a + i, band], sure[a + i, band])) & (s <= high[a + i, band])
                            fresh.append([(a[fit] + i) * bands + band, part_ids[r[fit]], s[fit]])
                    group, found, score = (np.concatenate(x) for x in zip(*fresh, strict=True))
                    best = best_first(group, score, found, k)
                    kept = [group[best], found[best], score[best]]
                    full = np.flatnonzero(np.bincount(kept[0], minlength=sure.size) == k)
                    last = np.searchsorted(kept[0], full, side="right") - 1
                    sure.reshape(-1)[full] = kept[2][last]
        yield pa.RecordBatch.from_arrays([pa.array(ids[kept[0] // bands]), pa.array((kept[0] % bands).astype(np.int32)), pa.array(kept[1]), pa.array(kept[2])], names=["anchor_id", "slot", "vec_id", "score"])

    return rows.mapInArrow(run, FOUND_SCHEMA)


def first_k(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). rows and anchors: as integer_vectors gives them, labels as they shall count; rows written."""
    asked = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("_x")).select("vec_id", "_x.label", "_x.q")
    width = rows.agg(F.max("bits").alias("bits"), F.max(F.size("q")).alias("n")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if width["bits"] is None:
        return rows.sparkSession.createDataFrame([], schema)
    planes = int(width["bits"])
    if width["n"] << (2 * planes - 2) >= 1 << 61:
        raise ValueError("products of these vectors could leave 64 bits")
    most = rows_at_once(8 * width["n"])
    blocked, blocks = in_blocks(asked.withColumn("dims", F.size("q")), "vec_id", most, "anchors")

    def solve(block: int) -> DataFrame | None:
        out = None
        every = rows_of_block(blocked, block, most)
        for n in sorted({r["dims"] for r in every}):
            some = sorted((r for r in every if r["dims"] == n), key=lambda r: r["vec_id"])
            shape = {"ids": np.array([r["vec_id"] for r in some], np.int64), "labels": np.array([r["label"] for r in some], np.int64), "q": np.array([r["q"] for r in some], np.int64)}
            open_ends = {"low": np.full((len(some), 1), NEVER + 1), "high": np.full((len(some), 1), -NEVER)}
            near = materialize(first_k(mine(rows, shape | open_ends, planes, positives, True), positives), "positives")
            low, high = np.full((len(some), positives), -NEVER), np.full((len(some), positives), NEVER + 1)
            place = {r["vec_id"]: i for i, r in enumerate(some)}
            for r in near.collect():  # at most `positives` rows an anchor of this block
                low[place[r["anchor_id"]], r["rank"] - 1] = -(-LOW_PER_CENT * r["score"] // 100)
                high[place[r["anchor_id"]], r["rank"] - 1] = HIGH_PER_CENT * r["score"] // 100
            given = near.select(F.col("anchor_id").alias("_a"), (F.col("rank") - 1).alias("_slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
            found = first_k(mine(rows, shape | {"low": low, "high": high}, planes, negatives, False), negatives)
            told = found.join(given, (F.col("anchor_id") == F.col("_a")) & (F.col("slot") == F.col("_slot")))
            told = told.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            out = told if out is None else out.unionByName(told)
        return out

    return each_block(blocks, solve, schema, rows, "hard_negatives")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 12: hard negatives of every id divisible by 100 against all rows; ids divisible by 7 wear the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    rows = materialize(integer_vectors(rows), "integer_vectors")
    return hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0))


OP12_SQL = """
WITH rows AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
asked AS (SELECT vec_id AS id, min(label) AS label FROM rows WHERE vec_id % 100 = 0 GROUP BY vec_id),
anchors AS (SELECT a.id, a.label, min(q) AS q FROM asked a JOIN rows r ON r.vec_id = a.id AND r.label = a.label GROUP BY ALL),
scores AS (SELECT a.id, r.vec_id, r.label = a.label AS alike, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
    FROM anchors a JOIN rows r ON len(r.q) = len(a.q)),
positives AS (SELECT id, vec_id, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id) AS slot FROM scores WHERE alike AND vec_id <> id),
negatives AS (SELECT p.id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.id, p.slot ORDER BY n.score DESC, n.vec_id) AS rank
    FROM positives p JOIN scores n ON n.id = p.id AND NOT n.alike AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score WHERE p.slot <= 5)
SELECT id AS anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""
