"""SimHash near-dedup (operator 4) with BK-trees over shards of the fingerprint space.

Fingerprints within ``RADIUS`` bits agree on at least ``same`` of the
``RADIUS + same`` bit fields, so for each choice of ``same`` fields the
fingerprints that agree on them form a shard, and every link lies inside a
shard. Each shard is a BK-tree: children hang under their parent by integer
Hamming distance, and a search follows only edges within the radius. The trees
of all shards of a task are built and searched together, level by level.

A shard of more than ``LARGE`` fingerprints is split again: its members agree on the shard's bits and differ in at most
``RADIUS`` others, so of ``RADIUS`` + 1 sets of the other bits they agree on one.

Shard trees are not broadcast: their total size grows with the corpus, so no
bound can be proven, and a broadcast would take all fingerprints through the driver. They meet their queries through one shuffle of
fingerprints (never texts). Equal fingerprints are merged before, and a shard
gives a spanning forest of its links, not its pairs.

Defined cases: null and empty texts have fingerprint zero and link like any
other; repeated rows share a class; of equal least ids there is one class; rows
with a null id take part, and a class of null ids only has a null id; extra
columns pass through; an empty table gives none.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentloom.llm.common import free_name, materialize, table
from talentloom.llm.components import connected_components

RADIUS, SHINGLE, SEED = 4, 4, 42
NO_ID = 2**63 - 1
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
FRONTIER = 1 << 20
#: Fingerprints of a shard beyond which it is split, up to SPLITS times.
LARGE, SPLITS = 1 << 15, 3
BROADCAST_SHARDS = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of one text."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, column: str = "text", keep_text: bool = False, name: str = "_fp") -> DataFrame:
    """docs (without the text, unless kept) with the fingerprint as a long under `name`."""
    names = [c for c in docs.columns if c != column or keep_text]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(name, T.LongType())])

    def run(batches):
        for batch in batches:
            fps = pa.array([fingerprint(x.as_py()) for x in batch.column(column)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), fps], names=[*names, name])

    return docs.mapInArrow(run, schema)


class BKForest:
    """BK-trees of many shards at once. shard: sorted; fp: distinct within a shard."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray) -> None:
        n = len(fp)
        self.fp, self.root = fp, np.zeros(n, np.int64)
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        rest, under = np.arange(n), np.unique(shard, return_inverse=True)[1]
        first = True
        while len(rest):
            new = np.ones(len(rest), bool)
            new[1:] = under[1:] != under[:-1]
            node = rest[new][np.cumsum(new) - 1]
            if first:
                self.root[rest], first = node, False
            rest, node = rest[~new], node[~new]
            far = np.bitwise_count(fp[rest] ^ fp[node]).astype(np.int64)
            parent[rest], edge[rest] = node, far  # the last to be written is the true parent
            under = node * 128 + far
            order = np.argsort(under, kind="stable")
            rest, under = rest[order], under[order]
        child = np.flatnonzero(parent >= 0)
        key = parent[child] * 128 + edge[child]
        order = np.argsort(key, kind="stable")
        self.child, self.key = child[order], key[order]

    def within(self, queries: np.ndarray, radius: int):
        """Pairs (query, node) of each level's nodes within the radius, themselves left out."""
        query, node = queries, self.root[queries]
        while len(query):
            far = np.bitwise_count(self.fp[query] ^ self.fp[node]).astype(np.int64)
            hit = (far <= radius) & (query != node)
            yield query[hit], node[hit]
            low = np.searchsorted(self.key, node * 128 + np.maximum(far - radius, 0))
            high = np.searchsorted(self.key, node * 128 + np.minimum(far + radius, 127), side="right")
            n = high - low
            query = np.repeat(query, n)
            at = np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            node = self.child[at]


def shard_links(shard: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(member, representative) indices: a spanning forest of all links inside each shard."""
    forest = BKForest(shard, fp)
    label = np.arange(len(fp))
    _, size = np.unique(shard, return_counts=True)
    cost = np.cumsum(np.repeat(size, size))
    cuts = np.searchsorted(cost, np.arange(FRONTIER, cost[-1] + FRONTIER, FRONTIER)) if len(cost) else []
    done = 0
    for cut in [*cuts, len(fp)]:
        cut = min(max(int(cut), done), len(fp))
        if cut == done:
            continue
        for a, b in forest.within(np.arange(done, cut), radius):
            while True:
                x, y = label[a], label[b]
                apart = x != y
                if not apart.any():
                    break
                a, b, low = a[apart], b[apart], np.minimum(x, y)[apart]
                np.minimum.at(label, np.maximum(x, y)[apart], low)
                while (label[label] != label).any():
                    label = label[label]
        done = cut
    member = np.flatnonzero(label != np.arange(len(fp)))
    return member, label[member]


def _masks(radius: int, same: int) -> list[int]:
    """One bit mask for each choice of `same` of radius + same fields, as signed longs."""
    n = radius + same
    edges = [64 * i // n for i in range(n + 1)]
    field = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(n)]
    out = [sum(field[i] for i in pick) for pick in combinations(range(n), same)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in out]


def split(rows: DataFrame, level: int, radius: int) -> DataFrame:
    """rows (shard, used: the bits on which a shard agrees, _fp, _id) in the smaller shards of radius + 1 sets of the other bits each."""
    n = radius + 1
    sets = [sum(1 << j for j in range(64) if j // n**level % n == i) for i in range(n)]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m - (1 << 64) if m >> 63 else m).alias("bits")) for i, m in enumerate(sets)]))
    deeper = rows.select("*", each.alias("m")).withColumn("_bits", F.col("m.bits").bitwiseAND(F.bitwise_not("used")))
    return deeper.select(F.xxhash64("shard", "m.i", F.col("_fp").bitwiseAND(F.col("_bits"))).alias("shard"), F.col("used").bitwiseOR(F.col("_bits")).alias("used"), "_fp", "_id")


def links(nodes: DataFrame, radius: int = RADIUS, same: int = 2) -> DataFrame:
    """Links between distinct fingerprints (_fp, _id): (src, dst) ids, a spanning forest of each shard."""
    masks = F.array(*[F.struct(F.lit(i).alias("pick"), F.lit(m).alias("mask")) for i, m in enumerate(_masks(radius, same))])
    rows = nodes.select("_fp", "_id", F.explode(masks).alias("m")).select(F.xxhash64(F.col("m.pick"), F.col("_fp").bitwiseAND(F.col("m.mask"))).alias("shard"), F.col("m.mask").alias("used"), "_fp", "_id")
    for level in range(SPLITS):
        large = rows.groupBy("shard").agg(F.count("*").alias("_n")).where(F.col("_n") > LARGE).select(F.col("shard").alias("_large"))
        large = materialize(large, "large_shards")
        if not (n := large.count()):
            break
        told = rows.join(F.broadcast(large) if n <= BROADCAST_SHARDS else large, F.col("shard") == F.col("_large"), "left")
        rows = materialize(told.where("_large is null").drop("_large").unionByName(split(told.where("_large is not null").drop("_large"), level, radius)), "shard_rows")
    sharded = rows.select("shard", "_fp", "_id").repartition("shard").sortWithinPartitions("shard")

    def solve(shard, fp, ident):
        _, at, size = np.unique(shard, return_inverse=True, return_counts=True)
        many = size[at] > 1
        shard, fp, ident = shard[many], fp[many].view(np.uint64), ident[many]
        if not len(fp):
            return None
        a, b = shard_links(shard, fp, radius)
        return pa.RecordBatch.from_pydict({"src": ident[a], "dst": ident[b]}) if len(a) else None

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            new = [batch.column(c).to_numpy() for c in ("shard", "_fp", "_id")]
            held = [np.concatenate([x, y]) for x, y in zip(held, new, strict=True)]
            if len(held[0]) < 1 << 17 or held[0][0] == held[0][-1]:
                continue
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last shard may go on
            if (out := solve(*(x[:cut] for x in held))) is not None:
                yield out
            held = [x[cut:] for x in held]
        if len(held[0]) and (out := solve(*held)) is not None:
            yield out

    return sharded.mapInArrow(run, "src long, dst long")


def classes(fps: DataFrame, id_column: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """fps (a written table with _fp) with component_id, the smallest id reachable over links."""
    spare = NO_ID - F.pmod(F.xxhash64("_fp"), F.lit(1 << 40))  # stands for fingerprints of null ids only
    nodes = materialize(fps.groupBy("_fp").agg(F.min(id_column).cast("long").alias("_id")).withColumn("_id", F.coalesce("_id", spare)), "fingerprints")
    found = connected_components(links(nodes, radius))
    named = nodes.join(found, nodes["_id"] == found["node"], "left").select("_fp", F.coalesce("component", "_id").alias("_c"))
    named = named.select("_fp", F.when(F.col("_c") < NO_ID - (1 << 40), F.col("_c")).alias("component_id"))
    return fps.join(named, "_fp")


def near_dedup(docs: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """One row of each class of docs: that with the smallest id, or any one where all ids are null.

    Classes are named by fingerprints here, not by ids: unrelated texts stay apart where ids are null or repeated.
    """
    fp, place = free_name(docs, "_fp"), free_name(docs, "_n")
    marked = materialize(with_fingerprints(docs, column, keep_text=True, name=fp), "simhash_docs")
    nodes = materialize(marked.groupBy(F.col(fp).alias("_fp")).agg(F.min(id_column).alias("_low")), "fingerprints")
    found = connected_components(links(nodes.select("_fp", F.col("_fp").alias("_id"))))
    named = nodes.join(found, nodes["_fp"] == found["node"], "left").withColumn("_c", F.coalesce("component", "_fp"))
    best = F.min(F.struct(F.col("_low").isNull().alias("_none"), "_low", "_fp")).alias("_best")
    low, low_fp = free_name(docs, "_keep"), free_name(docs, "_keep_fp")
    first = named.groupBy("_c").agg(best).select(F.col("_best._low").alias(low), F.col("_best._fp").alias(low_fp))
    out = marked.join(first, F.col(id_column).eqNullSafe(F.col(low)) & (F.col(fp) == F.col(low_fp)), "left_semi")
    one = Window.partitionBy(fp).orderBy(F.xxhash64(column))  # each class has one fingerprint left
    return out.withColumn(place, F.row_number().over(one)).where(F.col(place) == 1).select(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 4: SimHash fingerprints of all documents and their link classes."""
    fps = materialize(with_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")), "simhash")
    out = classes(fps)
    return out.select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")
