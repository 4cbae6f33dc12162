"""Conversation prefix trie (operator 11): distributed MSD radix partitioning, local buckets finished by multikey quicksort.

Turns are dictionary-encoded once: a turn (role, text) is known by the SHA-256 of its length-prefixed role and its text, distinct
digests get dense-enough long ids, and only ids and byte counts travel from there on. Every sequence ends with the
end sign ``END``, which is less than any id.

A bucket holds the sequences that share a node's turns, as rows (conversation, depth, turn). Large buckets are split by all
executors together: a round skips the turns that all members of a bucket share (one aggregation by depth finds the first at which they
differ, so that long common stretches and many copies cost one round) and deals the members by their next turn. Buckets of at most ``LOCAL_ROWS`` rows go whole to
a task, where a multikey quicksort finishes them and emits a node for each run of equal turns. Sums over subtrees return from children to
parents round by round, from sums of children only.

A node is named exactly by its depth and smallest member, since nodes of one depth have different members; no hash stands for a prefix.
Members that end at a node of a large bucket are packed into ordered runs by ranges of (node, id) and digested as a stream, so that no task holds a node's list.

Defined cases: null role and text are empty; rows with a null conversation id take no part; repeated turns stay, ordered by turn (nulls first), role
and text; `%` keeps the sign of negative ids, as in SQL; a conversation whose own first turns are cut and whose
base is absent may be turnless and ends at the root; extra columns are ignored; an empty table has no node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentloom.llm.common import blank, materialize, table

END = -1
#: Rows of a bucket up to which one task finishes it.
LOCAL_ROWS = 1024
#: Ids packed into one run of a node's list, and depths that one step of a running sum takes.
RUN, SEGMENT = 4096, 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE_SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean"
BUCKET = ["nd", "nc"]


def encoded_turns(conversations: DataFrame) -> DataFrame:
    """(c, p, t, b): conversation, place of the turn from 1, its dictionary id and the UTF-8 bytes of its text."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), "turn", blank(F.col("role")).alias("role"), blank(F.col("text")).alias("text"))
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    named = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    # ranges are cut inside long conversations; texts go no further than this sort
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranged.select("c", named.alias("key"), F.octet_length("text").cast("long").alias("b"), F.monotonically_increasing_id().alias("i")), "trie_turns")
    part = F.shiftright("i", 33)
    counts = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_k"))
    before = F.sum("_k").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_p", F.coalesce(before, F.lit(0)).alias("_base"))  # one row a range
    first = placed.join(F.broadcast(counts), part == F.col("_p")).groupBy("c").agg(F.min(F.col("_base") + F.col("i").bitwiseAND((1 << 33) - 1)).alias("_first"))
    words = materialize(placed.groupBy("key").agg(F.max("b").alias("b")).select(F.col("key").alias("_key"), F.monotonically_increasing_id().alias("t")), "trie_dictionary")
    out = placed.join(F.broadcast(counts), part == F.col("_p")).withColumn("i", F.col("_base") + F.col("i").bitwiseAND((1 << 33) - 1)).drop("_base", "_p")
    out = out.join(words, F.col("key") == F.col("_key")).select("c", "i", "t", "b")
    first = first.withColumnRenamed("c", "_c")
    return materialize(out.join(first, F.col("c") == F.col("_c")).select("c", (F.col("i") - F.col("_first") + 1).alias("p"), "t", "b"), "trie_encoded")


def head_length(c: Column) -> Column:
    """How many first turns a conversation takes from its base."""
    return F.pmod(F.crc32(c.cast("string")), F.lit(9))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Encoded turns -> rows (c, d, t, b, e) of the rebuilt conversations, each closed by an END row at depth e."""
    found = materialize(turns.groupBy("c").agg(F.count("*").alias("m")).withColumn("h", head_length(F.col("c"))).withColumn("base", F.col("c") - F.col("c") % 5), "trie_conversations")
    bases = found.select(F.col("c").alias("_b"), F.col("m").alias("_m"))
    kept = F.least("h", F.coalesce("_m", F.lit(0))).alias("k")
    convs = found.join(bases, F.col("base") == F.col("_b"), "left").select(F.col("c").alias("_c"), "base", "h", kept, "m")
    convs = materialize(convs.withColumn("e", F.col("k") + F.greatest(F.col("m") - F.col("h"), F.lit(0)) + 1), "trie_plan")
    own = turns.join(convs, F.col("c") == F.col("_c")).where("p > h").select("c", (F.col("k") + F.col("p") - F.col("h")).alias("d"), "t", "b", "e")
    # a base's first turns go to the ids around it that round to it: nine places at most, of which those present join
    near = F.filter(F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda x: F.try_add(F.col("c"), x.cast("long"))), lambda x: x.isNotNull())
    heads = turns.where("p <= 8 and c % 5 = 0").select(F.col("c").alias("_from"), "p", "t", "b", F.explode(near).alias("c"))
    heads = heads.join(convs, (F.col("c") == F.col("_c")) & (F.col("base") == F.col("_from"))).where("p <= h").select("c", F.col("p").alias("d"), "t", "b", "e")
    ends = convs.select(F.col("_c").alias("c"), F.col("e").alias("d"), F.lit(END).cast("long").alias("t"), F.lit(0).cast("long").alias("b"), "e")
    return own.unionByName(heads).unionByName(ends)


class Bucket:
    """A local bucket: sequences under one node, sorted by conversation and depth."""

    def __init__(self, depth: int, conv: int, parent: int | None, n: int, size: int) -> None:
        self.conv, self.depth, self.up, self.n, self.bytes = [conv], [depth], [-1], [n], [size]
        self.children, self.ends, self.parent = [0], [[]], parent

    def _node(self, up: int, depth: int, conv: int, n: int, size: int) -> int:
        self.conv.append(conv)
        self.depth.append(depth)
        self.up.append(up)
        self.n.append(n)
        self.bytes.append(size)
        self.children.append(0)
        self.ends.append([])
        self.children[up] += 1
        return len(self.conv) - 1

    def sort(self, starts: list[int], c: list[int], t: list[int], b: list[int]) -> None:
        """Multikey quicksort: three-way partitions by the turn at one place; the equal part is a node (or ends) and goes on one turn deeper."""
        stack = [(starts, 0, 0)]
        while stack:
            members, place, node = stack.pop()
            pivot = t[members[len(members) // 2] + place]
            if len(members) > 1:
                less = [m for m in members if t[m + place] < pivot]
                more = [m for m in members if t[m + place] > pivot]
                members = [m for m in members if t[m + place] == pivot]
                stack.extend((part, place, node) for part in (less, more) if part)
            if pivot == END:
                self.ends[node] = sorted(c[m] for m in members)
            else:
                low = min(members, key=c.__getitem__)
                below = self._node(node, self.depth[node] + 1, c[low], len(members), b[low + place])
                stack.append((members, place + 1, below))

    def rows(self) -> list[list]:
        """Columns of NODE_SCHEMA; nodes stand behind their parents, so one backward walk sums subtrees."""
        leaves, saved = [0] * len(self.conv), [0] * len(self.conv)
        for i in range(len(self.conv) - 1, -1, -1):
            leaves[i] += not self.children[i]
            saved[i] += (self.n[i] - 1) * self.bytes[i]
            if i:
                leaves[self.up[i]] += leaves[i]
                saved[self.up[i]] += saved[i]
        above = [self.parent, *(self.conv[u] for u in self.up[1:])]
        ends = [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() if e else NO_ENDS for e in self.ends]
        return [self.conv, self.depth, above, self.n, self.children, leaves, saved, ends, [True] + [False] * (len(self.conv) - 1)]


_NODES = pa.schema([(x, pa.int64()) for x in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends_sha256", pa.string()), ("top", pa.bool_())])


def finish_local(rows: DataFrame) -> DataFrame:
    """All nodes of local buckets (nd, nc, pc, n, tb, c, d, t, b), their tops included."""
    dealt = rows.select("nd", "nc", "pc", "n", "tb", "c", "d", "t", "b").repartition(*BUCKET).sortWithinPartitions("nd", "nc", "c", "d")

    def solve(part: pa.Table):
        nd, nc, c = (part.column(x).to_numpy() for x in ("nd", "nc", "c"))
        new = np.ones(len(nd), bool)
        new[1:] = (nd[1:] != nd[:-1]) | (nc[1:] != nc[:-1])
        head = new.copy()
        head[1:] |= c[1:] != c[:-1]
        heads, cuts = np.flatnonzero(head), np.flatnonzero(new).tolist()
        ids, t, b = c.tolist(), part.column("t").to_numpy().tolist(), part.column("b").to_numpy().tolist()
        bounds = np.searchsorted(heads, [*cuts, len(nd)]).tolist()
        heads, out = heads.tolist(), [[] for _ in _NODES]
        for k, at in enumerate(cuts):
            bucket = Bucket(*(part.column(x)[at].as_py() for x in ("nd", "nc", "pc", "n", "tb")))
            bucket.sort(heads[bounds[k] : bounds[k + 1]], ids, t, b)
            for into, more in zip(out, bucket.rows(), strict=True):
                into.extend(more)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _NODES, strict=True)], schema=_NODES)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            part = pa.Table.from_batches(held)
            nd, nc = part.column("nd").to_numpy(), part.column("nc").to_numpy()
            same = (nd == nd[-1]) & (nc == nc[-1])
            cut = int(np.argmax(same))  # the last bucket may go on
            if cut:
                yield solve(part.slice(0, cut).combine_chunks())
                held = part.slice(cut).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(run, NODE_SCHEMA)


def digests(ends: DataFrame) -> DataFrame:
    """(depth, conv, c) -> (depth, conv, ends_sha256): ids are packed in order by ranges, then each node's runs are digested as a stream."""
    ranged = ends.select("depth", "conv", "c").repartitionByRange("depth", "conv", "c").sortWithinPartitions("depth", "conv", "c")

    def pack(batches):
        for batch in batches:
            depth, conv, c = (batch.column(x).to_numpy() for x in ("depth", "conv", "c"))
            cuts = [0, *(np.flatnonzero((depth[1:] != depth[:-1]) | (conv[1:] != conv[:-1])) + 1).tolist(), len(c)]
            spans = [(i, min(i + RUN, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for i in range(a, b, RUN)]
            cols = [[int(depth[i]) for i, _ in spans], [int(conv[i]) for i, _ in spans], [int(c[i]) for i, _ in spans], [",".join(map(str, c[i:j].tolist())) for i, j in spans]]
            yield pa.RecordBatch.from_pydict(dict(zip(("depth", "conv", "first", "ids"), cols, strict=True)), schema=pa.schema([("depth", pa.int64()), ("conv", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))

    def digest(batches):
        at, state = None, None
        for batch in batches:
            depth, conv, ids = (batch.column(x).to_pylist() for x in ("depth", "conv", "ids"))
            done = []
            for key, text in zip(zip(depth, conv, strict=True), ids, strict=True):
                if key != at:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield _digest_rows(done)
        if at is not None:
            yield _digest_rows([(*at, state.hexdigest())])

    packed = ranged.mapInArrow(pack, "depth long, conv long, first long, ids string").repartition("depth", "conv").sortWithinPartitions("depth", "conv", "first")
    return packed.mapInArrow(digest, "depth long, conv long, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["depth", "conv", "ends_sha256"])


def split_round(rows: DataFrame, tops: DataFrame) -> dict[str, DataFrame]:
    """One radix round over large buckets: rows (nd, nc, c, d, t, b, e); tops (nd, nc, pc, n, tb).

    levels: chain nodes (nd, nc, d, b); stops: (nd, nc, stop, n, tb, pc); ends: members that end at a bucket's last
    common node; rest: rows of the next buckets with w, their number of rows.
    """
    depths = materialize(rows.groupBy(*BUCKET, "d").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.max("b").alias("b")), "trie_depths")
    # the first depth that isn't shared; nobody ends before it, since an end is a difference or the last row
    stops = depths.groupBy(*BUCKET).agg(F.min(F.when((F.col("lo") != F.col("hi")) | (F.col("lo") == END), F.col("d"))).alias("stop"))
    stops = materialize(stops.join(tops, BUCKET), "trie_stops")
    where = stops.select(*BUCKET, "stop")
    levels = depths.join(where, BUCKET).where("d < stop").select(*BUCKET, "d", "b")
    marked = rows.join(where, BUCKET)
    here = materialize(marked.where("d = stop").select(*BUCKET, "c", "t", "b", "e", "stop"), "trie_next")
    ends = here.where(F.col("t") == END).select((F.col("stop") - 1).alias("depth"), F.col("nc").alias("conv"), "c")
    kids = here.where(F.col("t") != END).groupBy(*BUCKET, "t", "stop").agg(F.min("c").alias("kid"), F.count("*").alias("n"), F.max("b").alias("tb"), F.sum(F.col("e") - F.col("stop")).alias("w"))
    seats = here.where(F.col("t") != END).select(*BUCKET, "t", "c").join(kids, [*BUCKET, "t"])
    seats = seats.select(F.col("c").alias("_c"), F.col("stop").alias("_nd"), F.col("kid").alias("_nc"), F.col("nc").alias("pc"), "n", "tb", "w")
    rest = rows.join(seats, F.col("c") == F.col("_c")).where("d > _nd").select(F.col("_nd").alias("nd"), F.col("_nc").alias("nc"), "pc", "n", "tb", "w", "c", "d", "t", "b", "e")
    return {"levels": levels, "stops": stops, "ends": ends, "rest": materialize(rest, "trie_rows")}


def chain_sums(nodes: DataFrame) -> DataFrame:
    """nodes (nd, nc, d, own) with below: the sum of own from d on downwards in its bucket. A bucket's chain may be long, so it is summed in two steps."""
    seg = nodes.withColumn("_s", F.floor(F.col("d") / SEGMENT))
    after = Window.partitionBy(*BUCKET).orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    whole = seg.groupBy(*BUCKET, "_s").agg(F.sum("own").alias("_own")).withColumn("_after", F.coalesce(F.sum("_own").over(after), F.lit(0))).drop("_own")
    inside = Window.partitionBy(*BUCKET, "_s").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    return seg.withColumn("below", F.sum("own").over(inside)).join(whole, [*BUCKET, "_s"]).withColumn("below", F.col("below") + F.col("_after")).drop("_s", "_after")


def trie(sequences: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """All nodes of sequences (c, d, t, b, e), as in NODE_SCHEMA."""
    spark = sequences.sparkSession
    sequences = materialize(sequences, "trie_sequences")
    all_of = sequences.where(F.col("t") == END).agg(F.min("c").alias("low"), F.count("*").alias("n"), F.sum("e").alias("w")).first()
    if not all_of["n"]:
        return spark.createDataFrame([], NODE_SCHEMA)
    root = [F.lit(0).cast("long").alias("nd"), F.lit(all_of["low"]).cast("long").alias("nc"), F.lit(None).cast("long").alias("pc"), F.lit(all_of["n"]).alias("n"), F.lit(0).cast("long").alias("tb"), F.lit(all_of["w"]).alias("w")]
    rest, rounds, local = sequences.select(*root, "c", "d", "t", "b", "e"), [], []
    while True:
        local.append(rest.where(F.col("w") <= local_rows))
        large = rest.where(F.col("w") > local_rows)
        if large.isEmpty():
            break
        tops = large.groupBy(*BUCKET).agg(F.max("pc").alias("pc"), F.max("n").alias("n"), F.max("tb").alias("tb"))
        rounds.append(split_round(large.select(*BUCKET, "c", "d", "t", "b", "e"), materialize(tops, "trie_tops")))
        rest = rounds[-1]["rest"]
    leaf = local[0]
    for more in local[1:]:
        leaf = leaf.unionByName(more)
    nodes = [materialize(finish_local(leaf), "trie_local")]
    tops = nodes[0].where("top").select("depth", F.col("parent_conv_id").alias("pc"), "n_leaves", "saved_tokens")
    told = None
    for step in reversed(rounds):
        kids = tops if told is None else tops.unionByName(told)
        kids = kids.groupBy((F.col("depth") - 1).alias("_d"), F.col("pc").alias("_pc")).agg(F.count("*").alias("k"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        stops = step["stops"].join(kids, (F.col("nc") == F.col("_pc")) & (F.col("stop") - 1 == F.col("_d")), "left").drop("_d", "_pc")
        stops = materialize(stops.withColumn("leaves", F.coalesce("leaves", F.lit(1))).fillna(0, ["k", "saved"]), "trie_stops")
        chain = step["levels"].join(stops.select(*BUCKET, "n"), BUCKET).select(*BUCKET, "d", ((F.col("n") - 1) * F.col("b")).alias("own"))
        chain = chain_sums(chain.unionByName(stops.select(*BUCKET, F.col("nd").alias("d"), ((F.col("n") - 1) * F.col("tb")).alias("own"))))
        last, top = F.col("d") == F.col("stop") - 1, F.col("d") == F.col("nd")
        done = chain.join(stops, BUCKET).select(
            F.col("nc").alias("conv_id"),
            F.col("d").alias("depth"),
            F.when(top, F.col("pc")).otherwise(F.col("nc")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"),
            F.when(last, F.col("k")).otherwise(1).cast("long").alias("n_children"),
            F.col("leaves").cast("long").alias("n_leaves"),
            (F.col("below") + F.col("saved")).cast("long").alias("saved_tokens"),
            top.alias("top"),
        )
        done = materialize(done, "trie_nodes")
        told = done.where("top").select("depth", F.col("parent_conv_id").alias("pc"), "n_leaves", "saved_tokens")
        found = digests(step["ends"]).select(F.col("depth").alias("_d"), F.col("conv").alias("_c"), "ends_sha256")
        done = done.join(found, (F.col("depth") == F.col("_d")) & (F.col("conv_id") == F.col("_c")), "left").drop("_d", "_c")
        nodes.append(done.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))))
    out = nodes[0]
    for more in nodes[1:]:
        out = out.unionByName(more)
    return out


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 11: the prefix trie of the rebuilt conversations, one row a node."""
    return trie(rebuilt(encoded_turns(table(spark, sf_dir, "conversations")))).drop("top")


# crc32 by its bits: every byte is xored in, then eight shifts with the reversed polynomial follow (-1 stands for a shift)
OP11_SQL = """
WITH turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, count(*) AS m, c - c % 5 AS base FROM turns GROUP BY c),
steps AS (SELECT c, m, base, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS ops FROM convs),
heads AS (SELECT c, m, base, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), ops),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) % 9 AS h FROM steps),
plan AS (SELECT x.c, x.base, x.h, least(x.h, coalesce(y.m, 0)) AS k FROM heads x LEFT JOIN convs y ON x.base = y.c),
seqs AS (SELECT t.c, k + p - h AS d, role, text FROM turns t JOIN plan USING (c) WHERE p > h
    UNION ALL SELECT plan.c, p, role, text FROM plan JOIN turns t ON t.c = plan.base WHERE p <= h),
ids AS (SELECT c, d, text, dense_rank() OVER (ORDER BY role, text) AS t FROM seqs),
paths AS (SELECT c, d, octet_length(encode(text)) AS b, list(t) OVER (PARTITION BY c ORDER BY d) AS path FROM ids
    UNION ALL SELECT c, 0, 0, CAST([] AS BIGINT[]) FROM plan),
lasts AS (SELECT c, max(d) AS e FROM paths GROUP BY c),
nodes AS (SELECT d, path, min(c) AS conv_id, count(*) AS n, max(b) AS b FROM paths GROUP BY d, path),
members AS (SELECT p.c, p.d, n.conv_id FROM paths p JOIN nodes n ON p.d = n.d AND p.path = n.path),
ends AS (SELECT m.d, m.conv_id, string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c) AS ids FROM members m JOIN lasts l ON m.c = l.c AND m.d = l.e GROUP BY ALL),
family AS (SELECT n.d, n.conv_id, n.n, n.b, m.conv_id AS parent FROM nodes n LEFT JOIN members m ON m.c = n.conv_id AND m.d = n.d - 1),
kids AS (SELECT d - 1 AS d, parent AS conv_id, count(*) AS k FROM family WHERE d > 0 GROUP BY ALL),
under AS (SELECT m.d, m.conv_id, sum((f.n - 1) * f.b) AS saved, count(*) FILTER (WHERE k.k IS NULL) AS leaves
    FROM family f JOIN members m ON m.c = f.conv_id AND m.d <= f.d LEFT JOIN kids k ON k.d = f.d AND k.conv_id = f.conv_id GROUP BY ALL)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, f.parent AS parent_conv_id, f.n AS n_convs, coalesce(k.k, 0) AS n_children, u.leaves AS n_leaves,
    CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM family f JOIN under u ON u.d = f.d AND u.conv_id = f.conv_id LEFT JOIN kids k ON k.d = f.d AND k.conv_id = f.conv_id
LEFT JOIN ends e ON e.d = f.d AND e.conv_id = f.conv_id
"""
