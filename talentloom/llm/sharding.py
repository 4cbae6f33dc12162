"""Sharding (operator 5): balanced label propagation under exact quotas.

Documents that share a group are linked. Linked documents start in group
order, in shards of even sizes, so at most one group lies across each border. In
each round Spark joins send every document of a split group the numbers of its
neighbours by shard, and it asks to move to the shard where the whole group would
fit (of several that with most of them; where none has room, that with most of them). Shards let
documents change places in cycles, and beyond that take in what their quota leaves;
who goes first is decided by the gain and then by group. Rounds go on until no request can be met: each one
raises the number of linked pairs in one shard, or it is not taken. Afterwards
documents without links fill each shard up to its quota, so counts are at most
one apart whatever the links were.

All ranks, slots and starts are places in a range-partitioned order that is cut inside
groups too, so no task orders a shard or a large group. Groups of more than
1/``HOT`` of all documents (fewer than ``HOT`` of them) are told by a broadcast list, and no other
key of a join holds more. Everything is DataFrame expressions; no Python runs on executors.

Defined cases: null text has size 1, crc of the empty text and the group of
empty texts; repeated rows are documents of their own; null ids are allowed;
ties are broken by hash; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentloom.llm.common import blank, materialize, table

SHARDS = 8
HOT = 1024
#: Rows of split groups by shard that are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 16


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows (written) with a gapless number from 0 in the given order.

    Ranges of the order are even whatever its first columns are; only one count a range is summed over.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumn("_i", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_i", 33)
    base = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_k"))
    before = F.sum("_k").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    base = base.select("_p", F.coalesce(before, F.lit(0)).alias("_base"))  # one row a range
    out = placed.join(F.broadcast(base), part == F.col("_p"))
    return out.select(*rows.columns, (F.col("_base") + F.col("_i").bitwiseAND((1 << 33) - 1)).alias(name))


def within(rows: DataFrame, few: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with a gapless number from 0 inside each value of `few` columns that have few values (shards, pairs of shards)."""
    out = numbered(rows, [*map(F.col, few), *order], "_r")
    first = out.groupBy(*few).agg(F.min("_r").alias("_first"))
    first = first.select(*[F.col(c).alias(f"_f{i}") for i, c in enumerate(few)], "_first")
    on = F.lit(True)
    for i, c in enumerate(few):
        on = on & (F.col(c) == F.col(f"_f{i}"))
    return out.join(F.broadcast(first), on).select(*rows.columns, (F.col("_r") - F.col("_first")).alias(name))


def _cycle(edges: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """The edges of some cycle of a graph of shards, or none."""
    done: set[int] = set()

    def walk(at: int, path: list[int]) -> list[int]:
        if at in path:
            return [*path[path.index(at) :], at]
        if at in done:
            return []
        for (a, b), n in edges.items():
            if a == at and n and (found := walk(b, [*path, at])):
                return found
        done.add(at)
        return []

    for start in sorted({a for a, _ in edges}):
        if found := walk(start, []):
            return list(zip(found[:-1], found[1:], strict=True))
    return []


def allowances(want: dict[tuple[int, int], int], room: dict[int, int]) -> dict[tuple[int, int], int]:
    """How many of the requests from shard to shard are met: first cycles, which need no room, then what room lets in."""
    left, room, may = dict(want), dict(room), Counter()
    while ring := _cycle(left):
        n = min(left[e] for e in ring)
        for e in ring:
            left[e] -= n
            may[e] += n
    moved = True
    while moved:
        moved = False
        for a, b in sorted(left, key=lambda e: (-left[e], e)):
            n = min(left[a, b], room[b])
            if n > 0:
                may[a, b] += n
                left[a, b] -= n
                room[b] -= n
                room[a] += n
                moved = True
    return dict(may)


def seats(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(group, shard, k): how many members of each group sit in each shard."""
    at = nodes.select(F.col("node").alias("_n"), "shard")
    return materialize(members.join(at, members["node"] == at["_n"]).groupBy("group", "shard").agg(F.count("*").alias("k")), "seats")


def requests(nodes: DataFrame, members: DataFrame, held: DataFrame, room: dict[int, int], whole: bool) -> DataFrame:
    """(node, shard, to, gain, lead) of documents of split groups that ask to move.

    whole: prefer shards with room for all of the group that is not there yet.
    """
    sizes = held.groupBy("group").agg(F.sum("k").alias("_all"), F.count("*").alias("_shards")).where("_shards > 1").withColumnRenamed("group", "_g")
    free = F.create_map(*[F.lit(x) for s, n in sorted(room.items()) for x in (s, n)])
    fits = F.col("_all") - F.col("k") <= free[F.col("shard")] if whole else F.lit(False)
    torn = held.join(sizes, held["group"] == sizes["_g"]).select("_g", F.col("shard").alias("_s"), "k", fits.alias("_fits"), F.xxhash64("group", "shard").alias("_tie"))
    torn = materialize(torn, "split_groups")
    few = torn.count() <= BROADCAST_ROWS
    votes = members.join(F.broadcast(torn) if few else torn, members["group"] == torn["_g"])
    votes = votes.groupBy("node", "_s").agg(F.sum("k").alias("_k"), F.min("_fits").alias("_fits"), F.min("_tie").alias("_tie"), F.min("group").alias("lead"))
    choice = F.struct("_fits", "_k", "_tie", "_s")  # groups tie in different shards, so that they can change places
    best = votes.groupBy("node").agg(F.max(choice).alias("_best"), F.min("lead").alias("lead"), F.map_from_entries(F.collect_list(F.struct("_s", "_k"))).alias("_by"))
    best = best.select(F.col("node").alias("_v"), F.col("_best._s").alias("to"), F.col("_best._k").alias("_top"), "_by", "lead")
    asks = nodes.join(best, nodes["node"] == best["_v"]).where("to <> shard")
    return asks.select("node", "shard", "to", (F.col("_top") - F.coalesce(F.element_at("_by", F.col("shard")), F.lit(0))).alias("gain"), "lead")


def propagate(nodes: DataFrame, members: DataFrame, quota: dict[int, int]) -> DataFrame:
    """nodes (node, shard: a start within the quotas) and members (node, group) -> nodes with their last shard.

    The sizes of shards never exceed the quotas. A node may be a member of several groups; a link is a group of two.
    """
    nodes = materialize(nodes.select("node", "shard"), "shard_nodes")
    shards, whole = sorted(quota), True
    held = seats(nodes, members)
    together = F.sum(F.col("k") * F.col("k"))
    score = held.agg(together).first()[0] or 0
    while True:
        size = {r[0]: r[1] for r in nodes.groupBy("shard").count().collect()}  # at most one row a shard
        room = {s: quota[s] - size.get(s, 0) for s in shards}
        asks = within(requests(nodes, members, held, room, whole), ["shard", "to"], [F.desc("gain"), F.xxhash64("lead"), F.xxhash64("node")], "place")
        want = {(r[0], r[1]): r[2] for r in asks.groupBy("shard", "to").count().collect()}  # shards squared
        may = allowances(want, room)
        if may:
            limit = F.create_map(*[F.lit(x) for (a, b), n in sorted(may.items()) for x in (a * len(shards) + b, n)])
            moved = asks.where(F.col("place") < limit[F.col("shard") * len(shards) + F.col("to")]).select(F.col("node").alias("_m"), "to")
            after = materialize(nodes.join(moved, nodes["node"] == moved["_m"], "left").select("node", F.coalesce("to", "shard").alias("shard")), "shard_nodes")
            held_after = seats(after, members)
            reached = held_after.agg(together).first()[0]
            if reached > score:
                nodes, held, score = after, held_after, reached
                continue
        if not whole:
            return nodes
        whole = False  # no group fits any more: majorities alone


def even_quotas(n: int, shards: int) -> dict[int, int]:
    return {s: n // shards + (s < n % shards) for s in range(shards)}


def fill(number: str, sizes: list[int]) -> Column:
    """The shard of a gapless number when shards take sizes[0], sizes[1], ... numbers in turn."""
    out, upto = F.lit(len(sizes) - 1), sum(sizes)
    for s in range(len(sizes) - 2, -1, -1):
        upto -= sizes[s + 1]
        out = F.when(F.col(number) < upto, s).otherwise(out)
    return out.cast("int")


def balanced_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs (a written table with node long, unique, and group) -> (node, shard): equal counts, groups kept together."""
    n = docs.count()
    sizes = materialize(docs.groupBy("group").agg(F.count("*").alias("_n")).where("_n > 1"), "group_sizes")
    many, hot = sizes.select(F.col("group").alias("_g")), sizes.where(F.col("_n") * HOT > n).select(F.col("group").alias("_h"))
    told = docs.select("node", "group").join(F.broadcast(hot), F.col("group") == F.col("_h"), "left")
    cold = told.where("_h is null").join(many, F.col("group") == F.col("_g"), "left")
    marked = told.where("_h is not null").select("node", "group", F.lit(True).alias("many")).unionByName(cold.select("node", "group", F.col("_g").isNotNull().alias("many")))
    marked = materialize(marked, "marked")
    linked = numbered(marked.where("many").select("node", "group"), [F.xxhash64("group"), F.col("group"), F.xxhash64("node")], "_r")
    linked = materialize(linked, "linked")
    start = linked.select("node", fill("_r", list(even_quotas(linked.count(), shards).values())).alias("shard"))
    placed = propagate(start, linked.select("node", "group"), even_quotas(n, shards))
    held = {r[0]: r[1] for r in placed.groupBy("shard").count().collect()}
    free = [q - held.get(s, 0) for s, q in even_quotas(n, shards).items()]
    single = numbered(marked.where("not many").select("node"), [F.xxhash64("node")], "_r")
    return placed.select("node", "shard").unionByName(single.select("node", fill("_r", free).alias("shard")))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 5: all documents in 8 shards by the law `rows`, documents of equal text kept together."""
    text = blank(F.col("text"))
    size = (F.octet_length(text) + 1).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("group"))
    # the id of a written row: its place in the table, fixed once the table is written
    docs = materialize(docs.withColumn("node", F.monotonically_increasing_id()), "shard_docs")
    shard = materialize(balanced_shards(docs.select("node", "group")), "shards")
    placed = docs.join(shard.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).select("doc_id", "size", "text_crc32", "node", "shard")
    out = within(placed, ["shard"], [F.xxhash64("node")], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
