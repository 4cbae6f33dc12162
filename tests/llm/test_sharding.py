import zlib

from pyspark.sql import functions as F

from talentloom.llm import sharding as H
from talentloom.llm.common import materialize


def check_law(rows, shards=8):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def test_query_obeys_the_law(spark, sf, corpus):
    rows = H.op5_sharding(spark, sf).collect()
    assert len(rows) == len(corpus)
    check_law(rows)
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in corpus), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == want
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}


def cut(spark, groups, shards=8):
    rows = [(i, g) for i, g in enumerate(groups)]
    docs = materialize(spark.createDataFrame(rows, "node long, group long").repartition(3), "t")
    placed = {r["node"]: r["shard"] for r in H.balanced_shards(docs, shards).collect()}
    counts = [sum(s == k for s in placed.values()) for k in range(shards)]
    assert sorted(placed) == list(range(len(groups))) and max(counts) - min(counts) <= 1
    split = {}
    for i, g in rows:
        split.setdefault(g, set()).add(placed[i])
    return sum(len(v) > 1 for v in split.values())


def test_small_groups_come_together(spark):
    assert cut(spark, [100 + i // 3 for i in range(60)] + [10_000 + i for i in range(200)]) == 0
    assert cut(spark, [i // 5 for i in range(150)] + [10_000 + i for i in range(60)]) == 0


def test_groups_larger_than_the_room_of_one_border(spark):
    assert cut(spark, [1] * 25 + [2] * 25 + [3] * 25 + [1000 + i for i in range(165)]) == 0


def test_huge_group_is_split_evenly(spark):
    assert cut(spark, [1] * 90 + [1000 + i for i in range(160)]) == 1


def test_all_linked(spark):
    assert cut(spark, [i // 2 for i in range(64)]) == 0
    assert cut(spark, [i // 3 for i in range(64)]) <= 7


def brute_cut(placed, members):
    by = {}
    for node, group in members:
        by.setdefault(group, []).append(placed[node])
    return sum(a != b for v in by.values() for i, a in enumerate(v) for b in v[:i])


def test_rounds_only_lower_the_cut_and_keep_quotas(spark):
    """From a scattered start, by documents and by links that share documents, held against counting all pairs."""
    groups = [(i, 100 + i % 7) for i in range(56)]
    chain = [(i + k, 500 + i) for i in range(40) for k in (0, 1)]
    for members, room in ((groups, 4), (groups, 0), (chain, 3)):
        nodes = sorted({n for n, _ in members})
        start = {n: n % 4 for n in nodes}
        quota = {s: sum(v == s for v in start.values()) + room for s in range(4)}
        df = materialize(spark.createDataFrame(list(start.items()), "node long, shard int"), "t")
        out = {r["node"]: r["shard"] for r in H.propagate(df, materialize(spark.createDataFrame(members, "node long, group long"), "t"), quota).collect()}
        assert sorted(out) == nodes and all(sum(v == s for v in out.values()) <= q for s, q in quota.items())
        assert brute_cut(out, members) < brute_cut(start, members)


def test_requests_by_hand(spark):
    nodes = materialize(spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (5, 2)], "node long, shard int"), "t")
    members = materialize(spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 8), (5, 8)], "node long, group long"), "t")
    ask = lambda room, whole: {(r["node"], r["to"]) for r in H.requests(nodes, members, H.seats(nodes, members), room, whole).collect()}
    one_of = ({(5, 1)}, {(4, 2)})  # a tie
    got = ask({0: 0, 1: 0, 2: 0}, False)
    assert (3, 0) in got and got - {(3, 0)} in one_of
    got = ask({0: 0, 1: 2, 2: 1}, True)
    assert {(1, 1), (2, 1)} <= got and got - {(1, 1), (2, 1)} in one_of


def test_allowances():
    assert H.allowances({(0, 1): 5, (1, 0): 3}, {0: 0, 1: 0}) == {(0, 1): 3, (1, 0): 3}
    assert H.allowances({(0, 1): 2, (1, 2): 2, (2, 0): 4}, {0: 0, 1: 0, 2: 0}) == {(0, 1): 2, (1, 2): 2, (2, 0): 2}
    assert H.allowances({(0, 1): 2, (1, 2): 4}, {0: 0, 1: 0, 2: 3}) == {(0, 1): 2, (1, 2): 3}


def test_numbers_are_gapless(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), "id")
    got = {}
    for r in H.within(rows, ["g"], [F.xxhash64("id")], "n").collect():
        got.setdefault(r["g"], []).append(r["n"])
    assert len(got) == 3 and all(sorted(v) == list(range(len(v))) for v in got.values())
    one = H.numbered(rows, [F.desc("id")], "n").collect()
    assert {r["id"]: r["n"] for r in one} == {i: 499 - i for i in range(500)}


def test_extra_columns_of_clashing_names(spark, tmp_path):
    rows = [(i, "same" if i % 3 else None, i, i, "x") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, node long, shard long, group string").write.parquet(str(tmp_path / "documents.parquet"))
    out = H.op5_sharding(spark, str(tmp_path)).collect()
    check_law(out)
    assert sorted(r["doc_id"] for r in out) == list(range(20))


def test_empty(spark, sf, tmp_path):
    spark.read.parquet(sf + "/documents.parquet").limit(0).write.parquet(str(tmp_path / "e" / "documents.parquet"))
    assert H.op5_sharding(spark, str(tmp_path / "e")).collect() == []
