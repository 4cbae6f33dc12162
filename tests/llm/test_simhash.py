import numpy as np
import xxhash

from talentloom.llm import simhash as S
from talentloom.llm.components import connected_components


def plain(text):
    words = bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode()).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_text(seed):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**6, 60))


def brute(fps, radius=4):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_query_matches_brute_force(spark, sf, corpus):
    fps = [plain(t) for _, t in corpus]
    root = brute(fps)
    low = {}
    for k, (i, _) in enumerate(corpus):
        if i is not None:
            low[root[k]] = min(low.get(root[k], i), i)
    want = sorted(((i, f"{fps[k]:016x}", low.get(root[k])) for k, (i, _) in enumerate(corpus)), key=str)
    assert sorted((tuple(r) for r in S.op4_simhash(spark, sf).collect()), key=str) == want


def test_forest_finds_all_links_of_random_shards():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fp = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 12, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 12, dtype=np.uint64)) for _ in range(40)]))
    shard = np.sort(rng.integers(0, 3, len(fp)))
    member, head = S.shard_links(shard, fp)
    parent = np.arange(len(fp))
    parent[member] = head
    for s in range(3):
        at = np.flatnonzero(shard == s)
        want = brute([int(x) for x in fp[at]])
        assert len(set(want)) == len({parent[i] for i in at})


def test_masks_cover_every_pair():
    rng = np.random.default_rng(5)
    for same in (1, 2, 3):
        masks = S._masks(4, same)
        for _ in range(300):
            flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any((m & flips) == 0 for m in masks)


def test_near_dedup_keeps_one_of_each_class(docs, corpus):
    out = S.near_dedup(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert ids.count(60) == 1 and 30 not in ids and 31 not in ids and 3 in ids
    assert ids.count(None) <= 1


def test_near_dedup_keeps_unrelated_texts_under_null_and_repeated_ids(spark):
    other = [plain_text(k) for k in range(5)]
    rows = [(None, other[0]), (None, other[0]), (None, other[1]), (None, other[2]), (7, other[3]), (7, other[4]), (7, other[4]), (9, other[2])]
    out = S.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == sorted([("None", other[0]), ("None", other[1]), ("9", other[2]), ("7", other[3]), ("7", other[4])])


def test_empty_table(empty):
    assert S.near_dedup(empty).collect() == []


def test_large_shards_are_split_without_losing_links(spark, monkeypatch):
    """Fingerprints that agree on two fields, far more than a shard may hold, among others."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    base[:110] = (base[:110] >> np.uint64(22) << np.uint64(22)) | np.uint64(0x2ABCDE)
    noise = np.zeros((4, 150), np.uint64)
    for _ in range(2):
        noise ^= np.uint64(1) << rng.integers(0, 64, (4, 150), dtype=np.uint64)
    fps = np.unique(np.concatenate([base, (base ^ noise).reshape(-1)]))
    nodes = spark.createDataFrame([(int(x), k) for k, x in enumerate(fps.view(np.int64))], "_fp long, _id long")
    want = brute([int(x) for x in fps])
    monkeypatch.setattr(S, "LARGE", 20)
    label = {r["node"]: r["component"] for r in connected_components(S.links(nodes)).collect()}
    assert [label.get(i, i) for i in range(len(fps))] == want


def test_split_keeps_every_link_together(spark):
    """Two fingerprints of one shard that differ in 4 bits meet in some smaller shard at every level."""
    rng = np.random.default_rng(9)
    used = 0x3FFFFF
    rows = []
    for k in range(40):
        a = int(rng.integers(0, 2**63))
        b = a
        for j in rng.choice(np.arange(22, 64), 4, replace=False):
            b ^= 1 << int(j)
        rows += [(k, used, int(np.uint64(x).view(np.int64)), k) for x in (a, b)]
    df = spark.createDataFrame(rows, "shard long, used long, _fp long, _id long")
    for level in range(S.SPLITS):
        df = S.split(df, level, S.RADIUS)
        met = {r["_id"] for r in df.groupBy("shard", "_id").count().where("count = 2").collect()}
        assert met == set(range(40))


def test_near_dedup_with_columns_of_every_internal_name(spark):
    names = ["_fp", "_n", "_keep", "_keep_fp", "_id", "_low", "_c", "component", "node", "shard", "__n"]
    rows = [(i, f"one two three four five {i // 2} six seven eight", *(f"{n}{i}" for n in names)) for i in range(6)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    out = S.near_dedup(docs)
    assert out.columns == docs.columns
    kept = {r["doc_id"]: tuple(r) for r in out.collect()}
    assert {0, 2, 4} >= set(kept) and all(kept[i] == rows[i] for i in kept)
