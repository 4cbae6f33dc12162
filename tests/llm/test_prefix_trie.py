import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from talentloom.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, b int, n int"


def plain(rows):
    """The trie of rows (conv_id, turn, role, text) by dictionaries of whole prefixes."""
    turns = defaultdict(list)
    for c, turn, role, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns[c].append((role or "", text or ""))
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    nodes = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    kids = defaultdict(list)
    for prefix in nodes:
        if prefix:
            kids[prefix[:-1]].append(prefix)
    out = []
    sums = {}
    for prefix in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[prefix]) - 1) * len(prefix[-1][1].encode()) if prefix else 0
        below = [sums[k] for k in kids[prefix]]
        sums[prefix] = (sum(x for x, _ in below) or 1, own + sum(y for _, y in below))
        ends = ",".join(map(str, sorted(c for c in nodes[prefix] if whole[c] == prefix)))
        parent = min(nodes[prefix[:-1]]) if prefix else None
        out.append((min(nodes[prefix]), len(prefix), parent, len(nodes[prefix]), len(kids[prefix]), *sums[prefix], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant"]), f"text {rng.randrange(3)}", 1, 2) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(c, t, "user", f"same {t}", 1, 2) for c in range(100, 160) for t in range(6)]  # copies
    rows += [(200, t, "user", "long" if t % 2 else None, 1, 2) for t in range(900)] + [(205, t, "user", "long" if t % 2 else "", 1, 2) for t in range(880)]
    rows += [(-3, 0, "user", "negative", 1, 2), (-5, 0, "user", "é" * 9, 1, 2), (-5, 1, None, None, 1, 2), (301, 0, "user", "base is absent", 1, 2), (302, None, "z", "null turn", 1, 2), (302, 0, "a", "x", 1, 2)]
    rows += [(303, 1, "user", "tie", 1, 2), (303, 1, "user", "tie", 1, 2), (303, 1, "a", "tie", 1, 2), (None, 0, "user", "no id", 1, 2), (310, 0, "us:er", "1", 1, 2), (315, 0, "us", "er:1", 1, 2)]
    return rows


def rows_of(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def test_large_and_local_buckets_give_the_plain_trie(spark):
    rows = conversations()
    seqs = P.rebuilt(P.encoded_turns(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    want = plain(rows)
    assert rows_of(P.trie(seqs, local_rows=40)) == want  # several rounds, long common stretches, nodes with many ends
    assert rows_of(P.trie(seqs)) == want


def test_query_matches_its_sql_and_the_plain_trie(spark, tmp_path):
    rows = conversations()
    spark.createDataFrame(rows, SCHEMA).drop("b", "n").write.parquet(str(tmp_path / "conversations.parquet"))
    got = rows_of(P.op11_prefix_trie(spark, str(tmp_path)))
    assert got == plain(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(P.OP11_SQL).fetchall()
    assert sorted(map(tuple, want), key=str) == got


def test_empty_table_and_all_null_columns(spark, tmp_path):
    for k, rows in enumerate([[], [(None, None, None, None)], [(5, None, None, None), (5, None, None, None)]]):
        path = tmp_path / str(k)
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(path / "conversations.parquet"))
        assert rows_of(P.op11_prefix_trie(spark, str(path))) == plain(rows)


def test_ends_of_a_node_are_digested_in_order_over_many_runs(spark):
    ids = list(range(-5, 9000))
    ends = spark.createDataFrame(pd.DataFrame({"depth": 1, "conv": 7, "c": ids})).repartition(5)
    want = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert [tuple(r) for r in P.digests(ends).collect()] == [(1, 7, want)]


def test_head_length_is_the_unsigned_crc(spark):
    ids = [0, 7, -1, 123456789, -(2**40)]
    got = spark.createDataFrame([(i,) for i in ids], "c long").select(P.head_length(F.col("c"))).collect()
    assert [r[0] for r in got] == [zlib.crc32(str(i).encode()) % 9 for i in ids]
