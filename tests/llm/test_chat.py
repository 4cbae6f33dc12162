import hashlib
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from talentloom.llm import chat as K

SMALL = "/root/testdata/sf0.001"


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SMALL}/conversations.parquet'")
    df = K.op2_chat(spark, SMALL)
    rel = con.execute(K.OP2_SQL)
    names = [x[0] for x in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(rel.fetchall())


def test_odd_rows(spark, tmp_path):
    rows = [(1, 0, "user", "~1 <|end|>\n[x]"), (1, 1, "assistant", "<|assistant|>\n~"), (1, 1, "assistant", "b"), (2, 0, None, None), (None, 0, "assistant", "é" * 9000), (3, None, "a|>\nb", ""), (3, 2, "assistant", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("msg", F.lit(1)).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in K.op2_chat(spark, str(tmp_path)).collect()}
    odd = "</s>[INST] ok [/INST]"
    sets = {1: [("user", rows[0][3]), ("assistant", rows[1][3]), ("assistant", "b")], 2: [("", "")], None: [("assistant", "é" * 9000)], 3: [("a|>\nb", ""), ("assistant", "")], -1: [("user", odd), ("assistant", odd)]}
    assert set(got) == set(sets)
    for conv, turns in sets.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def tree(spark):
    rows = [("c", 1, None, 1.0), ("c", 2, 1, 5.0), ("c", 3, 1, 2.0), ("c", 4, 2, 0.0), ("c", 5, 3, 9.0), ("c", 6, 3, 1.0), ("d", 1, None, 0.0), ("d", 2, 77, 1.0)]
    rows += [("long", i, i - 1 if i > 1 else None, 1.0) for i in range(1, 41)]
    return spark.createDataFrame([(*r, "assistant" if r[1] % 2 else "user", f"t{r[1]}") for r in rows], "conv string, msg long, parent long, score double, role string, text string")


def test_best_branch_of_a_tree(spark):
    paths = {}
    for r in K.chosen_paths(tree(spark).select("conv", "msg", "parent", "score"), 2).collect():
        paths.setdefault((r["conv"], r["root"], r["rank"]), []).append((-r["back"], r["msg"]))
    order = {k: [m for _, m in sorted(v)] for k, v in paths.items()}
    assert order["c", 1, 1] == [1, 3, 5] and order["c", 1, 2] == [1, 2, 4]
    assert order["d", 1, 1] == [1] and order["d", 2, 1] == [2]  # two roots are two trees
    assert order["long", 1, 1] == list(range(1, 41)) and len(order) == 5


def test_two_roots_repeated_and_missing_ids(spark):
    rows = [("a", 1, None, 1.0), ("a", 2, 1, 1.0), ("a", 3, None, 9.0), ("a", 4, 3, 9.0), ("a", 4, 3, 9.0), ("a", 4, 1, 5.0), ("a", None, 1, 1.0)]
    df = spark.createDataFrame([(*r, "assistant", f"t{r[1]}") for r in rows], "conv string, msg long, parent long, score double, role string, text string")
    got = sorted(r["formatted"].replace("<|assistant|>\n", "").split("<|end|>\n")[:-1] for r in K.format_chats(df).collect())
    assert got == [["t1", "t4"], ["t3"]]  # of the rows of id 4 that with the least parent


def test_formatted_spans(spark):
    rows = {r["conv"]: r for r in K.format_chats(tree(spark)).collect()}
    chat = rows["c"]
    assert chat["formatted"] == "<|assistant|>\nt1<|end|>\n<|assistant|>\nt3<|end|>\n<|assistant|>\nt5<|end|>\n"
    assert [chat["formatted"][s["start"] : s["start"] + s["length"]] for s in chat["loss_spans"]] == ["t1", "t3", "t5"]


def test_spans_across_chunks_and_wide_characters(spark):
    text = "".join(chr(0x1F600 + i % 50) if i % 7 == 0 else chr(97 + i % 26) for i in range(3 * K.CHUNK + 5)) + "\n" * 40
    cuts = [(0, 1), (0, 0), (K.CHUNK - 1, 2), (K.CHUNK, K.CHUNK), (5, 3 * K.CHUNK), (len(text) - 3, 3), (0, len(text)), (len(text), 0)]
    df = spark.createDataFrame([(text, [dict(start=a, length=n) for a, n in cuts])], "t string, s array<struct<start: long, length: long>>")
    got = df.select(K.spans_of(F.col("t"), F.col("s")).alias("x")).first()["x"]
    assert got == [text[a : a + n] for a, n in cuts]


def test_long_conversation_is_read_in_proportion(spark, tmp_path):
    """20,000 turns of one conversation and one text of a million characters."""
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} <[~]> é") for i in range(20_000)] + [(2, 0, "assistant", "ab~<" * 250_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    begun = time.monotonic()
    got = {r["conv_id"]: r for r in K.op2_chat(spark, str(tmp_path)).collect()}
    assert time.monotonic() - begun < 120
    loss = "".join(t for c, _, r, t in rows if r == "assistant" and c == 1)
    assert (got[1]["n_turns"], got[1]["loss_chars"]) == (20_000, len(loss)) and got[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[2]["loss_sha256"] == hashlib.sha256(rows[-1][3].encode()).hexdigest()


def test_no_python_in_the_plan(spark):
    plan = K.op2_chat(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    assert K.format_chats(tree(spark).limit(0)).collect() == []


def test_cycle_gives_no_path(spark):
    rows = spark.createDataFrame([("c", 1, None, 1.0), ("e", 1, 2, 1.0), ("e", 2, 1, 1.0)], "conv string, msg long, parent long, score double")
    with pytest.raises(ValueError, match="cycle"):
        K.chosen_paths(rows).collect()
