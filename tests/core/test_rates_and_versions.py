import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentloom.operators import learning, ocr
from talentloom.sources.versioned import Conflict, VersionedTable


def table_of(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_edit_counts_have_the_fewest_edits_and_fit_the_lengths():
    rng = random.Random(7)
    for _ in range(400):
        a, b = (rng.choices("abcd", k=rng.randrange(0, 30)) for _ in range(2))
        s, lost, added = ocr.edit_counts(a, b)
        assert s + lost + added == table_of(a, b) == ocr.word_edits(a, b)
        assert len(a) - lost + added == len(b) and min(s, lost, added) >= 0


def test_twenty_thousand_words():
    rng = random.Random(1)
    truth = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    said = [("@" if i % 7 == 0 else w) for i, w in enumerate(truth) if i % 10]
    lost = len([i for i in range(20_000) if not i % 10])
    swapped = len([i for i in range(20_000) if i % 10 and i % 7 == 0])
    assert ocr.edit_counts(truth, said) == (swapped, lost, 0)


def test_composed_forms_are_equal(spark):
    df = spark.createDataFrame([("café noir", "café noir"), ("a b", None), (None, "x y"), ("", ""), ("ab", "ac")], "t string, s string")
    rows = df.select(ocr.word_counts(F.col("t"), F.col("s")).alias("c"), ocr.composed_cer("t", "s").alias("cer"), ocr.wer("t", "s").alias("wer")).collect()
    assert [tuple(r["c"]) for r in rows] == [(2, 0, 0, 0, 0.0), (2, 0, 2, 0, 1.0), (0, 0, 0, 2, 2.0), (0, 0, 0, 0, 0.0), (1, 1, 0, 0, 1.0)]
    assert [r["cer"] for r in rows] == [0.0, 1.0, 3.0, 0.0, 0.5] and [r["wer"] for r in rows] == [0.0, 1.0, 2.0, 0.0, 1.0]


SCHEMA = "k long, v string, created_at int, updated_at int"


def test_two_writers_one_wins_and_the_other_merges_again(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = (VersionedTable(spark, path, SCHEMA) for _ in range(2))
    new = lambda *rows: spark.createDataFrame(list(rows), "k long, v string")
    assert one.read().count() == 0 and one.upsert(new((1, "a"), (2, "b")), "k", F.lit(1)) == 0
    parent = two.latest()
    assert one.upsert(new((2, "c"), (3, "d")), "k", F.lit(2)) == 1
    with pytest.raises(Conflict):
        two.commit(two.read(parent), parent)
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2  # the loser's data is gone
    assert two.upsert(new((3, "e")), "k", F.lit(3)) == 2
    assert sorted(map(tuple, one.read().collect())) == [(1, "a", 1, 1), (2, "c", 1, 2), (3, "e", 2, 3)]
    assert sorted(map(tuple, one.read(0).collect())) == [(1, "a", 1, 1), (2, "b", 1, 1)]  # old versions stay whole
    with pytest.raises(ValueError, match="repeated"):
        one.upsert(new((1, "x"), (1, "y")), "k", F.lit(4))


def test_writers_at_the_same_time_lose_no_update(spark, tmp_path):
    path = str(tmp_path / "t")

    def write(i):
        VersionedTable(spark, path, SCHEMA).update(lambda old: old.unionByName(spark.createDataFrame([(i, "x", 1, 1)], SCHEMA)).coalesce(1), tries=10)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    table = VersionedTable(spark, path, SCHEMA)
    assert sorted(r["k"] for r in table.read().collect()) == [0, 1, 2, 3] and table.versions() == [0, 1, 2, 3]


def test_a_manifest_in_writing_is_no_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA)
    table.commit(spark.createDataFrame([(1, "a", 1, 1)], SCHEMA), -1)
    (tmp_path / "t" / "manifest" / "000000000001.json").write_text('{"version": 1, "da')
    assert table.versions() == [0] and table.read().count() == 1


def test_out_of_fold_scores_do_not_see_their_group_and_ranks_follow_them(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"g{i % 3}", float(a), float(b), int(a > 0.5)) for i, (a, b) in enumerate(rng.random((240, 2)))]
    df = spark.createDataFrame(rows, "id long, g string, a double, b double, y int")
    scored = learning.out_of_fold(df, ["a", "b"], "y", "g", ("forest", "boosted"), trees=5, rounds=3).cache()
    assert scored.count() == 480 and scored.groupBy("model", "left_out").count().count() == 6
    flipped = df.withColumn("y", F.when(F.col("g") == "g0", 1 - F.col("y")).otherwise(F.col("y")))  # the left-out group's labels do not matter to its scores
    again = learning.out_of_fold(flipped, ["a", "b"], "y", "g", ("forest",), trees=5, rounds=3).where("g = 'g0'")
    first = {r["id"]: r["ml_score"] for r in scored.where("g = 'g0' and model = 'forest'").collect()}
    assert {r["id"]: r["ml_score"] for r in again.collect()} == first
    told = learning.model_ranks(scored, "g", "id", "b").collect()
    for g in ("g0", "g1", "g2"):
        mine = [r for r in told if r["g"] == g]
        order = sorted(mine, key=lambda r: (-r["forest_score"], r["id"]))
        assert [r["forest_rank"] for r in order] == list(range(1, len(mine) + 1)) and all(r["rank_shift"] == r["base_rank"] - r["forest_rank"] for r in mine)
    with pytest.raises(ValueError, match="groups"):
        learning.folds_of(spark.range(100), "id")
    with pytest.raises(Exception, match="without a model"):
        learning.model_ranks(scored.where("model = 'forest'"), "g", "id", "b").collect()
