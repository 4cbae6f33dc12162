import random
import time

from pyspark.sql import functions as F

from talentloom.functions import repair
from talentloom.operators import resolve as R


def plain_worst(names, least):
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if a not in b and b not in a and (ratio := R.blocks_ratio(a, b)) < least:
                return a, b, ratio
    return None


def test_runs_of_alike_names_hide_no_conflict():
    rng = random.Random(6)
    for _ in range(300):
        stem = "".join(rng.choices("abc", k=rng.randrange(1, 9)))
        names = sorted({stem[: rng.randrange(len(stem) + 1)] + "".join(rng.choices("abxyz ", k=rng.randrange(1, 6))) for _ in range(rng.randrange(2, 12))})
        assert R.worst_pair(names, 0.62) == plain_worst(names, 0.62)
    long = ["a" * 150 + "b" * 100 + str(i) for i in range(4)]
    assert R.worst_pair(sorted(long), 0.62) == plain_worst(sorted(long), 0.62)


def test_a_hundred_thousand_names_under_one_key(spark):
    rows = spark.range(100_000).select(F.lit("k").alias("key"), F.concat(F.lit("maria lopez garcia "), F.col("id").cast("string")).alias("name"))
    start = time.perf_counter()
    assert R.name_conflicts(rows, "key", "name").count() == 0
    assert R.name_conflicts(rows.unionByName(spark.createDataFrame([("k", "zz")], "key string, name string")), "key", "name").count() == 1
    assert time.perf_counter() - start < 60


def test_plan_does_not_grow_with_evidence_types(spark):
    rows = spark.createDataFrame([(i, f"n{i % 2}", *(f"{k}{i % 3}" for k in "abcd")) for i in range(12)], "id long, name string, a string, b string, c string, d string")
    kinds = [("real_email", "a"), ("real_phone", "b"), ("linkedin_url", "c"), ("github_url", "d")]
    out = R.resolve(rows, kinds, "name", "id")
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 10
    assert out.count() == 12


def test_addresses_and_spelled_words(spark):
    cases = {
        "mail a . b @ x . org now": "mail a.b@x.org now",
        "a.b@x.org": "a.b@x.org",
        "see https : / / x.org / a / b?c=1 and more": "see https://x.org/a/b?c=1 and more",
        "HTTP: //www . x.org": "HTTP://www.x.org",
        "github . com / me / it, linkedin.com /in/ x": "github.com/me/it, linkedin.com/in/ x",
        "née@x . fr": "née@x . fr",
        "no @ address": "no @ address",
        "a / b": "a / b",
        "": "",
        "two a@b.c and d @ e . f.": "two a@b.c and d@e.f.",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "x string, want string")
    assert [(r["got"], r["want"]) for r in df.select(repair.repair_addresses(F.col("x")).alias("got"), "want").collect() if r["got"] != r["want"]] == []
    words = {"P y t h o n and S Q L": "Python and SQL", "a b": "a b", "I a m": "Iam", "x " * 20 + "x": "x " * 20 + "x", "é a b c": "é abc"}
    df = spark.createDataFrame(list(words.items()), "x string, want string")
    assert [(r["got"], r["want"]) for r in df.select(repair.join_spaced(F.col("x")).alias("got"), "want").collect() if r["got"] != r["want"]] == []
