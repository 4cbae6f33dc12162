import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentloom.operators import attributions as A
from talentloom.operators import learning

FEATURES = ["a", "b", "c", "d"]


def expected(nodes, x, known, at=0):
    """What a tree says of x when only `known` features are known, by walking it."""
    node = next(n for n in nodes if n["id"] == at)
    if node["feature"] < 0:
        return node["value"]
    cover = {n["id"]: n["cover"] for n in nodes}
    if node["feature"] in known:
        return expected(nodes, x, known, node["left"] if x[node["feature"]] <= node["threshold"] else node["right"])
    left, right = cover[node["left"]], cover[node["right"]]
    return (left * expected(nodes, x, known, node["left"]) + right * expected(nodes, x, known, node["right"])) / (left + right)


def subsets(nodes, x, m=4):
    out = []
    for i in range(m):
        others = [j for j in range(m) if j != i]
        value = 0.0
        for k in range(m):
            for s in combinations(others, k):
                weight = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                value += weight * (expected(nodes, x, {*s, i}) - expected(nodes, x, set(s)))
        out.append(value)
    return out


def random_tree(rng, depth=5):
    nodes = []

    def grow(cover, left):
        node = {"id": len(nodes), "feature": -1, "value": rng.uniform(-1, 1), "cover": cover}
        nodes.append(node)
        if left and cover > 1 and rng.random() < 0.9:
            part = rng.randrange(1, cover)
            node |= {"feature": rng.randrange(4), "threshold": rng.random()}
            node["left"], node["right"] = grow(part, left - 1), grow(cover - part, left - 1)
        return node["id"]

    grow(1000, depth)
    return nodes


def test_values_equal_all_subsets_of_four_features():
    rng = random.Random(3)
    for _ in range(25):
        nodes = random_tree(rng)
        paths = A.leaf_paths(nodes)
        x = np.random.default_rng(rng.randrange(99)).random((6, 4))
        x[0, 2] = math.nan  # goes right
        got = A.shapley_values(paths, x)
        assert np.allclose(got, [subsets(nodes, row) for row in x], atol=1e-12)
        assert np.allclose(A.base_value(paths) + got.sum(axis=1), [expected(nodes, row, {0, 1, 2, 3}) for row in x])


def test_a_path_without_rows_and_a_single_leaf():
    assert A.shapley_values(A.leaf_paths([{"id": 0, "feature": -1, "value": 2.0, "cover": 5}]), np.ones((3, 2))).tolist() == [[0, 0]] * 3
    empty = [{"id": 0, "feature": 0, "threshold": 0.0, "left": 1, "right": 2, "cover": 0, "value": 0}, {"id": 1, "feature": -1, "value": 1.0, "cover": 0}, {"id": 2, "feature": -1, "value": 3.0, "cover": 0}]
    assert A.base_value(A.leaf_paths(empty)) == 0.0


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_base_and_attributions_add_up_to_the_models_score(spark, kind):
    rng = random.Random(1)
    rows = [(i, *(rng.random() for _ in FEATURES)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double").withColumn("y", (F.col("a") + F.col("b") * F.col("c") > 0.8).cast("int"))
    model = learning.models(FEATURES, "y", trees=5, rounds=6)[kind].fit(learning.balanced(df, "y"))
    told = A.explain(model.transform(df).select("id", *FEATURES, learning.vector_to_array("probability").alias("p")), A.ensemble_paths(model.stages[-1], spark), FEATURES).collect()
    for r in told:
        score = r["_base"] + sum(r["_attributions"])
        probability = score if kind == "forest" else 1 / (1 + math.exp(-2 * score))
        assert abs(probability - r["p"][1]) < 1e-9


def test_reports(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, 5.0, [0.5, -0.25, 0.0]), (2, 0.0, 1.0, 5.0, [-0.5, -0.75, 0.0])], "id int, a double, b double, c double, _attributions array<double>")
    names = ["a", "b", "c"]
    assert [tuple(r) for r in A.global_importance(A.long_form(df, ["id"], names)).orderBy("rank").collect()] == [("a", 0.5, 0.0, 1), ("b", 0.5, -0.5, 2), ("c", 0.0, 0.0, 3)]
    up, down = (A.top_contributions(F.col("_attributions"), names, 1, x) for x in (True, False))
    got = df.orderBy("id").select(up.alias("u"), down.alias("d")).collect()
    assert [[tuple(x) for x in r["u"]] for r in got] == [[("a", 0.5)], []] and [[tuple(x) for x in r["d"]] for r in got] == [[("b", -0.25)], [("b", -0.75)]]
