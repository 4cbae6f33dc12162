import json
import shutil

import numpy as np
import pytest

from talentloom.operators.vector_index import VectorIndex, build

SCHEMA = "id long, v array<double>"


def clustered(n=600, dims=8, groups=12):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((groups, dims)) * 10
    x = centres[np.arange(n) % groups] + rng.standard_normal((n, dims)) * 0.2
    x[n // 2 : n // 2 + 40] = x[n // 2]  # copies: ties by the smaller id
    return [(i * 3, row.tolist()) for i, row in enumerate(x)]


def flat(rows, asked, k):
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    out = []
    for q, v in asked:
        s = np.round(x @ np.array(v), 10)
        out += [(q, int(ids[j]), float(s[j]), r + 1) for r, j in enumerate(np.lexsort((ids, -s))[:k])]
    return sorted(out)


def close(got, want):
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want])


def test_search_equals_a_scan_and_leaves_cells_unread(spark, tmp_path):
    rows = clustered()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    meta = build(df, str(tmp_path / "x"), "id", "v")
    assert meta["rows"] == 600 and meta["cells"] > 10
    index = VectorIndex(spark, str(tmp_path / "x"))
    for k in (1, 7, 55):  # once loaded, searched many times
        found, counts = index.search(df.where("id % 20 = 0"), "id", "v", k)
        close(sorted(tuple(r) for r in found.collect()), flat(rows, [r for r in rows if r[0] % 20 == 0], k))
        assert 0 < counts["read"] < counts["pairs"] / 2
    found, _ = index.search(df.limit(2), "id", "v", 1000)  # more than there are
    assert found.count() == 1200


def test_parts_that_do_not_belong_together_are_errors(spark, tmp_path):
    df = spark.createDataFrame(clustered(60), SCHEMA)
    build(df, str(tmp_path / "a"), "id", "v")
    build(spark.createDataFrame(clustered(59), SCHEMA), str(tmp_path / "b"), "id", "v")
    shutil.rmtree(tmp_path / "a" / "ids")
    shutil.copytree(tmp_path / "b" / "ids", tmp_path / "a" / "ids")
    with pytest.raises(ValueError, match="id map"):
        VectorIndex(spark, str(tmp_path / "a"))
    meta = json.loads(spark.read.text(str(tmp_path / "b" / "meta")).first()[0])
    spark.createDataFrame([(json.dumps(meta | {"dims": 9}),)], "value string").write.mode("overwrite").text(str(tmp_path / "b" / "meta"))
    with pytest.raises(ValueError, match="dimension"):
        VectorIndex(spark, str(tmp_path / "b"))
    build(spark.createDataFrame([(1, [1.0]), (1, [2.0])], SCHEMA), str(tmp_path / "c"), "id", "v")
    with pytest.raises(ValueError, match="distinct"):
        VectorIndex(spark, str(tmp_path / "c"))
    with pytest.raises(ValueError, match="one length"):
        build(spark.createDataFrame([(1, [1.0]), (2, [2.0, 3.0])], SCHEMA), str(tmp_path / "d"), "id", "v")
    with pytest.raises(ValueError, match="missing components"):
        build(spark.createDataFrame([(1, [1.0, None])], SCHEMA), str(tmp_path / "e"), "id", "v")
    build(df, str(tmp_path / "f"), "id", "v")
    with pytest.raises(ValueError, match="query"):
        VectorIndex(spark, str(tmp_path / "f")).search(spark.createDataFrame([(1, [1.0])], SCHEMA), "id", "v", 3)


def test_empty_index_and_rows_without_vectors(spark, tmp_path):
    empty = spark.createDataFrame([(1, None), (None, [1.0])], SCHEMA)
    assert build(empty, str(tmp_path / "x"), "id", "v") == {"rows": 0, "dims": 0, "cells": 0, "left_out": 2}
    found, counts = VectorIndex(spark, str(tmp_path / "x")).search(spark.createDataFrame([(1, [1.0])], SCHEMA), "id", "v", 3)
    assert found.collect() == [] and counts["pairs"] == 0
