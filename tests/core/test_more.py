from pyspark.sql import functions as F

from talentloom import api
from talentloom.operators import learning, provider, rerank
from talentloom.sources import io


def test_provider_chain_and_breaker(spark):
    def limited(text):
        raise RuntimeError("429 rate")

    def picky(text):
        if text == "bad":
            raise ValueError("json")
        return text.upper()

    rows = spark.createDataFrame([(i, "bad" if i == 3 else "t") for i in range(8)], "id int, text string").coalesce(1)
    out = {r["key"]: r for r in provider.extract(rows, "id", "text", [("a", limited), ("b", picky)], attempts=2, saturation=3, pause=lambda s: None).collect()}
    assert out["3"]["error"] == "bad_output" and out["3"]["payload"] is None
    assert all(out[str(i)]["provider"] == "b" and out[str(i)]["payload"] == "T" for i in range(8) if i != 3)
    assert out["7"]["attempts"] == 1  # the saturated provider is left out


def test_role_graph_and_discovery(spark, tmp_path):
    (tmp_path / "g.yaml").write_text("roles:\n- role: A\n  core_skills: [x, y]\n- role: B\n  adjacent_skills: [z]\n")
    assert io.read_graph(str(tmp_path / "g.yaml")) == [("A", ["x", "y"], [], []), ("B", [], ["z"], [])]
    (tmp_path / "b.json").write_text('{"k": 1}')
    path, df = io.first_readable(spark, [str(tmp_path / "none.json"), str(tmp_path / "b.json")])
    assert path.endswith("b.json") and df.first()["k"] == 1


def test_index_graph_and_inventory(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, e array<float>")
    assert io.write_index(v, str(tmp_path / "i"), "id", "e").first().asDict() == {"profiles": 2, "dim": 2, "without_vector": 1}
    assert io.write_graph(v.select("id"), v.select("id"), str(tmp_path / "g")) == {"vertices": 2, "edges": 2}
    got = io.inventory(io.list_files(spark, str(tmp_path), ["parquet"]), [("index", "/i/"), ("graph", "/g/")])
    assert {r["category"] for r in got.collect()} == {"index", "graph"}


def test_api(spark):
    rows = spark.createDataFrame([("j", 1, 10, 0.5), ("j", 2, 11, 0.9), ("k", 3, 12, 0.1)], "job_id string, profile_id int, candidate_id int, final_score double")
    assert api.answer("best?", rows, "j") == "Best for j: 2 (0.90), 1 (0.50)"
    assert api.answer("best?", rows, "zz") == "No candidate for zz."
    assert api.get_candidate(rows, 12).first()["profile_id"] == 3
    assert [r["candidate_id"] for r in api.list_candidates(rows, 1, 1).collect()] == [11]
    assert api.health({"a": rows, "b": rows.limit(0)}) == {"a": True, "b": False}
    assert api.guarded(lambda: 1 / 0, [])[1].startswith("ZeroDivisionError")


def test_rerank_keeps_order_without_a_scorer(spark):
    rows = spark.createDataFrame([("j", 1, 3), ("j", 2, 1), ("j", 3, 2)], "job string, rank int, id int")
    assert [r["id"] for r in rerank.rerank(rows, "job", "rank", None, "id").orderBy("cross_rank").collect()] == [3, 1, 2]
    best = rerank.rerank(rows, "job", "rank", F.col("id").cast("double"), "id").orderBy("cross_rank").first()
    assert best["id"] == 3


def test_features_refuse_labels(spark):
    import pytest

    with pytest.raises(ValueError):
        learning.check_features(["score", "label"])


def test_hash_embedding_is_unit():
    import numpy as np

    assert np.isclose(np.linalg.norm(rerank.hash_embedding("a b c")), 1) and not rerank.hash_embedding("").any()
