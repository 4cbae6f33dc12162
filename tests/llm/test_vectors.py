import math

import duckdb
import numpy as np
import pytest

from talentloom.llm import collision_search as C
from talentloom.llm import hard_negatives as H
from talentloom.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, v string"


def odd_rows(n=400, dims=16):
    """Random unit vectors with copies, ties, null and broken ones, and columns of clashing names."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, [float(np.float32(v)) for v in x[i]], i % 4) for i in range(n)]
    rows += [(n + i, rows[5][1], i % 4) for i in range(60)]  # copies of one vector
    rows += [(700, None, 1), (701, [], 1), (702, [0.0] * dims, 1), (703, [None, *rows[0][1][1:]], 1), (704, [math.nan, *rows[0][1][1:]], 1), (705, [math.inf, *rows[0][1][1:]], 1)]
    rows += [(None, rows[1][1], 1), (707, rows[2][1], None), (800, rows[3][1], 2), (800, rows[3][1], 2), (810, rows[4][1], 3), (810, rows[4][1], 3), (711, rows[6][1][:5], 1), (712, rows[6][1][:5], 1), (900, rows[7][1][:5], 1)]
    return [(*r, 0.5, 3, "x") for r in rows]


@pytest.fixture()
def folder(spark, tmp_path):
    spark.createDataFrame(odd_rows(), SCHEMA).repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def test_hard_negatives_match_sql(spark, folder):
    got = sorted(tuple(r) for r in H.op12_hard_negatives(spark, folder).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.sql(H.OP12_SQL).fetchall()) and {r[0] for r in got} == {0, 100, 200, 300, 400, 800}


def test_intervals_drop_only_pairs_that_cannot_qualify():
    rng = np.random.default_rng(2)
    for planes in (3, 6, 9):
        span = 1 << (planes - 1)
        anchors, tile = rng.integers(-span, span, (7, 12)), rng.integers(-span, span, (300, 12))
        tile[100:140] = tile[0]
        exact = anchors @ tile.T
        low, high = np.quantile(exact, [0.55, 0.8], axis=1)[0].astype(int)[:, None], np.quantile(exact, 0.95, axis=1).astype(int)[:, None]
        for lo, hi, k in ((low, high, 10), (np.full((7, 1), H.NEVER + 1), np.full((7, 1), -H.NEVER), 5)):
            a, r, s = H.Slices(anchors, planes).survivors(tile, np.ones(exact.shape, bool), lo, hi, np.full((7, 1), H.NEVER), k)
            assert (exact[a, r] == s).all()
            for i in range(7):
                inside = np.flatnonzero((exact[i] >= lo[i]) & (exact[i] <= hi[i]))
                best = inside[np.lexsort((inside, -exact[i, inside]))][:k]
                assert set(best) <= set(r[a == i])
                kept = exact[i, inside].min() if len(inside) < k else exact[i, best[-1]]
                assert {j for j in inside if exact[i, j] == kept} <= set(r[a == i])  # ties with the last stay


def test_many_blocks_and_hard_negatives_of_all_rows(spark, folder, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 40)
    rows = H.materialize(H.integer_vectors(spark.read.parquet(folder + "/embeddings.parquet")), "some")
    few = rows.where("vec_id % 9 = 0")
    monkeypatch.setattr(H, "TILE_ROWS", 64)
    monkeypatch.setattr(H, "TILE_ANCHORS", 8)
    got = sorted(tuple(r) for r in H.hard_negatives(rows, few).collect())
    monkeypatch.undo()
    assert got == sorted(tuple(r) for r in H.hard_negatives(rows, few).collect()) and got


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        H.integer_vectors(spark.createDataFrame([(0, [1e9], 1)], "vec_id long, embedding array<double>, label int")).collect()


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "a" / "embeddings.parquet"))
    spark.createDataFrame([(0, None, None, None, None, None), (None, None, 1, None, None, None)], SCHEMA).write.parquet(str(tmp_path / "b" / "embeddings.parquet"))
    for k in "ab":
        assert H.op12_hard_negatives(spark, str(tmp_path / k)).collect() == [] == C.op13_collision_search(spark, str(tmp_path / k)).collect()


def brute(rows, ask, k=10):
    """Exact neighbours of each query id by all distances."""
    good = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    first = {}
    for i, v in good:
        if ask(i) and (i not in first or v.tolist() < first[i].tolist()):
            first[i] = v
    out = {}
    for q, v in first.items():
        near = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in good if i != q and len(w) == len(v))[:k]
        if near:
            out[q] = near
    return out


def recall(got, want):
    hits = total = 0
    for q, near in want.items():
        left = list(got.get(q, []))
        total += len(near)
        for far, i in near:
            at = next((x for x in left if x[1] == i and abs(x[0] - far) < 1e-9), None)
            if at:
                left.remove(at)
                hits += 1
    return hits / total


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    for near in out.values():
        assert near == sorted(near)
    return out


def test_collision_search_recall_and_exact_scores(spark, folder):
    want = brute(odd_rows(), lambda i: i % 100 == 0)
    got = found(C.op13_collision_search(spark, folder))
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    assert recall(got, want) >= 0.9


def test_recall_over_given_vectors(spark):
    """A hundred of the given table's rows ask: well above 0.9 of their true neighbours are found."""
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(C.nearest(C.build_index(table), table.where("vec_id % 5 = 0")))
    assert recall(got, brute(rows, lambda i: i % 5 == 0)) >= 0.95


def test_a_vector_within_the_radius_reaches_the_threshold():
    p = math.erf(C.HALF / math.sqrt(2))
    need, rng = C.threshold(), np.random.default_rng(1)
    assert (rng.binomial(C.HASHES, p, 100_000) >= need).mean() >= C.SURE - 0.002
    assert 0 < need < C.HASHES


def test_copies_of_one_vector_and_few_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(3000)] + [(5000, [1.0, 2.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(2)
    got = found(C.nearest(C.build_index(table), table.where("vec_id in (0, 5000)")))
    assert got[0] == [(0.0, i) for i in range(1, 11)] and got[5000] == [(0.5, i) for i in range(10)]
    small = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert found(C.nearest(C.build_index(small), small.where("vec_id = 0"))) == {0: [(0.0, 1), (0.0, 2)]}
