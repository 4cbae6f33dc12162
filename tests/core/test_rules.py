"""Rules against hand-computed expectations."""

import threading

import pytest
from pyspark.sql import functions as F

from talentloom.functions import dates, names, quality, scoring, text
from talentloom.operators import graph, jobs, learning, metrics, ocr, topk, windows
from talentloom.operators import resolve as R

C = F.col


def one(spark, col, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_"))
    return row.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"), [(None, 0), ("LOW", 0), ("faible", 0), ("medium", 0.5), ("moyen", 0.5), ("HIGH", 1), ("élevé", 1), ("1.5", 1), ("-0.2", 0)]
)
def test_risk_encoding(spark, raw, want):
    assert one(spark, scoring.encoded_risk(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("jr", "junior"), ("débutant", "junior"), ("mid", "mid_level"), ("intermédiaire", "mid_level"), ("Confirmé", "mid_level"), ("sr", "senior"), ("expérimenté", "senior"), ("tech-lead", "lead"), ("architecte", "principal"), ("unknown", None), (None, None)],
)
def test_seniority(spark, raw, want):
    assert one(spark, scoring.seniority(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(("job", "cand", "want"), [("mid", "mid_level", 1.0), ("mid_level", "senior", 0.85), ("senior", "mid_level", 0.70), (None, "senior", 0.0), ("junior", "principal", 0.25)])
def test_alignment(spark, job, cand, want):
    assert one(spark, scoring.seniority_alignment(F.lit(job).cast("string"), F.lit(cand).cast("string"))) == want


def test_scores(spark):
    lit = F.lit
    assert one(spark, scoring.must_have_coverage(lit(1), lit(2))) == 0.5
    assert one(spark, scoring.skill_score(lit(0), lit(0))) == 0.5
    assert one(spark, scoring.must_have_coverage(lit(0), lit(0))) == 1.0
    assert [one(spark, scoring.penalty_multiplier(lit(c))) for c in (0.8, 0.6, 0.4, 0.39)] == [1.0, 0.85, 0.65, 0.45]
    assert one(spark, scoring.combined(lit(0.5), lit(0.6), lit(1.0), lit(0.9), lit(0.8))) == pytest.approx(0.698)
    assert one(spark, scoring.reliability(lit(8), lit(10), lit(0.9), lit(2), lit(1))) == pytest.approx(0.64)


def features(**over):
    base = {"must_have_coverage": 0.8, "missing_required_count": 1.0, "experience_match_score": 0.6, "seniority_alignment": 0.7, "reliability_score": 0.6, "hallucination_risk_encoded": 0.5, "required_skills_overlap": 0.8, "vector_similarity": 0.5}
    return {**base, **over}


def test_labels(spark):
    label = lambda f, **o: one(spark, f(lambda k: F.lit(features(**o)[k])))
    assert label(scoring.label_v2) == 3
    assert label(scoring.label_v2, must_have_coverage=0.2, required_skills_overlap=0.9, vector_similarity=0.9) == 0
    assert label(scoring.label_v1) == 2
    assert label(scoring.label_v1, experience_match_score=0.7, reliability_score=0.7) == 3


@pytest.mark.parametrize(("raw", "want"), [("5+", 5), ("3-5", 4), ("10 ans", 10), ("2020 - 2022", 2), ("present", None), (None, None), ("", None)])
def test_experience_text(spark, raw, want):
    assert one(spark, dates.experience_value(F.lit(raw).cast("string"))) == want


def test_skills_and_ids(spark):
    assert [one(spark, text.normal_skill(F.lit(x))) for x in ("Node.js", "fast-api", "power_bi", "c++", "data mesh")] == ["Node.js", "FastAPI", "PowerBI", "C++", "Data Mesh"]
    assert one(spark, text.graph_skill(F.lit("Node.js"))) == "nodejs"
    assert one(spark, text.stable_id("x", F.lit("a"), F.lit(None), F.lit("b"))) == "x_9abe6de24a87"
    assert one(spark, text.distinct_folded(F.array(F.lit(" A "), F.lit("a"), F.lit(""), F.lit("B")))) == ["A", "B"]


def test_contacts(spark):
    assert one(spark, text.email(F.lit(" A@B.org "))) == "a@b.org"
    assert one(spark, text.email(F.lit("nobody"))) is None
    assert one(spark, text.phone_class(text.phone(F.lit("+1 (269) 555-3296")))) == "weak_or_placeholder"
    assert one(spark, text.phone_class(text.phone(F.lit("+216 71 234 987")))) == "real"
    assert one(spark, text.phone_class(text.phone(F.lit("12")))) == "missing"


def test_names(spark):
    shown = one(spark, names.display_name(F.lit("DATA SCIENTIST"), F.lit(7)))
    assert (shown["name"], shown["quality"]) == ("Candidate (ID: 7)", "weak")
    assert one(spark, names.display_name(F.lit("Ada  Byron"), F.lit(7)))["name"] == "Ada Byron"


def test_handoff(spark):
    lane = lambda s, f: one(spark, quality.handoff(F.lit(s), F.lit(f)))
    assert lane("validated", "pdf")["lane"] == "accepted"
    assert lane("partial", "scans")["repair_reason"] == "ocr_partial_requires_repair"
    assert lane("uncertain", "pdf")["lane"] == "quarantined"
    assert lane("failed", "pdf")["quarantine_reason"] == "failed_document_blocked"
    assert one(spark, quality.handoff(F.lit("validated"), F.lit("pdf"), F.lit(True)))["repair_status"] == "revalidated"


def test_interval_union(spark):
    m = lambda y, k: y * 12 + k
    rows = spark.createDataFrame([(1, m(2018, 1), m(2019, 12)), (1, m(2019, 1), m(2020, 12)), (1, m(2022, 6), m(2022, 8))], "g int, s int, e int")
    got = windows.union_length(rows, "g", "s", "e").first()
    assert (got["total"], got["islands"]) == (39, 2)


def test_ranking_metrics(spark):
    rows = spark.createDataFrame([("j", i, 1.0 - i / 10, r) for i, r in enumerate([0, 1, 0, 1, 0])], "job string, id int, score double, rel int")
    got = metrics.ranking_metrics(rows, "job", "score", "rel", "id", 5).first()
    assert got["precision_at_k"] == pytest.approx(0.4)
    assert got["mrr"] == pytest.approx(0.5)
    assert got["ndcg_at_k"] == pytest.approx(0.650921, abs=1e-5)


def test_auc_with_ties(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "y int, s double")
    assert metrics.roc_auc(rows, "y", "s").first()[0] == pytest.approx(0.625)
    assert metrics.roc_auc(rows.where("y = 1"), "y", "s").first()[0] is None


def test_agreement(spark):
    # gains and losses count only when both models bring ten ranks or more
    cases = [(5, 6, 8, "agreement_high"), (30, 10, 15, "ml_promoted"), (5, 30, 25, "ml_demoted"), (30, 25, 10, "review_needed"), (20, 12, 13, "review_needed"), (12, 2, 2, "ml_promoted"), (1, 5, 5, "review_needed"), (20, 30, 10, "review_needed")]
    assert [one(spark, windows.agreement(F.lit(a), F.lit(b), F.lit(c))) for a, b, c, _ in cases] == [x[3] for x in cases]


def test_paged_route(spark):
    # pages, chars, words, pages with text, pages with images
    cases = [(2, 200, 40, 2, 2, "scanned"), (2, 280, 250, 2, 2, "native"), (1, 39, 8, 0, 0, "scanned"), (4, 320, 60, 2, 0, "hybrid"), (4, 319, 300, 4, 0, "scanned"), (4, 4000, 700, 1, 0, "scanned"), (3, 3000, 200, 3, 3, "native"), (0, 0, 0, 0, 0, "scanned")]
    for *given, route in cases:
        got = one(spark, quality.paged_route(*[F.lit(x) for x in given]))
        assert (got["route"], got["ocr"]) == (route, route != "native") and got["reasons"][0] == f"pages={given[0]}" and len(got["reasons"]) == 7


def test_job_decisions(spark):
    cases = [(0.35, 3, "keep"), (0.35, 2, "adjust"), (0.3499, 9, "adjust"), (0.15, 0, "adjust"), (0.1499, 50, "replace")]
    assert [one(spark, scoring.job_decision(F.lit(a), F.lit(n))) for a, n, _ in cases] == [x[2] for x in cases]
    assert one(spark, scoring.alignment(F.lit(0.5), F.lit(0.25), F.lit(0.125))) == 0.25


def test_job_confidence_and_location(spark):
    yes, no = F.lit(True), F.lit(False)
    assert one(spark, jobs.confidence(yes, F.lit(7), yes, yes, yes, yes, yes, F.lit(0))) == 0.96
    assert one(spark, jobs.confidence(yes, F.lit(2), no, no, no, no, no, F.lit(5))) == 0.36
    assert one(spark, jobs.confidence(no, F.lit(0), no, no, no, no, no, F.lit(9))) == 0.15
    places = [("We are based in Tunis, Tunisia and is growing", "Tunis, Tunisia"), ("Location: paris remote", "paris"), ("You work in Berlin.", "Berlin"), ("nothing here", None), ("based in Lyon with us", "Lyon")]
    assert [one(spark, jobs.location(F.lit(t))) for t, _ in places] == [x[1] for x in places]


def test_source_roles_and_ways(spark):
    roles = graph.role_tables(spark, [("alpha", ["a", "b"], ["c"]), ("beta", ["d"], []), ("gamma", [], [])])
    rows = spark.createDataFrame([(1, ["a", "c"], ""), (2, [], "beta lead"), (3, ["a"], "gamma dev"), (4, [], ""), (5, ["a"], "known beta")], "id long, skills array<string>, titles string")
    got = {r["id"]: (r["source_role"], r["role_score"]) for r in graph.source_role(rows, roles, "id", "skills", "titles", {"dev": "gamma", "known": "beta"}).collect()}
    assert got == {1: ("alpha", 1.5), 2: ("beta", 1.0), 3: ("gamma", 2.0), 4: ("alpha", 0.0), 5: ("beta", 2.0)}
    people = rows.withColumn("source", F.when(F.col("id") == 1, "beta").otherwise("gamma"))
    ways = [("beta", ["a", "x"]), ("beta", ["c"]), ("gamma", ["a", "y", "z"])]
    out = {r["id"]: r for r in graph.transferability(people, "id", "skills", "source", ["a", "b"], ["c", "b"], ["z"], ways).collect()}
    # 1: core 1/3, adjacent 1/2, best way 1.0; b is near, z blocks
    assert out[1]["transferability_score"] == round(0.55 / 3 + 0.2 / 2 + 0.15 - 0.1 / 3, 4) and out[1]["gaps_blocking"] == ["z"]
    # 3: one of three conditions met, which makes z compensable
    assert out[3]["transferability_score"] == round(0.55 / 3 + 0.15 * 0.3333, 4) and sorted(out[3]["gaps_compensable"]) == ["b", "z"]
    assert out[2]["transferability_score"] == 0.0 and out[2]["gaps_blocking"] == ["a", "z"]


def test_name_similarity_and_conflicts(spark):
    pairs = [("ann lee", "ann lee"), ("ann", "ann lee"), ("", "x"), ("ali ben salah", "sara mansour"), ("mohamed trabelsi", "mohammed trabelsi"), ("jean dupont", "dupont jean")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(R.name_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [1.0, 1.0, 1.0] and got[3] < 0.62 and round(got[4], 4) == 0.9697 and round(got[5], 4) == 0.5455
    # keys: two ends near to the least but not to one another; same names; one that differs from all
    rows = [("p", "abcd"), ("p", "abcdxxxx"), ("p", "abcdyyyy"), ("q", "ann lee"), ("q", "ann lee"), ("q", "ann leo"), ("r", "ann lee"), ("r", "zoe kim"), ("s", None), ("s", "x")]
    found = {r["k"]: (r["left"], r["right"]) for r in R.name_conflicts(spark.createDataFrame(rows, "k string, name string"), "k", "name").collect()}
    assert found == {"p": ("abcdxxxx", "abcdyyyy"), "r": ("ann lee", "zoe kim")}


def test_one_group_is_left_out_at_a_time(spark):
    rows = [(g, float(x), float(x % 3), int(x > 5)) for g in ("a", "b", None) for x in range(12)]
    df = spark.createDataFrame(rows, "job string, f double, g double, y int")
    folds = learning.leave_one_group_out(df, ["f", "g"], "y", "job", ("logistic",)).collect()
    assert sorted(r["left_out"] for r in folds) == ["", "a", "b"] and all(r["accuracy"] > 0.9 for r in folds)



def test_folds_are_fitted_at_the_same_time(spark, monkeypatch):
    """fits went one after the other, each of many jobs too short for all cores."""
    both, real = threading.Barrier(2), learning.models

    class Waits:
        def __init__(self, model):
            self.model = model

        def fit(self, train):
            both.wait(60)
            return self.model.fit(train)

    monkeypatch.setattr(learning, "models", lambda *a: {n: Waits(m) for n, m in real(*a).items()})
    df = spark.createDataFrame([(g, float(x), float(x % 3), int(x > 5)) for g in ("a", "b") for x in range(12)], "job string, f double, g double, y int")
    folds = learning.leave_one_group_out(df, ["f", "g"], "y", "job", ("logistic",)).collect()
    assert sorted((r["model"], r["left_out"]) for r in folds) == [("logistic", "a"), ("logistic", "b")] and all(r["accuracy"] > 0.9 for r in folds)


def test_vector_search_refuses_unbounded_queries(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, v array<float>")
    got = topk.vector_topk(v.where("id = 4"), v, 2, "id", "v", "id", "v").orderBy("rank").collect()
    assert [r["match_id"] for r in got] == [4, 3]
    with pytest.raises(ValueError):
        topk.vector_topk(v, v, 2, "id", "v", "id", "v", per_query_limit=3)


def test_word_edits():
    assert ocr.word_edits("a b c".split(), "a x c d".split()) == 2
    assert ocr.word_edits([], ["a"]) == 1
