"""Canonical skills, alignment, recommendations and cards against hand-computed and brute-force expectations."""

import random

import pytest
from pyspark.sql import functions as F

from talentloom.operators import cards, corpus

C = F.col
SCHEMA = "id long, skills array<string>, text string, level string, years double"


@pytest.mark.parametrize(
    ("raw", "skill", "name"),
    [("Next.js", "nextjs", "Next.js"), ("NODE-JS", "nodejs", "Node.js"), ("Postgre_SQL", "postgresql", "PostgreSQL"), ("  ms   Excel ", "excel", "Excel"), ("Power-BI", "power bi", "Power BI"), ("PowerBI", "power bi", "Power BI"),
     ("ci-cd", "ci/cd", "Ci/Cd"), ("scikit-learn", "scikit-learn", "Scikit-Learn"), ("rest api", "rest api", "Rest Api"), ("py", "python", "Python"), ("", "", ""), (None, None, None)],
)
def test_skills(spark, raw, skill, name):
    row = spark.range(1).select(corpus.canonical_skill(F.lit(raw).cast("string")).alias("s")).withColumn("n", corpus.display_skill(C("s"))).first()
    assert (row["s"], row["n"]) == (skill, name)
    if raw and raw != "scikit-learn":
        assert corpus.plain_skill(raw) == skill


def test_nulls_empty_texts_and_repeats(spark):
    rows = [(1, None, None, None, None), (2, [], "", "x", 0.5), (3, [None, "", "Py", "python", "PYTHON"], "we REST here", "jr", 7.0), (3, ["SQL"], None, None, None)]
    got = corpus.candidates(spark.createDataFrame(rows, SCHEMA), "id", "skills", "text", "level", "years").collect()
    assert [r["skills"] for r in got] == [[], [], ["python"], ["sql"]]
    assert got[0]["domains"] == ["unknown"] and got[0]["skills_empty"] and got[0]["years_missing"] and got[0]["seniority"] == "unknown"
    assert got[2]["domains"] == ["backend", "data"] and got[2]["keyword_hits"] == ["python"] and got[2]["seniority"] == "junior"


def test_alignment_of_an_empty_corpus(spark):
    empty = corpus.candidates(spark.createDataFrame([], SCHEMA), "id", "skills", "text", "level", "years")
    got = corpus.job_alignment(empty).collect()
    assert len(got) == len(corpus.TEMPLATES)
    assert {(r["with_any"], r["with_most"], r["corpus_alignment_score"], r["decision"]) for r in got} == {(0, 0, 0.0, "replace")}
    assert corpus.recommended_jobs(empty).count() == 0 and corpus.corpus_counts(empty).count() == 0


def test_alignment_against_brute_force(spark):
    rng = random.Random(5)
    pool = ["Python", "Django", "SQL", "Postgres", "Excel", "PowerBI", "Git", "Docker", "Linux", "AWS", "NLP", "Mongo", "FastAPI", "ETL"]
    people = [(i, rng.sample(pool, rng.randint(0, 9)), rng.choice([None, "", "knows airflow"]), None, None) for i in range(300)]
    corp = corpus.candidates(spark.createDataFrame(people, SCHEMA).repartition(5), "id", "skills", "text", "level", "years")
    jobs = [*corpus.TEMPLATES, ("nothing", "Nothing", "none", 0, [], []), ("one", "One", "data", 1, ["Airflow"], [])]
    got = {r["job_id"]: r for r in corpus.job_alignment(corp, jobs).collect()}
    have = [{corpus.plain_skill(s) for s in p[1]} | ({"airflow"} if p[2] and "airflow" in p[2] else set()) for p in people]
    for j in jobs:
        wanted = [corpus.plain_skill(s) for s in j[4]]
        hits = [sum(w in h for w in wanted) for h in have]
        share = [n / len(wanted) if wanted else 1.0 for n in hits]
        want = [sum(s > 0 for s in share), sum(n >= 2 for n in hits), sum(s >= 0.5 for s in share), sum(s >= 0.8 for s in share)]
        r = got[j[0]]
        assert [r["with_any"], r["with_two"], r["with_half"], r["with_most"]] == want
        assert [f["count"] for f in r["frequencies"]] == [sum(w in h for h in have) for w in wanted]
        assert abs(r["corpus_alignment_score"] - (want[0] * 0.2 + want[2] * 0.4 + want[3] * 0.4) / 300) < 1e-4
    best = corpus.recommended_jobs(corp, jobs).orderBy("position").collect()
    pools = [r["expected_candidate_pool_size"] for r in best]
    assert [r["position"] for r in best] == list(range(1, len(best) + 1)) and pools == sorted(pools, reverse=True)
    assert set(r["job_id"] for r in best) == {k for k, r in got.items() if r["with_half"] > 0}


CARD = "matched array<string>, missing array<string>, coverage double, final_score double, reliability double, risk string, flags array<string>, explanation string, kind string, display_name string"


def test_cards(spark):
    rows = [
        (["FastAPI", "MongoDB"], ["Git"], 0.8, 0.85, 0.5, "HIGH", ["a", "b"], "said", "complete_profile", "Ada Byron"),
        ([], ["A", "B", "C", "REST API"], 0.0, 0.1, None, None, None, " ", "minimal_profile", "Candidate (ID: 4)"),
        (["Docker", "FastAPI"], [], 0.6, 0.76, 0.9, "low", [], None, "unreadable", "Ada Byron"),
    ]
    df = spark.createDataFrame(rows, CARD)
    one, two, three = cards.skill_card(df).collect()
    assert one["verdict"] == "recommended" and one["strengths"] == ["Compétences alignées: FastAPI, MongoDB", "Bonne couverture des must-have", cards.EXPLAINED]
    assert one["weaknesses"] == ["Compétences requises manquantes: Git", cards.LOW_RELIABILITY, "Flag qualité: hallucination_risk=high", "Quality flags: a, b"]
    assert one["interview_focus"] == ["Valider la compétence manquante: Git", cards.ASKED[0][1], cards.ASKED[1][1]]
    assert (two["verdict"], two["strengths"], two["weaknesses"]) == ("not_recommended", [], ["Compétences requises manquantes: A, B, C, REST API"])
    assert two["interview_focus"] == ["Valider la compétence manquante: " + s for s in "ABC"]
    assert three["verdict"] == "review" and three["weaknesses"] == []
    one, two, three = cards.strict_skill_card(df.withColumn("risk", F.lower("risk"))).collect()
    assert one["strengths"][-1] == "Profil complet" and one["weaknesses"] == ["Compétences obligatoires manquantes : Git", cards.STRICT_RISK_SAID["high"]]
    assert one["interview_focus"] == ["Vérifier la compétence manquante : Git", cards.STRICT_ASKED[1][1], cards.STRICT_ASK_FACTS]
    assert two["weaknesses"] == ["Compétences obligatoires manquantes : A, B, C, REST API", cards.STRICT_LOW_COVERAGE, "Profil minimal", cards.STRICT_NAMELESS]
    assert three["verdict"] == "recommended" and three["strengths"][-2:] == [cards.STRICT_LOW_RISK, cards.STRICT_RELIABLE]
    assert three["interview_focus"] == [said for _, said in cards.STRICT_ASKED]
