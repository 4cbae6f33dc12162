"""Moves between roles against a plain version over random people and jobs."""

import random
import re

from pyspark.sql import functions as F

from talentloom.operators import transfer as T
from talentloom.sources import io

C = F.col
GRAPH = [
    ("Data Analyst", ["SQL", "Excel", "Power BI"], ["Python"], [{"role": "Data Engineer", "condition_skills": ["SQL", "Python", "Git"], "rationale": "why"}, {"role": "Data Engineer", "condition_skills": []}]),
    ("Data Engineer", ["SQL", "Spark", "Node.js"], ["Docker", "sql"], [{"role": "DevOps Engineer", "condition_skills": ["Docker"]}]),
    ("DevOps Engineer", ["Docker", "C++"], [], []),
]
SKILLS = ["sql", "SQL.", "excel", "Power-BI", "python", "Git", "spark", "NodeJS", "node.js", "docker", "c++", "", " ", None]


def plain(x):
    return re.sub(r"[^a-z0-9+#/]+", " ", (x or "").strip().lower().replace(".", "")).strip()


def once(xs):
    seen = {}
    for x in xs or []:
        if plain(x):
            seen.setdefault(plain(x), x)
    return list(seen.values())


def test_roles_named(spark):
    rows = [("Lead data.analyst", None, None, "Data Engineer"), ("Data-Analyst", None, None, "Data Analyst"), ("x", "devops", "data_analyst", "DevOps Engineer"), (None, "", "a_data_analyst", "Data Analyst"), (None, None, None, "Data Analyst"), ("Backend", "ml engineer", "z", "Data Analyst"), ("devops data engineer", "", "", "Data Engineer")]
    rows[0] = ("Lead data.analyst", "data engineer", None, "Data Engineer")
    df = spark.createDataFrame(rows, "t string, d string, j string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", T.target_role(GRAPH, C("t"), C("d"), C("j"))).collect())


def test_graph_of_a_file(spark, tmp_path):
    (tmp_path / "g.yaml").write_text("roles:\n- role: A\n  core_skills: [x]\n  transitions_to:\n  - {role: B, condition_skills: [x, y]}\n- role: B\n  core_skills: [z, y]\n")
    people = spark.createDataFrame([(1, ["X"]), (2, []), (3, None), (4, ["z", "y"])], "id int, skills array<string>").withColumn("role", F.lit("B"))
    got = {r["id"]: r for r in T.role_coverage(people, io.read_graph(str(tmp_path / "g.yaml")), "skills", "role").collect()}
    assert got[1]["transitions"][0]["condition_coverage"] == 0.5 and got[1]["gaps_compensable"] == ["y"]
    assert got[1]["explanation"] == T.COMPENSABLE % ("B", "y") and got[2]["explanation"] == got[3]["explanation"] == T.BLOCKING % ("B", "z, y")
    assert got[4]["explanation"] == T.COVERED % "B" and got[4]["coverage_score"] == 1.0


def test_reports_against_a_plain_version(spark):
    rng = random.Random(11)
    pick = lambda most: rng.choice([None, [rng.choice(SKILLS) for _ in range(rng.randint(0, most))]]) if rng.random() < 0.2 else [rng.choice(SKILLS) for _ in range(rng.randint(0, most))]
    rows = [(i, pick(8), rng.choice(["", None, "data analyst", "DevOps guru"]), "Job", rng.choice(["data engineer", "devops", None]), pick(4), pick(3)) for i in range(250)]
    df = spark.createDataFrame(rows, "id int, skills array<string>, titles string, title string, domain string, required array<string>, nice array<string>").withColumn("job_id", F.lit("j"))
    df = T.with_targets(df, GRAPH, "title", "domain", "job_id", "required", "nice").withColumn("source_role", T.source_role(GRAPH, T.normal_skills(C("skills")), C("titles")))
    got = {r["id"]: r for r in T.reports(df, GRAPH, "skills", "source_role", "required").collect()}
    roles, texts = {r[0]: r for r in GRAPH}, set()
    for i, skills, titles, _, domain, required, nice in rows:
        norms, r = {plain(s) for s in skills or []} - {""}, got[i]
        target = {"data engineer": "Data Engineer", "devops": "DevOps Engineer"}.get(domain, "Data Analyst")
        points = [len(norms & {plain(s) for s in g[1]}) + 0.5 * len(norms & {plain(s) for s in g[2]}) + (plain(g[0]) in plain(titles)) + any(a in plain(titles) for a, of in T.ROLE_ALIASES.items() if of == g[0]) for g in GRAPH]
        source = GRAPH[points.index(max(points))][0]
        assert (r["target_role"], r["source_role"]) == (target, source)
        core, near = once([*roles[target][1], *(required or [])]), once([*roles[target][2], *(nice or [])])
        fit = sum(plain(s) in norms for s in required or []) / len(required) if required else 0.0
        ways = [w for w in roles[source][3] if w["role"] == target and norms & {plain(s) for s in w["condition_skills"]}]
        best = max((round(sum(plain(s) in norms for s in w["condition_skills"]) / len(w["condition_skills"]), 4) for w in ways), default=0.0)
        helps = {plain(s) for s in near} | {plain(s) for w in ways for s in w["condition_skills"]}
        missing = [s for s in core if plain(s) not in norms]
        assert r["missing_core"] == missing and len(r["transitions"]) == len(ways)
        assert r["gaps_compensable"] == [s for s in missing if plain(s) in helps] and r["gaps_blocking"] == [s for s in missing if plain(s) not in helps]
        share = lambda xs: sum(plain(s) in norms for s in xs) / len(xs) if xs else 0.0
        score = min(max(0.55 * share(core) + 0.2 * share(near) + 0.15 * best - 0.1 * len(r["gaps_blocking"]) / max(len(core), 1), 0.0), 1.0)
        assert abs(r["transferability_score"] - score) < 1e-4 and abs(r["direct_fit_score"] - fit) < 1e-4 and r["fit_direct"] == (fit >= 0.7)
        kind = "direct" if fit >= 0.7 else "blocked" if r["gaps_blocking"] else "open"
        said = {"direct": T.DIRECT % (target, f"{fit:.2f}", f"{score:.2f}"), "blocked": T.BLOCKED % (source, target, ", ".join(r["gaps_blocking"])), "open": T.OPEN % (source, target, f"{score:.2f}")}[kind]
        assert r["explanation"] == said
        texts.add(kind)
    assert texts == {"direct", "blocked", "open"}


def test_plans_hold_no_work_for_each_stated_role(spark, capsys):
    """F8, F10: rows look up what the graph states; a larger graph brings values into the plan, no more texts to normalise."""

    def texts(n):
        graph = [(f"role {i}", [f"a{i}", f"b{i}"], [f"c{i}"], [{"role": f"role {(i + 1) % n}", "condition_skills": [f"a{i}"]}]) for i in range(n)]
        rows = spark.range(3).select(F.array(C("id").cast("string")).alias("skills"), C("id").cast("string").alias("titles"), F.array(F.lit("a1")).alias("core")).withColumn("role", T.source_role(graph, T.normal_skills(C("skills")), C("titles")))
        pairs = rows.select("skills", "role", C("role").alias("target_role"), C("core").alias("target_core"), C("core").alias("target_adjacent"), C("core").alias("required"))
        capsys.readouterr()
        for df in (T.role_coverage(rows, graph, "skills", "role"), T.reports(pairs, graph, "skills", "role", "required")):
            df.explain("formatted")
        return capsys.readouterr().out.count("regexp_replace")

    assert 0 < texts(9) == texts(3)


def test_skills_of_a_job_and_a_person_are_normalised_once(spark, capsys):
    """each (person, job) row normalised the job's core, adjacent, required and helping skills, and the person's a second time."""
    jobs = spark.createDataFrame([("Data Analyst", None, "j", ["Go.", "sql", None, "GO"], ["R", ""])], "title string, domain string, job_id string, required array<string>, nice array<string>")
    jobs = T.with_targets(jobs, GRAPH, "title", "domain", "job_id", "required", "nice").localCheckpoint()
    people = spark.createDataFrame([(1, ["go", "S.Q.L", " Python"]), (2, None), (3, [None, "", "excel", "r"])], "id int, skills array<string>")
    people = people.select("*", T.normal_skills(C("skills")).alias("norms"), F.lit("Data Analyst").alias("source_role")).localCheckpoint()
    pairs = people.crossJoin(jobs)
    once = T.reports(pairs, GRAPH, "skills", "source_role", "required", "norms")
    again = T.reports(pairs.drop("target_keys"), GRAPH, "skills", "source_role", "required")
    capsys.readouterr()
    once.explain("formatted")
    assert "regexp_replace" not in capsys.readouterr().out
    assert sorted(once.drop("norms").collect()) == sorted(again.drop("norms").collect())
    assert {r["id"]: r["direct_fit_score"] for r in once.collect()} == {1: 0.75, 2: 0.0, 3: 0.0}
