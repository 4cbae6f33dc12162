"""A corpus of candidates against jobs: skills in canonical form, signals, domains, alignment, recommended jobs, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.functions import scoring as S

# Forms of skills, their names in reports, keywords, words of domains, templates of jobs.
FORMS = {
    "next.js": "nextjs", "next js": "nextjs", "node.js": "nodejs", "node js": "nodejs", "express.js": "expressjs", "express js": "expressjs",
    "postgre sql": "postgresql", "powerbi": "power bi", "ci cd": "ci/cd",
}
ALIASES = {
    "js": "javascript", "ts": "typescript", "py": "python", "mongo": "mongodb", "postgres": "postgresql", "sklearn": "scikit-learn", "scikit learn": "scikit-learn",
    "ms excel": "excel", "microsoft excel": "excel", "microsoft office excel": "excel",
}
NAMES = {
    "nextjs": "Next.js", "nodejs": "Node.js", "expressjs": "Express.js", "javascript": "JavaScript", "typescript": "TypeScript", "mongodb": "MongoDB", "postgresql": "PostgreSQL",
    "sql": "SQL", "fastapi": "FastAPI", "aws": "AWS", "nlp": "NLP", "power bi": "Power BI",
}
KEYWORDS = [
    "Python", "FastAPI", "Django", "Flask", "JavaScript", "TypeScript", "React", "Next.js", "Node.js", "Express.js", "MongoDB", "PostgreSQL", "SQL", "Pandas", "Spark", "Airflow", "Docker",
    "Kubernetes", "Linux", "Git", "AWS", "Machine Learning", "NLP", "Power BI", "Excel",
]
DOMAINS = {
    "backend": ["python", "fastapi", "django", "flask", "java", "spring", "api", "rest", "backend"],
    "frontend": ["react", "nextjs", "next.js", "typescript", "javascript", "html", "css", "frontend"],
    "fullstack": ["fullstack", "full stack", "react", "nodejs", "node.js", "mongodb", "expressjs", "express.js"],
    "data": ["python", "sql", "etl", "pipeline", "pandas", "spark", "airflow", "data"],
    "devops": ["docker", "kubernetes", "linux", "git", "aws", "ci/cd", "devops", "terraform"],
    "machine_learning": ["machine learning", "ml", "scikit", "sklearn", "nlp", "tensorflow", "pytorch"],
    "mobile": ["android", "ios", "flutter", "react native", "kotlin", "swift"],
    "business_intelligence": ["power bi", "tableau", "excel", "business intelligence", "dashboard", "reporting"],
}
#: (job_id, job_title, domain, years, required skills, nice to have); all of them of the middle level.
TEMPLATES = [
    ("backend_python_django_postgresql", "Backend Python Django Developer", "backend", 3, ["Python", "Django", "SQL", "PostgreSQL"], ["REST API", "Docker", "Git", "Linux"]),
    ("data_analyst_python_sql_powerbi", "Data Analyst", "business_intelligence", 2, ["SQL", "Python", "Excel", "Power BI"], ["Pandas", "Dashboard", "Reporting", "Machine Learning"]),
    ("machine_learning_python_nlp", "Machine Learning Engineer", "machine_learning", 3, ["Python", "Machine Learning", "NLP", "SQL"], ["Pandas", "Scikit-learn", "TensorFlow", "Docker"]),
    ("backend_python_fastapi_mongodb_aligned", "Backend Python FastAPI Developer", "backend", 3, ["Python", "FastAPI", "MongoDB", "Git"], ["Docker", "SQL", "Linux", "REST API"]),
    ("devops_linux_docker_git", "DevOps Engineer", "devops", 3, ["Linux", "Docker", "Git", "AWS"], ["Kubernetes", "CI/CD", "Terraform", "Monitoring"]),
    ("data_engineer_python_sql_etl", "Data Engineer", "data", 3, ["Python", "SQL", "ETL", "Data Pipeline"], ["Pandas", "Spark", "Airflow", "Docker"]),
]
JUSTIFICATION = "%d candidats ont au moins une compétence requise, %d couvrent au moins 50%% des compétences, %d couvrent au moins 80%%."

TEMPLATE_SCHEMA = "job_id string, job_title string, domain string, years_experience_required int, required_skills array<string>, nice_to_have_skills array<string>"
C = F.col


def _looked_up(key: Column, values: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def plain_token(x: str) -> str:
    """A stated word in the form that texts are searched for."""
    token = " ".join(x.lower().replace("_", " ").replace("-", " ").split())
    return FORMS.get(token, token)


def plain_skill(x: str) -> str:
    """The canonical form of a stated skill."""
    return ALIASES.get(plain_token(x), plain_token(x))


def canonical_skill(x: Column) -> Column:
    """Lower case, `_` and `-` as spaces, single spaces, known forms and aliases as one."""
    token = F.trim(F.regexp_replace(F.translate(F.lower(x), "_-", "  "), r"[ \t\n\r\f\x0B]+", " "))
    known = {**ALIASES, **{form: plain_skill(form) for form in FORMS}}
    return F.coalesce(_looked_up(token, known), token)


def display_skill(x: Column) -> Column:
    """The name that reports show; where there is none, each run of letters with a capital."""
    runs = F.regexp_extract_all(x, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.coalesce(_looked_up(x, NAMES), F.array_join(F.transform(runs, F.initcap), ""))


def candidates(profiles: DataFrame, key: str, skills: str, text: str, level: str, years: str, keep: list[str] | None = None) -> DataFrame:
    """One row of signals for each profile; nothing is shuffled.

    skills: an array of raw names (null: none; empty ones go); text: whole text; level and years: raw seniority and years, null where unknown. Result: key, skills,
    keyword_hits, skill_signals and domains (sorted arrays), seniority, years_experience, skills_empty, seniority_missing, years_missing, and the columns to keep.
    """
    none, keep = F.array().cast("array<string>"), keep or []
    given = F.filter(F.transform(F.coalesce(C(skills), none), canonical_skill), lambda s: s != "")
    rows = profiles.select(
        C(key), F.array_sort(F.array_distinct(given)).alias("skills"), F.lower(F.coalesce(text, F.lit(""))).alias("_low"),
        F.coalesce(S.seniority(C(level)), F.lit("unknown")).alias("seniority"), C(years).cast("double").alias("years_experience"), *keep,
    )
    said = lambda words: [C("_low").contains(w) for w in dict.fromkeys(words)]
    any_of = lambda tests: F.coalesce(*[F.when(t, True) for t in tests], F.lit(False))
    hit = [F.when(any_of([F.array_contains("skills", plain_skill(k)), *said([k.lower(), plain_skill(k)])]), plain_skill(k)) for k in KEYWORDS]
    rows = rows.withColumn("keyword_hits", F.array_sort(F.array_compact(F.array(*hit))))
    rows = rows.withColumn("skill_signals", F.array_sort(F.array_union("skills", "keyword_hits")))
    named = lambda words: F.arrays_overlap("skill_signals", F.array(*[F.lit(plain_skill(w)) for w in words]))
    found = F.array_compact(F.array(*[F.when(any_of([named(DOMAINS[d]), *said(map(plain_token, DOMAINS[d]))]), d) for d in sorted(DOMAINS)]))
    domains = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown")))
    return rows.select(
        key, "skills", "keyword_hits", "skill_signals", domains.alias("domains"), "seniority", "years_experience", (F.size("skills") == 0).alias("skills_empty"),
        (C("seniority") == "unknown").alias("seniority_missing"), C("years_experience").isNull().alias("years_missing"), *keep,
    )


def templates(spark: SparkSession, jobs: list[tuple] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(jobs, TEMPLATE_SCHEMA)


def job_alignment(corpus: DataFrame, jobs: list[tuple] = TEMPLATES) -> DataFrame:
    """How much of each job's required skills the corpus covers; one pass, counted by job before anything moves.

    jobs: a stated list of rows as in TEMPLATES, with ids of their own; jobs without candidates count none. A job that requires nothing is covered by all.
    frequencies: (skill, count, percentage) in the job's order.
    """
    most = max((len(j[4]) for j in jobs), default=0)
    held = lambda j: F.array(*[F.array_contains("skill_signals", plain_skill(s)) for s in j[4]]).cast("array<int>")
    each = F.array(*[F.struct(F.lit(j[0]).alias("job_id"), held(j).alias("held")) for j in jobs])
    rows = corpus.select(F.explode(each).alias("_j")).select("_j.job_id", "_j.held")
    rows = rows.withColumn("_n", F.aggregate("held", F.lit(0), lambda a, x: a + x))
    rows = rows.withColumn("_share", F.when(F.size("held") == 0, 1.0).otherwise(C("_n") / F.size("held")))
    counted = rows.groupBy("job_id").agg(
        F.count("*").alias("_total"), F.count_if(C("_share") > 0).alias("with_any"), F.count_if(C("_n") >= 2).alias("with_two"), F.count_if(C("_share") >= 0.5).alias("with_half"),
        F.count_if(C("_share") >= 0.8).alias("with_most"), *[F.sum(F.get("held", F.lit(i))).alias(f"_held{i}") for i in range(most)],
    )
    out = templates(corpus.sparkSession, jobs).join(counted, "job_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    total = F.greatest(F.coalesce("_total", F.lit(0)), F.lit(1))
    times = F.array(*[F.coalesce(f"_held{i}", F.lit(0).cast("long")) for i in range(most)]).cast("array<bigint>")
    frequencies = F.transform("required_skills", lambda s, i: F.struct(s.alias("skill"), F.get(times, i).alias("count"), F.round(F.get(times, i) / total * 100, 2).alias("percentage")))
    out = out.select(*[f.split()[0] for f in TEMPLATE_SCHEMA.split(", ")], frequencies.alias("frequencies"), *map(count, ("with_any", "with_two", "with_half", "with_most")), total.alias("_total"))
    score = S.alignment(C("with_any") / C("_total"), C("with_half") / C("_total"), C("with_most") / C("_total"))
    out = out.withColumn("corpus_alignment_score", score)
    return out.withColumn("decision", S.job_decision(C("corpus_alignment_score"), C("with_most"))).drop("_total")


def recommended_jobs(corpus: DataFrame, jobs: list[tuple] = TEMPLATES) -> DataFrame:
    """The jobs that half of the required skills of some candidate cover, with the reason; position counts by pool, ties by the stated order."""
    order = F.array_position(F.array(*[F.lit(j[0]) for j in jobs]), C("job_id"))
    told = F.format_string(JUSTIFICATION, "with_any", "with_half", "with_most")
    rows = job_alignment(corpus, jobs).where("with_half > 0").withColumn("_order", order)
    rows = rows.withColumn("justification", told).withColumnRenamed("with_half", "expected_candidate_pool_size")
    # As many rows as stated jobs: their order is an array of them.
    ranked = rows.agg(F.array_sort(F.collect_list(F.struct(-C("expected_candidate_pool_size"), "_order"))).alias("_ranks"))
    rows = rows.crossJoin(F.broadcast(ranked)).withColumn("position", F.array_position("_ranks", F.struct(-C("expected_candidate_pool_size"), C("_order"))).cast("int"))
    return rows.select("position", "job_id", "job_title", "domain", "years_experience_required", "required_skills", "nice_to_have_skills", "justification", "expected_candidate_pool_size", "corpus_alignment_score")


def corpus_counts(corpus: DataFrame) -> DataFrame:
    """(kind, name, count, percentage) of skills, keywords, domains, seniority, buckets of years and missing fields: one count over all."""
    years = C("years_experience")
    bucket = F.when(years.isNull(), "unknown").when(years < 1, "0-1").when(years < 3, "1-3").when(years < 5, "3-5").otherwise("5+")
    tell = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("name")))
    gone = F.array_compact(F.array(*[F.when(C(c), n) for c, n in (("skills_empty", "skills"), ("seniority_missing", "seniority"), ("years_missing", "years"))]))
    parts = [
        tell("skill", F.transform("skills", display_skill)), tell("keyword", C("keyword_hits")), tell("domain", C("domains")), tell("seniority", F.array("seniority")),
        tell("years", F.array(bucket)), tell("missing", gone), tell("profile", F.array(F.lit("all"))),
    ]
    counted = corpus.select(F.explode(F.concat(*parts)).alias("_p")).groupBy("_p.kind", "_p.name").agg(F.count("*").alias("count"))
    total = counted.where("kind = 'profile'").select(C("count").alias("_total"))  # one row
    return counted.crossJoin(F.broadcast(total)).select("kind", "name", "count", F.round(C("count") / C("_total") * 100, 2).alias("percentage"))
