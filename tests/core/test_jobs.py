"""Job texts: cues found in one pass are those of each pattern alone, and the plan searches a text a few times only."""

import itertools
import re

from pyspark.sql import functions as F

from talentloom.functions.text import sentences
from talentloom.operators import jobs
from tests.core.test_sql_odd import same, texts

RULES = [jobs.SENIORITY_RULES, jobs.DOMAIN_RULES, jobs.REMOTE_RULES, jobs.CONTRACT_RULES]
ODD = ["", " ", "\t", "\r\n", "\n\n", "  ", ".", ". ", "!\n", "?", "_", "-", "/", " ", "　", "K", "İ", "ı", "ſ", "́", "é", "²", "\U0001f600"]


def odd_texts(spark, words):
    """Each word, in letters of three cases, between odd ends; and all of them in one text."""
    rows = [f"{a}{case(w)}{b}{w}" for (a, b), w, case in zip(itertools.cycle(itertools.product(ODD, ODD)), words * 40, itertools.cycle([str, str.upper, str.title]))]
    return spark.createDataFrame([(t,) for t in [*rows, "".join(rows), None]], "t string")


def test_a_text_is_searched_few_times(spark):
    """patterns over whole texts stood 36 times in the plan, those for duties once more for each duty."""
    p = jobs.job_profiles(spark.createDataFrame([("x",)], "description string")).drop("description", "language_requirements", "job_id")
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\b(?:RLIKE|split|regexp_\w+)\([^(]*?description#", plan)) <= 12
    assert len(re.findall(r"\bsplit\(description#\d+, \\s", plan)) == 2  # two branches of one CASE


def test_no_cue_begins_inside_another():
    words = dict.fromkeys(w for rules in RULES for _, p in rules for w in jobs.spellings(p))
    parts = [re.split("[^a-z]+", w) for w in words]
    assert len(parts) == 48
    for a, b in itertools.product(parts, parts):
        assert b[0] not in a[1:] and (a == b or a[: len(b)] != b)


def test_cues_are_those_of_each_pattern(spark):
    words = [w.removesuffix(r"\.?").replace("[- ]", "-") for rules in RULES for _, p in rules for w in p[3:-3].split("|")]
    t, said = F.col("t"), jobs.cues(F.col("t"), *RULES)
    alone = lambda rules: F.coalesce(*[F.when(t.rlike("(?i)" + p), label) for label, p in rules])
    counts = [F.size(jobs.of_rule(said, p)) == F.regexp_count(t, F.lit("(?i)" + p)) for _, p in jobs.DOMAIN_RULES]
    labels = [jobs.first_label(said, rules).eqNullSafe(alone(rules)) for rules in RULES if rules is not jobs.DOMAIN_RULES]
    rows = odd_texts(spark, words).where("t is not null").select(F.array(*counts, *labels).alias("ok"), alone(jobs.CONTRACT_RULES).alias("contract")).collect()
    assert all(all(r["ok"]) for r in rows) and sum(r["contract"] is not None for r in rows) > 100


def test_skills_are_those_of_each_pattern(spark):
    one = F.array("t")
    alone = F.array_compact(F.array(*[F.when(F.col("t").rlike(rf"(?i)(?<!\w){re.escape(k)}(?!\w)"), k) for k in jobs.KNOWN_SKILLS]))
    rows = odd_texts(spark, jobs.KNOWN_SKILLS).where("t is not null").select(jobs.skills_in(one).alias("got"), alone.alias("want")).collect()
    assert all(r["got"] == r["want"] for r in rows) and sum(len(r["want"]) for r in rows) > 1000


def test_sentences_are_those_of_two_steps(spark):
    steps = F.filter(F.transform(F.split(F.regexp_replace("t", r"([.!?])\s+", "$1\n"), r"\n+"), lambda s: F.trim(s)), lambda s: s != "")
    rows = spark.createDataFrame([("a".join(p) + "b",) for p in itertools.product(ODD[:14], ODD[:14], [".", "", " \n"])] + [(None,)], "t string")
    assert all(r[0] == r[1] for r in rows.select(sentences(F.col("t")), steps).collect())


def test_job_texts_with_wide_spaces(spark, tmp_path):
    """The path for texts with tabs and double spaces, which the tables do not hold."""
    wide = ["Build  a\tb. You  will c!\r\nAt least\t3  years\x0bof Python \x0c. A plus:  REST  API.", "  Senior\t Analyst \n\n\t\n x.  y", "entry  level\nhead\tof it", "a " * 25, " a" * 24, "a\t" * 25]
    same(spark, tmp_path, "job_texts", documents=texts(spark, *wide, None))
