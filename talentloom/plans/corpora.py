"""Corpus analysis and cards on whole document texts with skills put in, each held against SQL that reads the same texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom.functions.names import ROLE_WORDS, SUSPECT_PHRASES, display_name
from talentloom.operators import cards as K
from talentloom.operators import corpus as P
from talentloom.plans.registry import query, table

C = F.col
#: A raw skill is listed where the length of the text leaves this remainder; further words stand behind the text.
RAW = [
    ("Next JS", 3, 0), ("postgres", 4, 1), ("Power-BI", 5, 2), ("ms  excel", 6, 3), ("Python", 2, 0), ("Fast_API", 7, 1), ("FastAPI", 5, 1), ("mongo", 5, 0), ("GIT", 3, 1), ("docker", 4, 2), ("SQL", 3, 2),
    ("Django", 6, 0), ("Linux", 7, 3), ("aws", 8, 5), ("team work", 9, 4), ("CI CD", 10, 4), ("c++", 11, 2),
]
BEHIND = "CASE length(text) % 11 WHEN 0 THEN ' Airflow and Spark.' WHEN 1 THEN ' React, Node.js and Mongo.' WHEN 2 THEN ' Kubernetes on AWS' WHEN 3 THEN ' An NLP pipeline' WHEN 4 THEN ' Express.js, machine learning.' ELSE '' END"
LEVEL = "CASE length(text) % 8 WHEN 0 THEN 'jr' WHEN 1 THEN 'Débutant' WHEN 2 THEN 'mid' WHEN 3 THEN 'Confirmé' WHEN 4 THEN 'SR' WHEN 5 THEN 'Tech Lead' WHEN 6 THEN 'architecte' ELSE 'unknown' END"
YEARS = "CASE WHEN length(text) % 6 = 0 THEN NULL ELSE CAST(length(text) % 13 AS DOUBLE) / 2 END"
HELD = [f"CASE WHEN length(text) % {p} = {r} THEN '{s}' END" for s, p, r in RAW]


def _text(x):
    return "'" + x.replace("'", "''") + "'"


def _texts(xs):
    return "[" + ", ".join(_text(x) for x in xs) + "]"


def _when(x, pairs, otherwise):
    return f"CASE {x} " + " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in pairs.items()) + f" ELSE {otherwise} END"


def _compact(parts):
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


def _contains(words):
    return " OR ".join(f"contains(low, {_text(w)})" for w in dict.fromkeys(words))


_KNOWN = {**P.ALIASES, **{f: P.ALIASES.get(v, v) for f, v in P.FORMS.items()}}
_TOKENS = rf"list_transform({_compact(HELD)}, lambda s: trim(regexp_replace(translate(lower(s), '_-', '  '), '[ \t\n\r\f\x0B]+', ' ', 'g')))"
_HITS = [f"CASE WHEN list_contains(skills, {_text(P.plain_skill(k))}) OR {_contains([k.lower(), P.plain_skill(k)])} THEN {_text(P.plain_skill(k))} END" for k in P.KEYWORDS]
_DOMAINS = [f"CASE WHEN len(list_intersect(signals, {_texts({P.plain_skill(w): 0 for w in ws})})) > 0 OR {_contains(map(P.plain_token, ws))} THEN '{d}' END" for d, ws in sorted(P.DOMAINS.items())]
_LEVELS = "CASE length(text) % 8 WHEN 0 THEN 'junior' WHEN 1 THEN 'junior' WHEN 2 THEN 'mid_level' WHEN 3 THEN 'mid_level' WHEN 4 THEN 'senior' WHEN 5 THEN 'lead' WHEN 6 THEN 'principal' ELSE 'unknown' END"
CORPUS_SQL = f"""told AS (SELECT doc_id, coalesce(lower(text || {BEHIND}), '') AS low, list_sort(list_distinct(list_transform({_TOKENS}, lambda t: {_when("t", _KNOWN, "t")}))) AS skills, {_LEVELS} AS seniority, {YEARS} AS years FROM documents),
hits AS (SELECT *, list_sort({_compact(_HITS)}) AS hits FROM told), sig AS (SELECT *, list_sort(list_distinct(list_concat(skills, hits))) AS signals FROM hits),
dom AS (SELECT *, {_compact(_DOMAINS)} AS found FROM sig), corpus AS (SELECT *, CASE WHEN len(found) > 0 THEN found ELSE ['unknown'] END AS domains FROM dom)"""
_JOBS = ", ".join(f"({i}, {_text(j[0])}, {_text(j[1])}, {_text(j[2])}, {j[3]}, {_texts(j[4])}, {_texts(map(P.plain_skill, j[4]))}, {_texts(j[5])})" for i, j in enumerate(P.TEMPLATES))
ALIGNED_SQL = f"""{CORPUS_SQL}, jobs AS (SELECT * FROM (VALUES {_JOBS}) t(ord, job_id, job_title, domain, years_wanted, required, wanted, nice)),
pairs AS (SELECT ord, job_id, doc_id, required, wanted, list_transform(wanted, lambda w: list_contains(signals, w)) AS held, len(list_intersect(wanted, signals)) AS n FROM corpus CROSS JOIN jobs),
counted AS (SELECT job_id, count(*) AS total, count(*) FILTER (WHERE n > 0) AS with_any, count(*) FILTER (WHERE n >= 2) AS with_two, count(*) FILTER (WHERE n / 4 >= 0.5) AS with_half, count(*) FILTER (WHERE n / 4 >= 0.8) AS with_most,
 [count(*) FILTER (WHERE held[1]), count(*) FILTER (WHERE held[2]), count(*) FILTER (WHERE held[3]), count(*) FILTER (WHERE held[4])] AS times FROM pairs GROUP BY job_id),
aligned AS (SELECT *, round(with_any / total * 0.2 + with_half / total * 0.4 + with_most / total * 0.4, 4) AS score FROM counted JOIN jobs USING (job_id))"""


def corpus(spark, d, keep=None):
    """Documents as candidates, with further columns that expressions tell."""
    keep = keep or {}
    raw = F.expr(f"array_compact(array({', '.join(HELD)}))")
    rows = table(spark, d, "documents").select("doc_id", raw.alias("raw"), F.expr(f"text || {BEHIND}").alias("told"), F.expr(LEVEL).alias("level"), F.expr(YEARS).alias("years"), *[F.expr(e).alias(c) for c, e in keep.items()])
    return P.candidates(rows, "doc_id", "raw", "told", "level", "years", list(keep))


@query("skill_display", rf"""WITH {CORPUS_SQL}, s AS (SELECT doc_id, unnest(skills) AS skill FROM corpus)
SELECT doc_id, skill, {_when("skill", {**P.NAMES, "fast api": "Fast Api", "python": "Python", "excel": "Excel", "git": "Git", "docker": "Docker", "django": "Django", "linux": "Linux", "team work": "Team Work", "ci/cd": "Ci/Cd", "c++": "C++"}, "skill")} AS name FROM s""")
def skill_display(spark, d):
    """Canonical skills with the names that reports show."""
    return corpus(spark, d).select("doc_id", F.explode("skills").alias("skill")).withColumn("name", P.display_skill(C("skill")))


@query("corpus_candidates", f"WITH {CORPUS_SQL} SELECT doc_id, array_to_string(skills, '|') AS skills, array_to_string(hits, '|') AS keyword_hits, array_to_string(signals, '|') AS skill_signals, array_to_string(domains, '|') AS domains, seniority, years AS years_experience, len(skills) = 0 AS skills_empty, seniority = 'unknown' AS seniority_missing, years IS NULL AS years_missing FROM corpus")
def corpus_candidates(spark, d):
    """Signals of each document as a candidate, from its listed skills and its whole text."""
    lists = {c: F.array_join(c, "|") for c in ("skills", "keyword_hits", "skill_signals", "domains")}
    return corpus(spark, d).withColumns(lists)


@query("corpus_job_alignment", f"""WITH {ALIGNED_SQL} SELECT job_id, job_title, domain, with_any, with_two, with_half, with_most, score AS corpus_alignment_score, CASE WHEN score >= 0.35 AND with_most >= 3 THEN 'keep' WHEN score >= 0.15 THEN 'adjust' ELSE 'replace' END AS decision,
 array_to_string(list_transform(required, lambda s, i: s || '=' || CAST(times[i] AS VARCHAR)), '|') AS frequencies FROM aligned""")
def corpus_job_alignment(spark, d):
    told = F.array_join(F.transform("frequencies", lambda f: F.concat(f["skill"], F.lit("="), f["count"].cast("string"))), "|")
    out = P.job_alignment(corpus(spark, d)).withColumn("frequencies", told)
    return out.select("job_id", "job_title", "domain", "with_any", "with_two", "with_half", "with_most", "corpus_alignment_score", "decision", "frequencies")


@query("corpus_recommendations", f"""WITH {ALIGNED_SQL} SELECT CAST(row_number() OVER (ORDER BY with_half DESC, ord) AS INT) AS position, job_id, job_title, domain, CAST(years_wanted AS INT) AS years_wanted, array_to_string(required, '|') AS required, array_to_string(nice, '|') AS nice,
 printf({_text(P.JUSTIFICATION)}, with_any, with_half, with_most) AS justification, with_half AS pool, score FROM aligned WHERE with_half > 0""")
def corpus_recommendations(spark, d):
    """The stated jobs that the corpus can fill, best pool first."""
    out = P.recommended_jobs(corpus(spark, d))
    return out.select(
        "position", "job_id", "job_title", "domain", C("years_experience_required").alias("years_wanted"), F.array_join("required_skills", "|").alias("required"), F.array_join("nice_to_have_skills", "|").alias("nice"),
        "justification", C("expected_candidate_pool_size").alias("pool"), C("corpus_alignment_score").alias("score"),
    )


@query("corpus_counts", f"""WITH {CORPUS_SQL}, parts AS (SELECT 'keyword' AS kind, unnest(hits) AS name FROM corpus UNION ALL SELECT 'domain', unnest(domains) FROM corpus UNION ALL SELECT 'seniority', seniority FROM corpus
 UNION ALL SELECT 'years', CASE WHEN years IS NULL THEN 'unknown' WHEN years < 1 THEN '0-1' WHEN years < 3 THEN '1-3' WHEN years < 5 THEN '3-5' ELSE '5+' END FROM corpus
 UNION ALL SELECT 'missing', 'skills' FROM corpus WHERE len(skills) = 0 UNION ALL SELECT 'missing', 'seniority' FROM corpus WHERE seniority = 'unknown' UNION ALL SELECT 'missing', 'years' FROM corpus WHERE years IS NULL UNION ALL SELECT 'profile', 'all' FROM corpus)
SELECT kind, name, count(*) AS count, round(count(*) / (SELECT count(*) FROM corpus) * 100, 2) AS percentage FROM parts GROUP BY 1, 2""")
def corpus_counts(spark, d):
    """Counts of the corpus report but for skills, which skill_display names."""
    return P.corpus_counts(corpus(spark, d)).where("kind <> 'skill'")


#: What a card rests on besides the skills: a stated job by the length of the text, and attributes of its length.
CARD_PARTS = {
    "reliability": "CASE WHEN length(text) % 9 = 0 THEN NULL ELSE CAST(length(text) * 37 % 101 AS DOUBLE) / 100 END",
    "risk": "CASE length(text) % 4 WHEN 0 THEN 'medium' WHEN 1 THEN 'high' ELSE 'low' END",
    "kind": "CASE length(text) % 5 WHEN 0 THEN 'complete_profile' WHEN 1 THEN 'partial_profile' WHEN 2 THEN 'minimal_profile' ELSE 'unreadable' END",
    "flag": "CASE WHEN length(text) % 7 = 0 THEN 'short lines' END",
    "heading": "CASE WHEN length(text) % 3 = 0 THEN 'RESUME OBJECTIVE' ELSE split_part(split_part(text, '.', 1), ',', 1) END",
    "explanation": "CASE WHEN length(text) % 2 = 0 THEN text END",
    "job": f"coalesce(length(text), 0) % {len(P.TEMPLATES)}",
}


def card_rows(spark, d):
    """Each document's candidate against one stated job: matched and missing skills, coverage, score and attributes."""
    pick = lambda at: F.get(F.array(*[F.array(*[F.lit(s) for s in at(j)]) for j in P.TEMPLATES]), C("job"))
    rows = corpus(spark, d, CARD_PARTS).withColumn("_required", pick(lambda j: j[4]))
    held = lambda s: F.array_contains("skill_signals", P.canonical_skill(s))
    rows = rows.withColumns({"matched": F.filter("_required", held), "missing": F.filter("_required", lambda s: ~held(s)), "flags": F.array_compact(F.array("flag"))})
    rows = rows.withColumn("coverage", F.size("matched") / F.size("_required"))
    score = F.round(0.7 * C("coverage") + 0.3 * F.coalesce("reliability", F.lit(0.0)), 4)
    return rows.withColumns({"final_score": score, "display_name": display_name(C("heading"), C("doc_id"))["name"]})


def _joined(card):
    return card.select("doc_id", "verdict", *[F.array_join(c, "|").alias(c) for c in ("strengths", "weaknesses", "interview_focus")])


_SAID = lambda parts: f"array_to_string({_compact(parts)}, '|')"
_NAMED = lambda prefix, xs: f"CASE WHEN len({xs}) > 0 THEN {_text(prefix)} || array_to_string({xs}, ', ') END"
_TIER = lambda tiers: "CASE " + " ".join(f"WHEN coverage >= {at} THEN {_text(said)}" for at, said in tiers) + " END"
_ASKED = lambda xs, asked: [f"CASE WHEN list_contains({xs}, {_text(s)}) THEN {_text(said)} END" for s, said in asked]
_FOCUS = lambda prefix, more: f"array_to_string(list_concat(list_transform(missing, lambda s: {_text(prefix)} || s), {_compact(more)})[1:3], '|')"
_KEY = "trim(regexp_replace(lower(coalesce(heading, '')), '[^a-z0-9]+', ' ', 'g'))"
_CLEAN = r"nullif(trim(regexp_replace(heading, '[ \t\n\r\f\x0B]+', ' ', 'g')), '')"
CARDS_SQL = f"""{CORPUS_SQL}, parts AS (SELECT doc_id, {", ".join(f"{e} AS {c}" for c, e in CARD_PARTS.items())} FROM documents),
jobs AS (SELECT * FROM (VALUES {_JOBS}) t(ord, job_id, job_title, domain, years_wanted, required, wanted, nice)),
fit AS (SELECT p.*, {_CLEAN} AS clean, {_KEY} AS key, list_filter(required, lambda s, i: list_contains(signals, wanted[i])) AS matched, list_filter(required, lambda s, i: NOT list_contains(signals, wanted[i])) AS missing FROM corpus c JOIN parts p ON c.doc_id = p.doc_id JOIN jobs j ON j.ord = p.job),
named AS (SELECT *, len(matched) / 4 AS coverage, clean IS NULL OR key = '' OR key IN ({", ".join(map(_text, SUSPECT_PHRASES))}) OR contains(key, 'objective') OR contains(key, 'summary') OR (len(list_intersect(string_split(key, ' '), {_texts(ROLE_WORDS)})) > 0 AND len(string_split(key, ' ')) = 1) AS nameless FROM fit),
rated AS (SELECT *, round(0.7 * coverage + 0.3 * coalesce(reliability, 0.0), 4) AS final_score FROM named)"""


@query("skill_cards", f"""WITH {CARDS_SQL} SELECT doc_id, CASE WHEN final_score >= 0.8 AND coverage >= 0.65 THEN 'recommended' WHEN final_score >= 0.6 THEN 'review' ELSE 'not_recommended' END AS verdict,
 {_SAID([_NAMED(K.MATCHED, "matched"), _TIER(K.COVERAGE_SAID), f"CASE WHEN trim(explanation) <> '' THEN {_text(K.EXPLAINED)} END"])} AS strengths,
 {_SAID([_NAMED(K.MISSING, "missing"), f"CASE WHEN reliability < 0.9 THEN {_text(K.LOW_RELIABILITY)} END", f"CASE WHEN risk IN ('medium', 'high') THEN {_text(K.RISK_FLAG)} || risk END", f"{_text(K.FLAGS)} || flag"])} AS weaknesses,
 {_FOCUS(K.CHECK_MISSING, _ASKED("matched", K.ASKED))} AS interview_focus FROM rated""")
def skill_cards(spark, d):
    """Cards that name matched and missing skills, with what to ask."""
    return _joined(K.skill_card(card_rows(spark, d)))


@query("skill_cards_strict", f"""WITH {CARDS_SQL} SELECT doc_id, CASE WHEN final_score >= 0.75 AND risk = 'low' THEN 'recommended' WHEN final_score >= 0.5 THEN 'review' ELSE 'not_recommended' END AS verdict,
 {_SAID([_NAMED(K.STRICT_MATCHED, "matched"), _TIER(K.STRICT_COVERAGE_SAID), f"CASE WHEN risk = 'low' THEN {_text(K.STRICT_LOW_RISK)} END", f"CASE WHEN kind = 'complete_profile' THEN {_text(K.STRICT_COMPLETE)} END", f"CASE WHEN reliability >= 0.85 THEN {_text(K.STRICT_RELIABLE)} END"])} AS strengths,
 {_SAID([_NAMED(K.STRICT_MISSING, "missing"), f"CASE WHEN coverage < 0.5 THEN {_text(K.STRICT_LOW_COVERAGE)} END", _when("risk", K.STRICT_RISK_SAID, "NULL"), _when("kind", K.STRICT_KIND_SAID, "NULL"), f"CASE WHEN nameless THEN {_text(K.STRICT_NAMELESS)} END"])} AS weaknesses,
 {_FOCUS(K.STRICT_CHECK, [*_ASKED("missing", [K.STRICT_ASKED_MISSING]), *_ASKED("matched", K.STRICT_ASKED), f"CASE WHEN risk <> 'low' THEN {_text(K.STRICT_ASK_FACTS)} END"])} AS interview_focus FROM rated""")
def skill_cards_strict(spark, d):
    """Cards of grounded profiles: strengths, weaknesses and what to ask."""
    return _joined(K.strict_skill_card(card_rows(spark, d)))
