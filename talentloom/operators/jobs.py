"""Rule-based structuring of job descriptions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.functions.scoring import round4, seniority
from talentloom.functions.text import alnum_key, distinct_folded_long, sentences

# The vocabulary and cues of the rules.
KNOWN_SKILLS = [
    "Python", "FastAPI", "MongoDB", "PostgreSQL", "SQL", "Machine Learning", "Deep Learning", "Pandas", "NumPy", "Scikit-learn", "TensorFlow", "PyTorch", "React", "TypeScript", "JavaScript", "HTML", "CSS", "Docker",
    "Kubernetes", "CI/CD", "GitHub Actions", "Terraform", "AWS", "Azure", "GCP", "Spark", "Hadoop", "Airflow", "ETL", "Data Modeling", "REST API", "Linux",
]
NICE_CUES = ["nice to have", "plus", "bonus", "preferred", "would be a plus", "good to have"]
DUTY_CUES = ["you will", "you'll", "responsibilities", "mission", "your role", "in this role", "the role involves", "you are responsible for"]
DUTY_VERBS = "^(Build|Design|Develop|Maintain|Collaborate|Implement|Automate) "
SENIORITY_RULES = [("principal", r"\b(principal|head of)\b"), ("lead", r"\b(lead|staff)\b"), ("senior", r"\b(senior|sr\.?)\b"), ("mid", r"\b(mid|intermediate)\b"), ("junior", r"\b(junior|entry level|graduate|intern)\b")]
REMOTE_RULES = [("hybrid", r"\b(hybrid)\b"), ("remote", r"\b(remote|work from home|fully remote)\b"), ("on_site", r"\b(on[- ]site|onsite)\b")]
CONTRACT_RULES = [("internship", r"\b(internship|intern)\b"), ("contract", r"\b(contract|contractor|fixed[- ]term)\b"), ("freelance", r"\b(freelance)\b"), ("part_time", r"\b(part[- ]time)\b"), ("full_time", r"\b(full[- ]time|permanent)\b")]
LANGUAGES = ["English", "French", "Arabic", "German", "Spanish"]
DOMAIN_RULES = [
    ("backend_engineering", r"\b(backend|api|microservices)\b"),
    ("data_science", r"\b(data science|machine learning|ml model)\b"),
    ("frontend_engineering", r"\b(frontend|react|ui|ux)\b"),
    ("devops", r"\b(devops|ci/cd|infrastructure|platform engineering)\b"),
    ("data_engineering", r"\b(data engineer|etl|spark|hadoop|data pipeline)\b"),
]
TITLE_HINT = r"(?i)\b(engineer|developer|scientist|analyst|manager|architect|specialist|intern)\b"
PLACE = r"[A-Z][A-Za-z .-]+(?:,\s*[A-Z][A-Za-z .-]+)?"
LOCATION_PATTERNS = [rf"\bbased in ({PLACE})", rf"(?i)\blocation[:\s]+({PLACE})", rf"\bin ({PLACE})"]
LOCATION_END = r"(?i)\s+(?:and follows|and is|with|for|where)\b.*|\b(?:remote|hybrid|on[- ]site|onsite)\b.*"
YEARS_PATTERNS = [r"(?i)(\d+)\+?\s+years? of experience", r"(?i)minimum of (\d+)\s+years?", r"(?i)at least (\d+)\s+years?"]
#: What a text says wherever the pattern of the same place matches.
YEARS_CUES = ["of experience", "minimum of", "at least"]
INLINE_ENDS = ["Engineer", "Developer", "Scientist", "Analyst", "Architect"]

_GAP, _WORD = r"[ \t\n\r\f\x0B]", r"[^ \t\n\r\f\x0B]"
#: Texts of 25 words and more; the search ends with the 25th.
LONG_ENOUGH = rf"^{_GAP}*+(?:{_WORD}++{_GAP}++){{24}}{_WORD}"


def squeeze(x: Column) -> Column:
    """White space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(x, _GAP + "+", " "))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which a dear value is made once and not for each place where it stands."""
    return F.transform(F.array(value), use)[0]


def found(text: Column, pattern: str) -> Column:
    """The first group where the pattern first matches; null if it doesn't, or if the group is empty."""
    return once(F.regexp_extract(text, pattern, 1), lambda x: F.when(x != "", x))


def any_of(words: list[str], before: str = "", after: str = "") -> str:
    """A pattern for the words in letters of any case, which looks at first letters before anything dearer. before, after: what must stand at their edges."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0].lower(), []).append(re.escape(w[1:]))
    return f"(?i)(?=[{''.join(by)}]){before}(?:{'|'.join(first + '(?:' + '|'.join(rest) + ')' for first, rest in by.items())}){after}"


def mentions(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def spellings(pattern: str) -> list[str]:
    r"""The words of a rule \b(one|or[- ]other\.?)\b; without what may stand behind a word, and without those that hold another word of the rule."""
    words = [x for w in re.fullmatch(r"\\b\((.*)\)\\b", pattern)[1].removesuffix(r"\.?").split("|") for x in ([w.replace("[- ]", c) for c in "- "] if "[- ]" in w else [w])]
    return [w for w in dict.fromkeys(words) if not any(x != w and re.search(rf"\b{x}\b", w) for x in words)]


def cues(text: Column, *rules: list[tuple[str, str]]) -> Column:
    """The words of all rules that stand in a text, in lower case, as often as they stand there: one pass for all of them, so none may begin inside another."""
    words = list(dict.fromkeys(w for rule in rules for _, p in rule for w in spellings(p)))
    return F.transform(F.regexp_extract_all(text, F.lit(any_of(words, r"\b", r"\b")), F.lit(0)), F.lower)


def of_rule(said: Column, pattern: str) -> Column:
    return F.filter(said, lambda x: x.isin(spellings(pattern)))


def first_label(said: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of the first rule of which the cues hold a word; null if none."""
    return F.coalesce(*[F.when(F.size(of_rule(said, p)) > 0, label) for label, p in rules])


def most_frequent(said: Column, rules: list[tuple[str, str]]) -> Column:
    """The label whose words are most of the cues (the first of equals); null if none is."""
    counted = F.array(*[F.struct(F.size(of_rule(said, p)).alias("n"), F.lit(-i).alias("o"), F.lit(label).alias("label")) for i, (label, p) in enumerate(rules)])
    return once(F.array_max(counted), lambda best: F.when(best["n"] > 0, best["label"]))


def skills_in(parts: Column) -> Column:
    """Known skills in the order of the sentences, then of the vocabulary; the few sentences that have any are found first, by one pattern."""
    whole = lambda ks: any_of(ks, r"(?<!\w)", r"(?!\w)")
    having = F.transform(F.filter(parts, lambda s: s.rlike(whole(KNOWN_SKILLS))), lambda s: F.struct(s.alias("s"), F.lower(s).alias("l")))
    hit = lambda p: F.array_compact(F.array(*[F.when(p["l"].contains(k.lower()) & p["s"].rlike(whole([k])), k) for k in KNOWN_SKILLS]))
    return F.array_distinct(F.flatten(F.transform(having, hit)))


def location(text: Column, lowered: Column | None = None) -> Column:
    """The place named by the first pattern that matches, up to where the sentence goes on; null if none or nothing is left."""
    low = F.lower(text) if lowered is None else lowered
    based, named, inside = LOCATION_PATTERNS
    place = F.coalesce(F.when(text.contains("based in "), found(text, based)), F.when(low.contains("location"), found(text, named)), found(text, "(?=in )" + inside))
    place = F.regexp_replace(squeeze(F.regexp_replace(place, r"\.+$", "")), LOCATION_END, "")
    return once(squeeze(F.regexp_replace(place, r"[, ]+$", "")), lambda x: F.when(x != "", x))


def confidence(title: Column, skills: Column, duties: Column, level: Column, years: Column, place: Column, remote: Column, warnings: Column) -> Column:
    """Of a structured job: flags, the number of required skills and the number of warnings."""
    plus = lambda c, x: F.when(c, x).otherwise(0.0)
    score = (
        0.35 + plus(title, 0.15) + F.least(F.lit(0.2), skills * 0.03) + plus(duties, 0.1) + plus(level, 0.05) + plus(years, 0.05) + plus(place, 0.03) + plus(remote, 0.03)
        - F.least(F.lit(0.2), warnings * 0.04)
    )
    return round4(F.least(F.greatest(score, F.lit(0.0)), F.lit(0.99)))


def job_profiles(jobs: DataFrame, text: str = "description") -> DataFrame:
    """jobs with title, skills, duties, years, seniority, domain, location, remote policy, contract, languages, warnings, confidence."""
    t, low = F.col(text), F.col("_job_lower")
    wide = mentions(t, ["  ", "\t", "\r", "\f", "\x0b"])  # else sentences are as squeezed as they come
    parts = F.when(wide, F.filter(F.transform(sentences(t), squeeze), lambda s: s != "")).otherwise(sentences(t))
    parts = F.transform(parts, lambda s: F.struct(s.alias("s"), s.rlike(any_of(NICE_CUES)).alias("nice")))
    texts = lambda keep: F.transform(F.filter("_job_parts", keep), lambda p: p["s"])
    lines = F.transform(F.slice(F.filter(F.split(t, "\n"), lambda s: s.rlike(_WORD)), 1, 3), squeeze)
    line = F.get(F.filter(lines, lambda s: s.rlike(TITLE_HINT) & (F.size(F.split(s, " ")) <= 8)), F.lit(0))
    inline = F.when(mentions(t, INLINE_ENDS), found(t, rf"\b([A-Z][A-Za-z/+ -]{{0,40}}(?:{'|'.join(INLINE_ENDS)}))\b"))
    duty = lambda p: (p["s"].rlike(any_of(DUTY_CUES)) | p["s"].rlike(DUTY_VERBS)) & (F.lower(p["s"]) != "responsibilities")
    years = F.coalesce(*[F.when(low.contains(cue), found(t, p)) for cue, p in zip(YEARS_CUES, YEARS_PATTERNS, strict=True)]).cast("double")
    # what is looked at more than once is a column of its own, so that it is made once for each row and not for each use or each element
    out = jobs.withColumn("_job_lower", F.lower(t)).withColumn("_job_parts", parts).withColumn("_job_line", line)
    out = out.withColumn("job_title", F.coalesce("_job_line", squeeze(inline)))
    out = out.withColumn("required_skills", skills_in(texts(lambda p: ~p["nice"]))).withColumn("nice_to_have_skills", skills_in(texts(lambda p: p["nice"])))
    out = out.withColumn("_job_duties", F.slice(texts(duty), 1, 6)).withColumn("responsibilities", distinct_folded_long(F.col("_job_duties")))
    out = out.withColumn("years_experience_required", years)
    both = F.array_distinct(F.concat(F.coalesce(cues(F.col("job_title"), SENIORITY_RULES), F.array().cast("array<string>")), "_job_cues"))
    out = out.withColumn("_job_cues", cues(t, SENIORITY_RULES, DOMAIN_RULES, REMOTE_RULES, CONTRACT_RULES)).withColumn("_job_level", both).withColumn("_job_said", F.array_distinct("_job_cues"))
    out = out.withColumn("_job_level", first_label(F.col("_job_level"), SENIORITY_RULES)).withColumn("seniority_level", seniority(F.col("_job_level")))
    out = out.withColumn("location", location(t, low))
    out = out.withColumn("domain", most_frequent(F.col("_job_cues"), DOMAIN_RULES)).withColumn("remote_policy", first_label(F.col("_job_said"), REMOTE_RULES))
    out = out.withColumn("contract_type", first_label(F.col("_job_said"), CONTRACT_RULES))
    out = out.withColumn("language_requirements", F.array_compact(F.array(*[F.when(t.rlike(rf"(?i)\b{x}\b"), x) for x in LANGUAGES])))
    warn = F.array_compact(
        F.array(
            F.when(F.col("job_title").isNull(), "missing_job_title_detected"),
            F.when(F.size("required_skills") == 0, "missing_required_skills_signal"),
            F.when(F.size("responsibilities") == 0, "missing_responsibilities_signal"),
            F.when(F.col("seniority_level").isNull(), "missing_seniority_signal"),
            F.when(F.col("years_experience_required").isNull(), "missing_years_experience_signal"),
            F.when(F.col("location").isNull() & F.col("remote_policy").isNull(), "missing_location_or_remote_signal"),
            F.when(~F.coalesce(t.rlike(LONG_ENOUGH), F.lit(False)), "low_information_job_description"),
        )
    )
    out = out.withColumn("warnings", warn)
    has = lambda c: F.col(c).isNotNull()
    # a missing title is named "Unknown Role", which counts as one
    score = confidence(F.lit(True), F.size("required_skills"), F.size("responsibilities") > 0, has("seniority_level"), has("years_experience_required"), has("location"), has("remote_policy"), F.size("warnings"))
    out = out.withColumn("confidence", score)
    out = out.withColumn("job_title", F.coalesce("job_title", F.lit("Unknown Role")))
    return out.withColumn("job_id", alnum_key(F.col("job_title"), "_")).drop("_job_lower", "_job_parts", "_job_line", "_job_duties", "_job_cues", "_job_said", "_job_level")
