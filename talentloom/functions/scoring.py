"""Matching scores as column expressions: coverage, experience, quality, penalties, seniority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentloom.functions.text import fold_accents

# Weights, tiers and factors of the scoring rules.
WEIGHT_SKILLS, WEIGHT_TEXT, WEIGHT_EXPERIENCE, WEIGHT_QUALITY = 0.40, 0.30, 0.20, 0.10
BASE_SHARE, GROUNDED_SHARE = 0.85, 0.15
PENALTY_TIERS = [(0.8, 1.00), (0.6, 0.85), (0.4, 0.65), (0.0, 0.45)]
RISK_MULTIPLIER = {"low": 1.00, "medium": 0.90, "high": 0.70}
KIND_MULTIPLIER = {"complete_profile": 1.00, "partial_profile": 0.95, "minimal_profile": 0.80, "unreadable": 0.65}
KIND_FACTOR = {"complete_profile": 1.00, "partial_profile": 0.88, "minimal_profile": 0.65, "unreadable": 0.35}
RISK_FACTOR = {"low": 1.00, "medium": 0.82, "high": 0.55}
KIND_BONUS = {"complete_profile": 1.0, "partial_profile": 0.75}
ROUTE_BONUS = {"groq_secondary": 1.0, "ollama_local": 0.85}
SENIORITY = ["junior", "mid_level", "senior", "lead", "principal"]
SENIORITY_ALIASES = {
    "junior": ["junior", "jr", "debutant", "entry", "entry level"],
    "mid_level": ["mid", "middle", "mid level", "intermediate", "intermediaire", "confirme"],
    "senior": ["senior", "sr", "experienced", "experimente"],
    "lead": ["lead", "tech lead", "team lead", "staff"],
    "principal": ["principal", "head", "architect", "architecte"],
}
ALIGNMENT = {0: 1.0, 1: 0.85, -1: 0.70, 2: 0.65, -2: 0.40}


def choose(key: Column, table: dict, default: float) -> Column:
    """A literal look-up as a when-chain."""
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def round4(x: Column) -> Column:
    """Four decimals; the nudge makes sums that are decimal ties round up whatever their binary error."""
    return F.round(x + 1e-9, 4)


def share(matched: Column, required: Column, empty: float) -> Column:
    return F.when(required == 0, F.lit(empty)).otherwise(F.round(matched / required, 4))


def skill_score(matched: Column, required: Column) -> Column:
    return share(matched, required, 0.5)


def must_have_coverage(matched: Column, required: Column) -> Column:
    return share(matched, required, 1.0)


def experience_score(years: Column, required: Column, has_experience: Column) -> Column:
    free = F.when(years > 0, 1.0).when(has_experience, 0.4).otherwise(0.0)
    asked = F.when(years <= 0, 0.0).otherwise(F.round(F.least(years / required, F.lit(1.0)), 4))
    return F.when(required.isNull(), free).otherwise(asked)


def profile_quality(reliability: Column, kind: Column, route: Column) -> Column:
    score = 0.5 * F.coalesce(reliability, F.lit(0.0)) + 0.3 * choose(F.lower(kind), KIND_BONUS, 0.5) + 0.2 * choose(F.lower(route), ROUTE_BONUS, 0.7)
    return round4(clip01(score))


def grounded_quality(reliability: Column, kind: Column, risk: Column, nullified: Column, flags: Column) -> Column:
    score = reliability * 0.65 + choose(kind, KIND_FACTOR, 0.75) * 0.20 + choose(risk, RISK_FACTOR, 0.75) * 0.15
    score = score - F.least(nullified * 0.03, F.lit(0.18)) - F.least(flags * 0.015, F.lit(0.10))
    return round4(clip01(score))


def combined(text: Column, skills: Column, experience: Column, quality: Column, grounded: Column) -> Column:
    weighted = WEIGHT_SKILLS * skills + WEIGHT_TEXT * text + WEIGHT_EXPERIENCE * experience + WEIGHT_QUALITY * quality
    return round4(clip01(weighted * BASE_SHARE + grounded * GROUNDED_SHARE))


def penalty_multiplier(coverage: Column) -> Column:
    out = None
    for floor, value in PENALTY_TIERS:
        out = F.when(coverage >= floor, F.lit(value)) if out is None else out.when(coverage >= floor, F.lit(value))
    return out.otherwise(F.lit(PENALTY_TIERS[-1][1]))


def quality_multiplier(risk: Column, kind: Column, weak_name: Column) -> Column:
    name = F.when(~weak_name, 1.0).when(risk == "medium", 0.80).when(risk == "high", 0.72).otherwise(0.85)
    product = choose(risk, RISK_MULTIPLIER, 0.90) * choose(kind, KIND_MULTIPLIER, 0.90) * name
    return round4(F.least(F.greatest(product, F.lit(0.55)), F.lit(1.0)))


def derived_risk(explicit: Column, flags: Column, reliability: Column, kind: Column) -> Column:
    lowered = F.transform(flags, F.lower)
    has = lambda x: F.array_contains(lowered, x)
    ladder = (
        F.when(has("unsupported_fields_nullified") | has("template_detected"), "medium")
        .when(has("high_ocr_noise") & (reliability < 0.85), "medium")
        .when(kind == "minimal_profile", "high")
        .when(reliability < 0.55, "high")
        .when(reliability < 0.8, "medium")
        .otherwise("low")
    )
    return F.when(explicit.isin("low", "medium", "high"), explicit).otherwise(ladder)


def seniority(value: Column) -> Column:
    token = F.regexp_replace(F.lower(F.trim(fold_accents(value))), "[-_]", " ")
    token = F.trim(F.regexp_replace(F.regexp_replace(token, "[^a-z0-9 ]+", " "), " +", " "))
    out = None
    for level, names in SENIORITY_ALIASES.items():
        out = F.when(token.isin(names), level) if out is None else out.when(token.isin(names), level)
    return out


def seniority_rank(level: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(x) for x in SENIORITY]), level) - 1).cast("int")


def seniority_alignment(job: Column, candidate: Column) -> Column:
    a, b = seniority_rank(seniority(job)), seniority_rank(seniority(candidate))
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(choose(b - a, ALIGNMENT, 0.25))


def encoded_risk(value: Column) -> Column:
    text = F.lower(F.trim(value))
    number = text.try_cast("double")
    return F.when(number.isNotNull(), clip01(number)).when(text.isin("medium", "moyen"), 0.5).when(text.isin("high", "eleve", "élevé"), 1.0).otherwise(0.0)


def label_v1(f) -> Column:
    """Rule label 0 to 3; f: name -> column."""
    three = (f("must_have_coverage") >= 0.8) & (f("missing_required_count") <= 1) & (f("experience_match_score") >= 0.7) & (f("seniority_alignment") >= 0.7) & (f("reliability_score") >= 0.7) & (f("hallucination_risk_encoded") <= 0.5)
    two = (f("must_have_coverage") >= 0.6) & (f("missing_required_count") <= 2) & (f("experience_match_score") >= 0.5) & (f("reliability_score") >= 0.6)
    one = (f("must_have_coverage") >= 0.4) | (f("required_skills_overlap") >= 0.4) | (f("vector_similarity") >= 0.4)
    return F.when(three, 3).when(two, 2).when(one, 1).otherwise(0)


def label_v2(f) -> Column:
    three = (f("must_have_coverage") >= 0.8) & (f("missing_required_count") <= 1) & (f("experience_match_score") >= 0.6) & (f("reliability_score") >= 0.6) & (f("hallucination_risk_encoded") <= 0.5)
    two = (f("must_have_coverage") >= 0.6) & (f("missing_required_count") <= 3) & (f("experience_match_score") >= 0.4) & (f("reliability_score") >= 0.5)
    one = (f("must_have_coverage") >= 0.3) & ((f("required_skills_overlap") >= 0.3) | (f("vector_similarity") >= 0.35))
    return F.when(three, 3).when(two, 2).when(one, 1).otherwise(0)


def reliability(supported: Column, checked: Column, confidence: Column, nullified: Column, unsupported: Column) -> Column:
    score = supported / F.greatest(checked, F.lit(1)) * 0.8 + F.coalesce(confidence, F.lit(0.0)) * 0.2 - 0.05 * nullified - 0.08 * unsupported
    return round4(clip01(score))


def profile_kind(score: Column, supported: Column, status: Column) -> Column:
    return F.when(status == "unreadable", "unreadable").when((score >= 0.75) & (supported >= 6), "complete_profile").when((score >= 0.45) & (supported >= 3), "partial_profile").otherwise("minimal_profile")


def unsupported_risk(unsupported: Column) -> Column:
    return F.when(unsupported == 0, "low").when(unsupported <= 2, "medium").otherwise("high")


def alignment(some: Column, half: Column, most: Column) -> Column:
    """How far a corpus serves a job: shares of candidates with any, half and four fifths of the required skills."""
    return F.round(some * 0.2 + half * 0.4 + most * 0.4, 4)


def job_decision(score: Column, pool: Column) -> Column:
    """keep, adjust or replace a job; pool: candidates with four fifths of its skills."""
    return F.when((score >= 0.35) & (pool >= 3), "keep").when(score >= 0.15, "adjust").otherwise("replace")
