"""Decision cards: verdicts, strengths, weaknesses and interview focus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_STRENGTHS, MOST_WEAKNESSES, MOST_FOCUS = 3, 4, 3


def verdict(final: Column, coverage: Column) -> Column:
    return F.when((final >= 0.8) & (coverage >= 0.65), "recommended").when(final >= 0.6, "review").otherwise("not_recommended")


def strict_verdict(final: Column, risk: Column) -> Column:
    return F.when((final >= 0.75) & (risk == "low"), "recommended").when(final >= 0.5, "review").otherwise("not_recommended")


def _said(most: int, *pairs: tuple[Column, str]) -> Column:
    return F.slice(F.array_compact(F.array(*[F.when(c, t) for c, t in pairs])), 1, most)


def decision_card(scored: DataFrame) -> DataFrame:
    """scored with verdict, strengths, weaknesses and interview_focus."""
    c = F.col
    weak = _said(MOST_WEAKNESSES, (c("coverage") < 0.6, "required skills missing"), (c("experience") < 0.5, "too little experience"), (c("risk") != "low", "facts to be verified"), (c("alignment") < 0.7, "seniority differs"))
    strong = _said(MOST_STRENGTHS, (c("coverage") >= 0.8, "covers the required skills"), (c("experience") >= 0.8, "experience fits"), (c("reliability") >= 0.8, "reliable profile"))
    out = scored.withColumn("verdict", verdict(c("final_score"), c("coverage"))).withColumn("strengths", strong).withColumn("weaknesses", weak)
    return out.withColumn("interview_focus", F.slice(F.transform("weaknesses", lambda x: F.concat(F.lit("ask about: "), x)), 1, MOST_FOCUS))


# What cards on matched and missing skills say, and the skills that they ask about.
MATCHED, MISSING, CHECK_MISSING = "Compétences alignées: ", "Compétences requises manquantes: ", "Valider la compétence manquante: "
COVERAGE_SAID = [(0.8, "Bonne couverture des must-have"), (0.6, "Couverture partielle acceptable des must-have")]
EXPLAINED = "Explication de matching disponible dans le rapport"
LOW_RELIABILITY, RISK_FLAG, FLAGS = "Flag qualité: reliability_score faible", "Flag qualité: hallucination_risk=", "Quality flags: "
ASKED = [("FastAPI", "Demander un exemple concret d'API FastAPI en production"), ("MongoDB", "Valider la conception de schéma et les index MongoDB")]
STRICT_MATCHED, STRICT_MISSING, STRICT_CHECK = "Compétences correspondantes : ", "Compétences obligatoires manquantes : ", "Vérifier la compétence manquante : "
STRICT_COVERAGE_SAID = [(0.8, "Très bonne couverture des compétences obligatoires"), (0.6, "Couverture correcte des compétences obligatoires")]
STRICT_LOW_RISK, STRICT_COMPLETE, STRICT_RELIABLE = "Risque d’hallucination faible", "Profil complet", "Profil très fiable selon le score de fiabilité"
STRICT_LOW_COVERAGE, STRICT_NAMELESS = "Couverture faible des compétences obligatoires", "Nom candidat absent ou non fiable"
STRICT_RISK_SAID = {"medium": "Profil à vérifier : risque d’hallucination moyen", "high": "Profil risqué : vérification humaine nécessaire"}
STRICT_KIND_SAID = {"partial_profile": "Profil partiel", "minimal_profile": "Profil minimal"}
STRICT_ASKED_MISSING = ("REST API", "Valider l’expérience REST API en pratique")
STRICT_ASKED = [("Docker", "Confirmer l’usage de Docker sur un projet réel"), ("FastAPI", "Demander un exemple concret de projet FastAPI")]
STRICT_ASK_FACTS = "Vérifier manuellement les informations importantes du CV"
PLACEHOLDER = "Candidate (ID:"


def _list(*said: Column) -> Column:
    return F.array_compact(F.array(*said))


def _named(prefix: str, skills: str) -> Column:
    return F.when(F.size(skills) > 0, F.concat(F.lit(prefix), F.array_join(skills, ", ")))


def _tier(value: Column, tiers: list[tuple[float, str]]) -> Column:
    return F.coalesce(*[F.when(value >= at, said) for at, said in tiers])


def _asked(holder: str, asked: list[tuple[str, str]]) -> list[Column]:
    return [F.when(F.array_contains(holder, skill), said) for skill, said in asked]


def _checks(prefix: str, skills: str, *more: Column) -> Column:
    return F.slice(F.concat(F.transform(skills, lambda s: F.concat(F.lit(prefix), s)), _list(*more)), 1, MOST_FOCUS)


def skill_card(rows: DataFrame) -> DataFrame:
    """Cards that name the skills: verdict, at most three strengths, four weaknesses and three matters for an interview.

    rows: matched, missing (arrays of names, not null), coverage, final_score, reliability, risk, flags (array), explanation; null reliability, risk, flags
    and explanation say nothing. Other columns stay.
    """
    c = F.col
    risk = F.lower(c("risk"))
    strong = _list(_named(MATCHED, "matched"), _tier(c("coverage"), COVERAGE_SAID), F.when(F.trim("explanation") != "", EXPLAINED))
    weak = _list(
        _named(MISSING, "missing"), F.when(c("reliability") < 0.9, LOW_RELIABILITY), F.when(risk.isin("medium", "high"), F.concat(F.lit(RISK_FLAG), risk)), _named(FLAGS, "flags"),
    )
    return rows.withColumns({
        "verdict": verdict(c("final_score"), c("coverage")), "strengths": F.slice(strong, 1, MOST_STRENGTHS), "weaknesses": F.slice(weak, 1, MOST_WEAKNESSES),
        "interview_focus": _checks(CHECK_MISSING, "missing", *_asked("matched", ASKED)),
    })


def strict_skill_card(rows: DataFrame) -> DataFrame:
    """Cards of grounded profiles: all strengths and weaknesses, three matters for an interview.

    rows: matched, missing (arrays, not null), coverage, final_score, reliability (or null), risk (low, medium or high), kind, display_name. Other columns stay.
    """
    c = F.col
    pick = lambda column, said: F.coalesce(*[F.when(c(column) == k, v) for k, v in said.items()])
    strong = _list(
        _named(STRICT_MATCHED, "matched"), _tier(c("coverage"), STRICT_COVERAGE_SAID), F.when(c("risk") == "low", STRICT_LOW_RISK), F.when(c("kind") == "complete_profile", STRICT_COMPLETE),
        F.when(c("reliability") >= 0.85, STRICT_RELIABLE),
    )
    weak = _list(
        _named(STRICT_MISSING, "missing"), F.when(c("coverage") < 0.5, STRICT_LOW_COVERAGE), pick("risk", STRICT_RISK_SAID), pick("kind", STRICT_KIND_SAID),
        F.when(c("display_name").contains(PLACEHOLDER), STRICT_NAMELESS),
    )
    more = [*_asked("missing", [STRICT_ASKED_MISSING]), *_asked("matched", STRICT_ASKED), F.when(c("risk") != "low", STRICT_ASK_FACTS)]
    return rows.withColumns({"verdict": strict_verdict(c("final_score"), c("risk")), "strengths": strong, "weaknesses": weak, "interview_focus": _checks(STRICT_CHECK, "missing", *more)})
