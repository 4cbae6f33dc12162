"""Score, penalty, seniority, feature and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom.functions import scoring as S
from talentloom.operators.topk import best_per_group
from talentloom.plans.registry import PROFILES_SQL, profiles, query

C = F.col
COVERAGE_SQL = "CASE WHEN required = 0 THEN 1.0 ELSE round(CAST(matched AS DOUBLE) / required, 4) END"
SKILL_SQL = "CASE WHEN required = 0 THEN 0.5 ELSE round(CAST(matched AS DOUBLE) / required, 4) END"
EXPERIENCE_SQL = "CASE WHEN required_years IS NULL THEN CASE WHEN years > 0 THEN 1.0 WHEN has_experience THEN 0.4 ELSE 0.0 END WHEN years <= 0 THEN 0.0 ELSE round(least(years / required_years, 1.0), 4) END"
QUALITY_SQL = "round(least(greatest(0.5 * reliability + 0.3 * CASE profile_kind WHEN 'complete_profile' THEN 1.0 WHEN 'partial_profile' THEN 0.75 ELSE 0.5 END + 0.2 * CASE route WHEN 'groq_secondary' THEN 1.0 WHEN 'ollama_local' THEN 0.85 ELSE 0.7 END, 0.0), 1.0) + 1e-9, 4)"
GROUNDED_SQL = "round(least(greatest(reliability * CAST(0.65 AS DOUBLE) + CAST(CASE profile_kind WHEN 'complete_profile' THEN 1.0 WHEN 'partial_profile' THEN 0.88 WHEN 'minimal_profile' THEN 0.65 ELSE 0.35 END AS DOUBLE) * CAST(0.20 AS DOUBLE) + CAST(CASE risk WHEN 'low' THEN 1.0 WHEN 'medium' THEN 0.82 ELSE 0.55 END AS DOUBLE) * CAST(0.15 AS DOUBLE) - least(nullified * CAST(0.03 AS DOUBLE), CAST(0.18 AS DOUBLE)) - least(flags * CAST(0.015 AS DOUBLE), CAST(0.10 AS DOUBLE)), 0.0), 1.0) + 1e-9, 4)"
MULTIPLIER_SQL = "CASE WHEN coverage >= 0.8 THEN 1.0 WHEN coverage >= 0.6 THEN 0.85 WHEN coverage >= 0.4 THEN 0.65 ELSE 0.45 END"
QUALITY_MULT_SQL = "round(least(greatest(CAST(CASE risk WHEN 'low' THEN 1.0 WHEN 'medium' THEN 0.9 ELSE 0.7 END AS DOUBLE) * CAST(CASE profile_kind WHEN 'complete_profile' THEN 1.0 WHEN 'partial_profile' THEN 0.95 WHEN 'minimal_profile' THEN 0.8 ELSE 0.65 END AS DOUBLE) * CAST(CASE WHEN NOT weak_name THEN 1.0 WHEN risk = 'medium' THEN 0.8 WHEN risk = 'high' THEN 0.72 ELSE 0.85 END AS DOUBLE), 0.55), 1.0) + 1e-9, 4)"
COMBINED_SQL = "round(least(greatest((CAST(0.40 AS DOUBLE) * skills + CAST(0.30 AS DOUBLE) * similarity + CAST(0.20 AS DOUBLE) * experience + CAST(0.10 AS DOUBLE) * quality) * CAST(0.85 AS DOUBLE) + grounded * CAST(0.15 AS DOUBLE), 0.0), 1.0) + 1e-9, 4)"
NORMAL_SQL = "CASE trim(regexp_replace(strip_accents(lower({0})), '[-_]', ' ', 'g')) WHEN 'jr' THEN 0 WHEN 'debutant' THEN 0 WHEN 'junior' THEN 0 WHEN 'mid' THEN 1 WHEN 'mid level' THEN 1 WHEN 'confirme' THEN 1 WHEN 'sr' THEN 2 WHEN 'senior' THEN 2 WHEN 'tech lead' THEN 3 WHEN 'lead' THEN 3 WHEN 'architecte' THEN 4 WHEN 'principal' THEN 4 END"
ALIGNMENT_SQL = f"CASE ({NORMAL_SQL.format('seniority')}) - ({NORMAL_SQL.format('job_seniority')}) WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 WHEN -1 THEN 0.7 WHEN 2 THEN 0.65 WHEN -2 THEN 0.4 ELSE CASE WHEN ({NORMAL_SQL.format('seniority')}) IS NULL THEN 0.0 ELSE 0.25 END END"
SCORED_SQL = f"""{PROFILES_SQL}, parts AS (
  SELECT *, CAST({SKILL_SQL} AS DOUBLE) AS skills, CAST({COVERAGE_SQL} AS DOUBLE) AS coverage, CAST({EXPERIENCE_SQL} AS DOUBLE) AS experience,
         CAST({QUALITY_SQL} AS DOUBLE) AS quality, {GROUNDED_SQL} AS grounded, CAST({ALIGNMENT_SQL} AS DOUBLE) AS alignment FROM profiles
), scored AS (
  SELECT *, {COMBINED_SQL} AS base_score, CAST({MULTIPLIER_SQL} AS DOUBLE) AS penalty, {QUALITY_MULT_SQL} AS quality_penalty FROM parts
), final AS (
  SELECT *, round(least(greatest(round(base_score * penalty + 1e-9, 4) * quality_penalty, 0.0), 1.0) + 1e-9, 4) AS final_score FROM scored
)"""


def scored(spark, sf_dir):
    """The binding's profiles with all parts of the matching score."""
    p = profiles(spark, sf_dir)
    p = p.select(
        "*",
        S.skill_score(C("matched"), C("required")).alias("skills"),
        S.must_have_coverage(C("matched"), C("required")).alias("coverage"),
        S.experience_score(C("years"), C("required_years"), C("has_experience")).alias("experience"),
        S.profile_quality(C("reliability"), C("profile_kind"), C("route")).alias("quality"),
        S.grounded_quality(C("reliability"), C("profile_kind"), C("risk"), C("nullified"), C("flags")).alias("grounded"),
        S.seniority_alignment(C("job_seniority"), C("seniority")).alias("alignment"),
    )
    p = p.withColumn("base_score", S.combined(C("similarity"), C("skills"), C("experience"), C("quality"), C("grounded")))
    p = p.withColumn("penalty", S.penalty_multiplier(C("coverage"))).withColumn("quality_penalty", S.quality_multiplier(C("risk"), C("profile_kind"), C("weak_name")))
    return p.withColumn("final_score", S.round4(S.clip01(S.round4(C("base_score") * C("penalty")) * C("quality_penalty"))))


def _from_scored(name: str, *columns: str):
    query(name, f"WITH {SCORED_SQL} SELECT profile_id, {', '.join(columns)} FROM final")(lambda spark, d: scored(spark, d).select("profile_id", *columns))


_from_scored("skill_score", "skills")
_from_scored("must_have_coverage", "coverage")
_from_scored("experience_score", "experience")
_from_scored("profile_quality", "quality")
_from_scored("grounded_quality", "grounded")
_from_scored("combined_score", "base_score")
_from_scored("penalty_tiers", "coverage", "penalty")
_from_scored("quality_multiplier", "quality_penalty")
_from_scored("seniority_alignment", "alignment")
_from_scored("score_candidate", "base_score", "penalty", "quality_penalty", "final_score")


@query("derived_risk", f"WITH {PROFILES_SQL} SELECT profile_id, CASE WHEN flags = 1 THEN 'medium' WHEN flags = 2 AND reliability < 0.85 THEN 'medium' WHEN profile_kind = 'minimal_profile' THEN 'high' WHEN reliability < 0.55 THEN 'high' WHEN reliability < 0.8 THEN 'medium' ELSE 'low' END AS derived FROM profiles")
def derived_risk(spark, d):
    flags = F.when(C("flags") == 1, F.array(F.lit("Template_Detected"))).when(C("flags") == 2, F.array(F.lit("high_ocr_noise"))).otherwise(F.array().cast("array<string>"))
    return profiles(spark, d).select("profile_id", S.derived_risk(F.lit(None).cast("string"), flags, C("reliability"), C("profile_kind")).alias("derived"))


@query("risk_encoding", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.5 WHEN 3 THEN 1.0 WHEN 4 THEN 1.0 ELSE 0.0 END AS encoded FROM documents")
def risk_encoding(spark, d):
    from talentloom.plans.registry import table

    raw = F.element_at(F.array(*[F.lit(x) for x in (" LOW ", "moyen", "HIGH", "1.5", "-0.2")]), (C("doc_id") % 6).cast("int"))
    return table(spark, d, "documents").select("doc_id", S.encoded_risk(F.when(C("doc_id") % 6 != 0, raw)).alias("encoded"))


FEATURES_SQL = f"""{SCORED_SQL}, features AS (
  SELECT job_id, candidate_id, profile_id, similarity AS vector_similarity, final_score AS final_score_v3, coverage AS must_have_coverage, coverage AS required_skills_overlap,
         CAST(0.0 AS DOUBLE) AS nice_to_have_overlap, experience AS experience_match_score, alignment AS seniority_alignment, quality AS profile_quality_score, reliability AS reliability_score,
         CAST(CASE risk WHEN 'medium' THEN 0.5 WHEN 'high' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS hallucination_risk_encoded, CAST(required - matched AS DOUBLE) AS missing_required_count, CAST(matched AS DOUBLE) AS matched_required_count FROM final)"""
FEATURES = ["vector_similarity", "final_score_v3", "must_have_coverage", "required_skills_overlap", "nice_to_have_overlap", "experience_match_score", "seniority_alignment", "profile_quality_score", "reliability_score", "hallucination_risk_encoded", "missing_required_count", "matched_required_count"]
V1_SQL = "CASE WHEN must_have_coverage >= 0.8 AND missing_required_count <= 1 AND experience_match_score >= 0.7 AND seniority_alignment >= 0.7 AND reliability_score >= 0.7 AND hallucination_risk_encoded <= 0.5 THEN 3 WHEN must_have_coverage >= 0.6 AND missing_required_count <= 2 AND experience_match_score >= 0.5 AND reliability_score >= 0.6 THEN 2 WHEN must_have_coverage >= 0.4 OR required_skills_overlap >= 0.4 OR vector_similarity >= 0.4 THEN 1 ELSE 0 END"
V2_SQL = "CASE WHEN must_have_coverage >= 0.8 AND missing_required_count <= 1 AND experience_match_score >= 0.6 AND reliability_score >= 0.6 AND hallucination_risk_encoded <= 0.5 THEN 3 WHEN must_have_coverage >= 0.6 AND missing_required_count <= 3 AND experience_match_score >= 0.4 AND reliability_score >= 0.5 THEN 2 WHEN must_have_coverage >= 0.3 AND (required_skills_overlap >= 0.3 OR vector_similarity >= 0.35) THEN 1 ELSE 0 END"


def features(spark, sf_dir):
    """The twelve ranking features of each (job, candidate) row."""
    return scored(spark, sf_dir).select(
        "job_id", "candidate_id", "profile_id",
        C("similarity").alias("vector_similarity"), C("final_score").alias("final_score_v3"), C("coverage").alias("must_have_coverage"), C("coverage").alias("required_skills_overlap"),
        F.lit(0.0).alias("nice_to_have_overlap"), C("experience").alias("experience_match_score"), C("alignment").alias("seniority_alignment"), C("quality").alias("profile_quality_score"),
        C("reliability").alias("reliability_score"), S.encoded_risk(C("risk")).alias("hallucination_risk_encoded"), (C("required") - C("matched")).cast("double").alias("missing_required_count"), C("matched").cast("double").alias("matched_required_count"),
    )


def labelled(spark, sf_dir):
    f = features(spark, sf_dir)
    return f.withColumn("label", S.label_v2(C)).withColumn("label_binary", (C("label") >= 2).cast("int"))


LABELLED_SQL = f"{FEATURES_SQL}, labelled AS (SELECT *, {V2_SQL} AS label, CAST(({V2_SQL}) >= 2 AS INT) AS label_binary FROM features)"


@query("feature_rows", f"WITH {FEATURES_SQL} SELECT * FROM features")
def feature_rows(spark, d):
    return features(spark, d)


@query("pseudo_label_v1", f"WITH {FEATURES_SQL} SELECT profile_id, {V1_SQL} AS label FROM features")
def pseudo_label_v1(spark, d):
    return features(spark, d).select("profile_id", S.label_v1(C).alias("label"))


@query("pseudo_label_v2", f"WITH {LABELLED_SQL} SELECT profile_id, label, label_binary FROM labelled")
def pseudo_label_v2(spark, d):
    return labelled(spark, d).select("profile_id", "label", "label_binary")


@query("label_distribution_rollup", f"WITH {LABELLED_SQL} SELECT job_id, label, count(*) AS n FROM labelled GROUP BY ROLLUP (job_id, label)")
def label_distribution_rollup(spark, d):
    return labelled(spark, d).rollup("job_id", "label").agg(F.count("*").alias("n"))


@query("label_percentages", f"WITH {LABELLED_SQL} SELECT label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent FROM labelled GROUP BY label")
def label_percentages(spark, d):
    rows = labelled(spark, d)
    total = rows.agg(F.count("*").alias("_t"))
    return rows.groupBy("label").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("label", "n", F.round(C("n") * 100 / C("_t"), 2).alias("percent"))


@query("label_positive_rate", f"WITH {LABELLED_SQL} SELECT job_id, count(*) AS n, avg(label_binary) AS positive_rate FROM labelled GROUP BY job_id")
def label_positive_rate(spark, d):
    return labelled(spark, d).groupBy("job_id").agg(F.count("*").alias("n"), F.avg("label_binary").alias("positive_rate"))


@query("label_rule_comparison", f"WITH {FEATURES_SQL} SELECT {V1_SQL} AS label_v1, {V2_SQL} AS label_v2, count(*) AS n FROM features GROUP BY 1, 2")
def label_rule_comparison(spark, d):
    return features(spark, d).groupBy(S.label_v1(C).alias("label_v1"), S.label_v2(C).alias("label_v2")).agg(F.count("*").alias("n"))


@query("dataset_delta", f"""WITH {FEATURES_SQL}, x AS (SELECT sum(CAST(({V1_SQL}) >= 2 AS INT)) AS old_positive, sum(CAST(({V2_SQL}) >= 2 AS INT)) AS new_positive, count(*) AS n FROM features)
SELECT CAST(old_positive AS BIGINT) AS old_positive, CAST(new_positive AS BIGINT) AS new_positive, CAST(new_positive - old_positive AS BIGINT) AS delta, CASE WHEN new_positive > old_positive THEN 'use_new' ELSE 'keep_old' END AS recommendation FROM x""")
def dataset_delta(spark, d):
    one = lambda label: F.sum((label >= 2).cast("long"))
    x = features(spark, d).agg(one(S.label_v1(C)).alias("old_positive"), one(S.label_v2(C)).alias("new_positive"))
    return x.select("*", (C("new_positive") - C("old_positive")).alias("delta"), F.when(C("new_positive") > C("old_positive"), "use_new").otherwise("keep_old").alias("recommendation"))


@query("rank_best_per_entity", f"""WITH {SCORED_SQL} SELECT candidate_id, profile_id, final_score, group_size FROM (
 SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY final_score DESC, grounded DESC, profile_id) AS rn, count(*) OVER (PARTITION BY candidate_id) AS group_size FROM final) WHERE rn = 1""")
def rank_best_per_entity(spark, d):
    order = [F.desc("final_score"), F.desc("grounded"), C("profile_id")]
    return best_per_group(scored(spark, d), F.coalesce(C("candidate_id"), C("profile_id")), order).select("candidate_id", "profile_id", "final_score", "group_size")


@query("coverage_filter_audit", f"WITH {SCORED_SQL} SELECT profile_id, coverage >= 0.6 AS admissible, CASE WHEN coverage < 0.6 THEN 'coverage ' || printf('%.2f', coverage) || ' below 0.60' END AS reason FROM final")
def coverage_filter_audit(spark, d):
    ok = C("coverage") >= 0.6
    return scored(spark, d).select("profile_id", ok.alias("admissible"), F.when(~ok, F.format_string("coverage %.2f below 0.60", C("coverage"))).alias("reason"))


@query("reliability", f"WITH {PROFILES_SQL} SELECT profile_id, round(least(greatest(CAST(matched AS DOUBLE) / greatest(required, 1) * 0.8 + reliability * 0.2 - 0.05 * nullified - 0.08 * flags, 0.0), 1.0) + 1e-9, 4) AS score FROM profiles")
def reliability(spark, d):
    return profiles(spark, d).select("profile_id", S.reliability(C("matched"), C("required"), C("reliability"), C("nullified"), C("flags")).alias("score"))


@query("grounded_kind_and_risk", f"WITH {PROFILES_SQL} SELECT profile_id, CASE WHEN profile_kind = 'unreadable' THEN 'unreadable' WHEN reliability >= 0.75 AND required + matched >= 6 THEN 'complete_profile' WHEN reliability >= 0.45 AND required + matched >= 3 THEN 'partial_profile' ELSE 'minimal_profile' END AS kind, CASE WHEN flags = 0 THEN 'low' WHEN flags <= 2 THEN 'medium' ELSE 'high' END AS new_risk FROM profiles")
def grounded_kind_and_risk(spark, d):
    return profiles(spark, d).select("profile_id", S.profile_kind(C("reliability"), C("required") + C("matched"), C("profile_kind")).alias("kind"), S.unsupported_risk(C("flags")).alias("new_risk"))


@query("patch_regression_guard", f"""WITH {PROFILES_SQL}, x AS (SELECT profile_id, reliability AS old, CAST(profile_id * 41 % 101 AS DOUBLE) / 100 AS new FROM profiles)
SELECT profile_id, new < old AS reverted, CASE WHEN new < old THEN old ELSE new END AS kept FROM x""")
def patch_regression_guard(spark, d):
    new = (C("profile_id") * 41 % 101).cast("double") / 100
    worse = new < C("reliability")
    return profiles(spark, d).select("profile_id", worse.alias("reverted"), F.when(worse, C("reliability")).otherwise(new).alias("kept"))
