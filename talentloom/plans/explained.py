"""Attributions of rankers: boosted trees, their global and local reports, and a stated tree that SQL can check."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom.operators import attributions as A
from talentloom.operators import learning
from talentloom.plans.registry import query
from talentloom.plans.scores import FEATURES, LABELLED_SQL, labelled
from talentloom.sources.io import written

C = F.col


def _explained(spark, d):
    rows = written(labelled(spark, d))
    fitted = learning.models(FEATURES, "label_binary", rounds=20)["boosted"].fit(learning.balanced(rows, "label_binary")).stages[-1]
    return A.explain(rows, A.ensemble_paths(fitted, spark), FEATURES)


@query("attribution_global")
def attribution_global(spark, d):
    """Mean absolute attribution of each feature over all rows, for boosted trees fitted on them."""
    return A.global_importance(A.long_form(_explained(spark, d), ["profile_id"], FEATURES))


@query("attribution_local")
def attribution_local(spark, d):
    """Each row's five strongest features in both directions, with the score they add up to."""
    score = C("_base") + F.aggregate("_attributions", F.lit(0.0), lambda a, x: a + x)
    up, down = (A.top_contributions(C("_attributions"), FEATURES, 5, up) for up in (True, False))
    return _explained(spark, d).select("job_id", "candidate_id", "profile_id", "label", "label_binary", (1 / (1 + F.exp(-2 * score))).alias("predicted_probability"), up.alias("top_positive"), down.alias("top_negative"))


#: A tree of rules whose attributions SQL can work out subset by subset.
TREE_FEATURES = ["must_have_coverage", "experience_match_score", "reliability_score"]
TREE = [
    {"id": 0, "feature": 0, "threshold": 0.5, "left": 1, "right": 2, "value": 0.0},
    {"id": 1, "feature": 1, "threshold": 0.5, "left": 3, "right": 4, "value": 0.0},
    {"id": 2, "feature": 2, "threshold": 0.6, "left": 5, "right": 6, "value": 0.0},
    {"id": 3, "feature": -1, "value": 0.0},
    {"id": 4, "feature": -1, "value": 0.25},
    {"id": 5, "feature": 0, "threshold": 0.8, "left": 7, "right": 8, "value": 0.0},
    {"id": 6, "feature": -1, "value": 1.0},
    {"id": 7, "feature": -1, "value": 0.375},
    {"id": 8, "feature": -1, "value": 0.625},
]


@query("tree_attributions", f"""WITH {LABELLED_SQL}, r AS (SELECT profile_id, must_have_coverage AS a, experience_match_score AS b, reliability_score AS c FROM labelled),
n AS (SELECT count(*) AS n0, count(*) FILTER (WHERE a <= 0.5) AS n1, count(*) FILTER (WHERE a <= 0.5 AND b <= 0.5) AS n3, count(*) FILTER (WHERE NOT a <= 0.5) AS n2,
    count(*) FILTER (WHERE NOT a <= 0.5 AND c <= 0.6) AS n5, count(*) FILTER (WHERE NOT a <= 0.5 AND c <= 0.6 AND a <= 0.8) AS n7 FROM r),
s AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS s),
w AS (SELECT profile_id, s, CASE WHEN s % 2 = 1 THEN CAST(a <= 0.5 AS INT) ELSE n1 / n0 END AS w1, CASE WHEN s // 2 % 2 = 1 THEN CAST(b <= 0.5 AS INT) ELSE coalesce(n3 / nullif(n1, 0), 0) END AS w3,
    CASE WHEN s // 4 = 1 THEN CAST(c <= 0.6 AS INT) ELSE coalesce(n5 / nullif(n2, 0), 0) END AS w5, CASE WHEN s % 2 = 1 THEN CAST(a <= 0.8 AS INT) ELSE coalesce(n7 / nullif(n5, 0), 0) END AS w7 FROM r, n, s),
v AS (SELECT profile_id, s, w1 * (1 - w3) * 0.25 + (1 - w1) * (w5 * (w7 * 0.375 + (1 - w7) * 0.625) + (1 - w5)) AS v FROM w),
p AS (SELECT profile_id, max(v) FILTER (WHERE s = 0) AS v0, max(v) FILTER (WHERE s = 1) AS va, max(v) FILTER (WHERE s = 2) AS vb, max(v) FILTER (WHERE s = 3) AS vab,
    max(v) FILTER (WHERE s = 4) AS vc, max(v) FILTER (WHERE s = 5) AS vac, max(v) FILTER (WHERE s = 6) AS vbc, max(v) FILTER (WHERE s = 7) AS vabc FROM v GROUP BY profile_id)
SELECT profile_id, CAST(round(v0 * 1000000000) AS BIGINT) AS base_billionths, CAST(round(((va - v0) / 3 + (vab - vb) / 6 + (vac - vc) / 6 + (vabc - vbc) / 3) * 1000000000) AS BIGINT) AS coverage_billionths,
    CAST(round(((vb - v0) / 3 + (vab - va) / 6 + (vbc - vc) / 6 + (vabc - vac) / 3) * 1000000000) AS BIGINT) AS experience_billionths,
    CAST(round(((vc - v0) / 3 + (vac - va) / 6 + (vbc - vb) / 6 + (vabc - vab) / 3) * 1000000000) AS BIGINT) AS reliability_billionths, CAST(round(vabc * 1000000000) AS BIGINT) AS score_billionths FROM p""")
def tree_attributions(spark, d):
    """Shapley values of a stated tree on two uses of one feature, whose branches weigh by the rows of the table."""
    rows = labelled(spark, d).select("profile_id", *TREE_FEATURES)
    explained = A.explain(rows, A.leaf_paths(A.with_covers(rows, TREE, TREE_FEATURES)), TREE_FEATURES)
    billionths = lambda c: F.round(c * 1000000000).cast("long")
    parts = [billionths(C("_attributions")[i]).alias(f"{n}_billionths") for i, n in enumerate(("coverage", "experience", "reliability"))]
    score = C("_base") + F.aggregate("_attributions", F.lit(0.0), lambda s, x: s + x)
    return explained.select("profile_id", billionths(C("_base")).alias("base_billionths"), *parts, billionths(score).alias("score_billionths"))
