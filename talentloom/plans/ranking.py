"""Retrieval, ranking, rank comparison and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talentloom.functions.scoring import round4
from talentloom.operators import metrics
from talentloom.operators import windows as W
from talentloom.operators.topk import dot, norm, search_width, top, vector_topk_blocks
from talentloom.plans.registry import PROFILES_SQL, profiles, query, table
from talentloom.plans.scores import LABELLED_SQL, SCORED_SQL, labelled, scored

C = F.col
K = 10
DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
VEC_SQL = f"""pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS match_id, {DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) AS rank FROM pairs)"""


def neighbours(spark, d, k):
    """Every row whose id is divisible by 20 against all rows, whatever the table's size."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return vector_topk_blocks(e.where(C("vec_id") % 20 == 0), e, k, "vec_id", "embedding", "vec_id", "embedding")


@query("vec_topk_exact", f"WITH {VEC_SQL} SELECT query_id, match_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= {K}")
def vec_topk_exact(spark, d):
    return neighbours(spark, d, K).select("query_id", "match_id", F.round("score", 6).alias("score"), "rank")


@query("vec_search_width", f"WITH {VEC_SQL}, n AS (SELECT count(*) AS n FROM embeddings) SELECT query_id, match_id, rank FROM ranked, n WHERE rank <= least(greatest(5 * {K}, {K}, 20), n)")
def vec_search_width(spark, d):
    width = search_width(K, table(spark, d, "embeddings").count())
    return neighbours(spark, d, width).select("query_id", "match_id", "rank")


@query("vec_unit_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS length FROM embeddings")
def vec_unit_norm(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(norm(C("embedding")), 6).alias("length"))


@query("flagship_ranking", f"""WITH {VEC_SQL}, {SCORED_SQL}, joined AS (
 SELECT query_id, match_id, score, candidate_id, coverage, penalty, grounded, round(least(greatest(round((score + 1) / 2 + 1e-9, 4) * penalty, 0.0), 1.0) + 1e-9, 4) AS total FROM ranked JOIN final ON match_id = profile_id WHERE rank <= 50),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, candidate_id ORDER BY total DESC, grounded DESC, match_id) AS rn FROM joined),
topk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, grounded DESC, match_id) AS final_rank FROM best WHERE rn = 1)
SELECT query_id, match_id, candidate_id, total, final_rank FROM topk WHERE final_rank <= 10""")
def flagship_ranking(spark, d):
    """Vector retrieval, must-have coverage, tiered penalty, best profile per entity, top-k per query."""
    hits = neighbours(spark, d, 50).drop("rank")
    joined = hits.join(scored(spark, d), hits["match_id"] == C("profile_id"))
    total = round4(F.least(F.greatest(round4((C("score") + 1) / 2) * C("penalty"), F.lit(0.0)), F.lit(1.0)))
    order = [F.desc("total"), F.desc("grounded"), C("match_id")]
    best = joined.withColumn("total", total).withColumn("_rn", F.row_number().over(Window.partitionBy("query_id", "candidate_id").orderBy(*order))).where("_rn = 1")
    return best.withColumn("final_rank", W.rank_by("query_id", order)).where("final_rank <= 10").select("query_id", "match_id", "candidate_id", "total", "final_rank")


@query("top_candidates", f"WITH {SCORED_SQL} SELECT profile_id, final_score, grounded FROM final ORDER BY final_score DESC, grounded DESC, profile_id LIMIT 20")
def top_candidates(spark, d):
    return top(scored(spark, d), [F.desc("final_score"), F.desc("grounded"), C("profile_id")], 20).select("profile_id", "final_score", "grounded")


@query("nulls_last_sort", f"WITH {PROFILES_SQL} SELECT profile_id, required_years, reliability FROM profiles ORDER BY required_years DESC NULLS LAST, reliability DESC, profile_id LIMIT 50")
def nulls_last_sort(spark, d):
    return top(profiles(spark, d), [F.desc_nulls_last("required_years"), F.desc("reliability"), C("profile_id")], 50).select("profile_id", "required_years", "reliability")


@query("page_of_candidates", f"WITH {PROFILES_SQL} SELECT profile_id, candidate_id FROM profiles ORDER BY profile_id LIMIT 25 OFFSET 50")
def page_of_candidates(spark, d):
    return profiles(spark, d).orderBy("profile_id").offset(50).limit(25).select("profile_id", "candidate_id")


@query("point_lookup", f"WITH {PROFILES_SQL} SELECT profile_id, candidate_id FROM profiles WHERE candidate_id = 7 OR profile_id = 7 ORDER BY profile_id LIMIT 1")
def point_lookup(spark, d):
    return top(profiles(spark, d).where("candidate_id = 7 OR profile_id = 7"), [C("profile_id")], 1).select("profile_id", "candidate_id")


MODEL_SQL = f"""{SCORED_SQL}, models AS (SELECT job_id, profile_id, final_score, CAST(profile_id * 29 % 89 AS DOUBLE) / 88 AS rf, CAST(profile_id * 31 % 83 AS DOUBLE) / 82 AS gb FROM final),
ranks AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY final_score DESC, profile_id) AS base_rank, row_number() OVER (PARTITION BY job_id ORDER BY rf DESC, profile_id) AS rf_rank, row_number() OVER (PARTITION BY job_id ORDER BY gb DESC, profile_id) AS gb_rank FROM models)"""


def model_ranks(spark, d):
    m = scored(spark, d).select("job_id", "profile_id", "final_score", ((C("profile_id") * 29 % 89).cast("double") / 88).alias("rf"), ((C("profile_id") * 31 % 83).cast("double") / 82).alias("gb"))
    for name, by in (("base_rank", "final_score"), ("rf_rank", "rf"), ("gb_rank", "gb")):
        m = m.withColumn(name, W.rank_by("job_id", [F.desc(by), C("profile_id")]))
    return m


@query("rank_shift", f"WITH {MODEL_SQL} SELECT job_id, profile_id, base_rank, rf_rank, base_rank - rf_rank AS rank_shift, round(rf - final_score, 6) AS score_delta FROM ranks")
def rank_shift(spark, d):
    return model_ranks(spark, d).select("job_id", "profile_id", "base_rank", "rf_rank", (C("base_rank") - C("rf_rank")).alias("rank_shift"), F.round(C("rf") - C("final_score"), 6).alias("score_delta"))


@query("rank_agreement", f"""WITH {MODEL_SQL} SELECT job_id, profile_id, greatest(base_rank, rf_rank, gb_rank) - least(base_rank, rf_rank, gb_rank) AS gap,
 CASE WHEN greatest(base_rank, rf_rank, gb_rank) - least(base_rank, rf_rank, gb_rank) <= 3 THEN 'agreement_high' WHEN base_rank - rf_rank >= 10 AND base_rank - gb_rank >= 10 THEN 'ml_promoted' WHEN base_rank - rf_rank <= -10 AND base_rank - gb_rank <= -10 THEN 'ml_demoted' ELSE 'review_needed' END AS agreement FROM ranks""")
def rank_agreement(spark, d):
    a, b, c = C("base_rank"), C("rf_rank"), C("gb_rank")
    return model_ranks(spark, d).select("job_id", "profile_id", (F.greatest(a, b, c) - F.least(a, b, c)).alias("gap"), W.agreement(a, b, c).alias("agreement"))


@query("minmax_norm", f"WITH {SCORED_SQL} SELECT job_id, profile_id, round(CASE WHEN max(final_score) OVER w = min(final_score) OVER w THEN 0.5 ELSE (final_score - min(final_score) OVER w) / (max(final_score) OVER w - min(final_score) OVER w) END, 6) AS normal FROM final WINDOW w AS (PARTITION BY job_id)")
def minmax_norm(spark, d):
    return scored(spark, d).select("job_id", "profile_id", F.round(W.min_max(C("final_score"), "job_id"), 6).alias("normal"))


OLD_NEW_SQL = f"""{MODEL_SQL}, old AS (SELECT job_id, profile_id, base_rank FROM ranks WHERE base_rank <= 10), new AS (SELECT job_id, profile_id, rf_rank FROM ranks WHERE rf_rank <= 10),
compared AS (SELECT coalesce(o.job_id, n.job_id) AS job_id, coalesce(o.profile_id, n.profile_id) AS profile_id, base_rank, rf_rank FROM old o FULL JOIN new n ON o.job_id = n.job_id AND o.profile_id = n.profile_id)"""


def old_new(spark, d):
    r = model_ranks(spark, d)
    old = r.where("base_rank <= 10").select("job_id", "profile_id", "base_rank")
    return old.join(r.where("rf_rank <= 10").select("job_id", "profile_id", "rf_rank"), ["job_id", "profile_id"], "full")


@query("rank_compare_full_outer", f"WITH {OLD_NEW_SQL} SELECT job_id, profile_id, base_rank, rf_rank, CASE WHEN base_rank IS NULL THEN 'entered' WHEN rf_rank IS NULL THEN 'exited' WHEN rf_rank < base_rank THEN 'up' WHEN rf_rank > base_rank THEN 'down' ELSE 'unchanged' END AS movement FROM compared")
def rank_compare_full_outer(spark, d):
    return old_new(spark, d).withColumn("movement", W.movement(C("base_rank"), C("rf_rank")))


@query("entered_exited", f"WITH {OLD_NEW_SQL} SELECT job_id, count(*) FILTER (WHERE base_rank IS NULL) AS entered, count(*) FILTER (WHERE rf_rank IS NULL) AS exited, count(*) FILTER (WHERE base_rank IS NOT NULL AND rf_rank IS NOT NULL) AS stayed FROM compared GROUP BY job_id")
def entered_exited(spark, d):
    return old_new(spark, d).groupBy("job_id").agg(F.count_if(C("base_rank").isNull()).alias("entered"), F.count_if(C("rf_rank").isNull()).alias("exited"), F.count_if(C("base_rank").isNotNull() & C("rf_rank").isNotNull()).alias("stayed"))


@query("entered_set_difference", f"WITH {MODEL_SQL} (SELECT job_id, profile_id FROM ranks WHERE rf_rank <= 10) EXCEPT (SELECT job_id, profile_id FROM ranks WHERE base_rank <= 10)")
def entered_set_difference(spark, d):
    r = model_ranks(spark, d)
    return r.where("rf_rank <= 10").select("job_id", "profile_id").join(r.where("base_rank <= 10").select("job_id", "profile_id"), ["job_id", "profile_id"], "left_anti")


@query("stayed_intersection", f"WITH {MODEL_SQL} (SELECT job_id, profile_id FROM ranks WHERE rf_rank <= 10) INTERSECT (SELECT job_id, profile_id FROM ranks WHERE base_rank <= 10)")
def stayed_intersection(spark, d):
    r = model_ranks(spark, d)
    return r.where("rf_rank <= 10").select("job_id", "profile_id").intersect(r.where("base_rank <= 10").select("job_id", "profile_id"))


@query("three_way_rank_union", f"WITH {MODEL_SQL} SELECT DISTINCT job_id, profile_id FROM ranks WHERE base_rank <= 5 OR rf_rank <= 5 OR gb_rank <= 5")
def three_way_rank_union(spark, d):
    r = model_ranks(spark, d)
    part = lambda c: r.where(C(c) <= 5).select("job_id", "profile_id")
    return part("base_rank").union(part("rf_rank")).union(part("gb_rank")).distinct()


@query("stratified_sample", f"""WITH {SCORED_SQL}, r AS (SELECT job_id, profile_id, row_number() OVER (PARTITION BY job_id ORDER BY final_score DESC, profile_id) AS position, count(*) OVER (PARTITION BY job_id) AS n FROM final)
SELECT job_id, profile_id, position, CASE WHEN position <= 4 THEN 'top' WHEN position > floor(n / 2) - 2 AND position <= floor(n / 2) + 2 THEN 'middle' ELSE 'low' END AS stratum FROM r WHERE position <= 4 OR (position > floor(n / 2) - 2 AND position <= floor(n / 2) + 2) OR position > n - 4""")
def stratified_sample(spark, d):
    return W.strata_sample(scored(spark, d), "job_id", [F.desc("final_score"), C("profile_id")], 4).select("job_id", "profile_id", "position", "stratum")


EVAL_SQL = f"""{LABELLED_SQL}, ev AS (SELECT job_id, CAST(label_binary AS DOUBLE) AS rel, row_number() OVER (PARTITION BY job_id ORDER BY final_score_v3 DESC, profile_id) AS r, row_number() OVER (PARTITION BY job_id ORDER BY label_binary DESC, profile_id) AS ideal FROM labelled),
m AS (SELECT job_id, sum(CASE WHEN r <= 10 THEN rel ELSE 0 END) / least(10, count(*)) AS precision_at_k, sum(CASE WHEN r <= 10 THEN rel / log2(r + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 10 THEN rel / log2(ideal + 1) ELSE 0 END) AS best, min(CASE WHEN rel > 0 THEN r END) AS first FROM ev GROUP BY job_id),
metrics AS (SELECT job_id, precision_at_k, CASE WHEN best > 0 THEN dcg / best ELSE 0 END AS ndcg_at_k, coalesce(1.0 / first, 0) AS mrr FROM m)"""


def evaluated(spark, d):
    return metrics.ranking_metrics(labelled(spark, d), "job_id", "final_score_v3", "label_binary", "profile_id", 10)


@query("precision_at_k", f"WITH {EVAL_SQL} SELECT job_id, round(precision_at_k, 6) AS precision_at_k FROM metrics")
def precision_at_k(spark, d):
    return evaluated(spark, d).select("job_id", F.round("precision_at_k", 6).alias("precision_at_k"))


@query("ndcg_at_k", f"WITH {EVAL_SQL} SELECT job_id, round(ndcg_at_k, 6) AS ndcg_at_k FROM metrics")
def ndcg_at_k(spark, d):
    return evaluated(spark, d).select("job_id", F.round("ndcg_at_k", 6).alias("ndcg_at_k"))


@query("mrr", f"WITH {EVAL_SQL} SELECT job_id, round(mrr, 6) AS mrr FROM metrics")
def mrr(spark, d):
    return evaluated(spark, d).select("job_id", F.round("mrr", 6).alias("mrr"))


@query("mean_ranking_metrics", f"WITH {EVAL_SQL} SELECT round(avg(precision_at_k), 6) AS precision_at_k, round(avg(ndcg_at_k), 6) AS ndcg_at_k, round(avg(mrr), 6) AS mrr FROM metrics")
def mean_ranking_metrics(spark, d):
    return evaluated(spark, d).agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision_at_k", "ndcg_at_k", "mrr")])


@query("binary_metrics", f"""WITH {LABELLED_SQL}, c AS (SELECT CAST(count(*) FILTER (WHERE label_binary = 1 AND final_score_v3 >= 0.5) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE label_binary = 0 AND final_score_v3 >= 0.5) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE label_binary = 1 AND final_score_v3 < 0.5) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE label_binary = 0 AND final_score_v3 < 0.5) AS DOUBLE) AS tn FROM labelled)
SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
 round((CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END + CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END) / 2, 6) AS macro_f1 FROM c""")
def binary_metrics(spark, d):
    rows = labelled(spark, d).withColumn("predicted", (C("final_score_v3") >= 0.5).cast("int"))
    m = metrics.binary_metrics(rows, "label_binary", "predicted")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("roc_auc", f"""WITH {LABELLED_SQL}, r AS (SELECT label_binary, rank() OVER (ORDER BY final_score_v3) + (count(*) OVER (PARTITION BY final_score_v3) - 1) / 2.0 AS rk FROM labelled), s AS (SELECT sum(CASE WHEN label_binary = 1 THEN rk ELSE 0 END) AS rs, CAST(sum(label_binary) AS DOUBLE) AS p, CAST(sum(1 - label_binary) AS DOUBLE) AS q FROM r)
SELECT round(CASE WHEN p > 0 AND q > 0 THEN (rs - p * (p + 1) / 2) / (p * q) END, 6) AS roc_auc FROM s""")
def roc_auc(spark, d):
    return metrics.roc_auc(labelled(spark, d), "label_binary", "final_score_v3").select(F.round("roc_auc", 6).alias("roc_auc"))


@query("vec_label_precision", f"WITH {VEC_SQL} SELECT query_id, round(sum(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END) / 10, 6) AS precision_at_10 FROM ranked JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = match_id WHERE rank <= 10 GROUP BY query_id")
def vec_label_precision(spark, d):
    e = table(spark, d, "embeddings")
    hits = neighbours(spark, d, 10)
    a, b = e.select(C("vec_id").alias("query_id"), C("label").alias("_a")), e.select(C("vec_id").alias("match_id"), C("label").alias("_b"))
    joined = hits.join(a, "query_id").join(b, "match_id")
    return joined.groupBy("query_id").agg(F.round(F.sum((C("_a") == C("_b")).cast("double")) / 10, 6).alias("precision_at_10"))


@query("dot_self_check", "SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 5) AS self FROM embeddings")
def dot_self_check(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(dot(C("embedding"), C("embedding")), 5).alias("self"))


CARD_SQL = f"""WITH {SCORED_SQL} SELECT profile_id, CASE WHEN final_score >= 0.8 AND coverage >= 0.65 THEN 'recommended' WHEN final_score >= 0.6 THEN 'review' ELSE 'not_recommended' END AS verdict,
 concat_ws('|', CASE WHEN coverage >= 0.8 THEN 'covers the required skills' END, CASE WHEN experience >= 0.8 THEN 'experience fits' END, CASE WHEN reliability >= 0.8 THEN 'reliable profile' END) AS strengths,
 concat_ws('|', CASE WHEN coverage < 0.6 THEN 'required skills missing' END, CASE WHEN experience < 0.5 THEN 'too little experience' END, CASE WHEN risk <> 'low' THEN 'facts to be verified' END, CASE WHEN alignment < 0.7 THEN 'seniority differs' END) AS weaknesses FROM final"""


@query("decision_cards", CARD_SQL)
def decision_cards(spark, d):
    from talentloom.operators.cards import decision_card

    card = decision_card(scored(spark, d))
    return card.select("profile_id", "verdict", F.concat_ws("|", "strengths").alias("strengths"), F.concat_ws("|", "weaknesses").alias("weaknesses"))


@query("decision_cards_strict", f"WITH {SCORED_SQL} SELECT profile_id, CASE WHEN final_score >= 0.75 AND risk = 'low' THEN 'recommended' WHEN final_score >= 0.5 THEN 'review' ELSE 'not_recommended' END AS verdict FROM final")
def decision_cards_strict(spark, d):
    from talentloom.operators.cards import strict_verdict

    return scored(spark, d).select("profile_id", strict_verdict(C("final_score"), C("risk")).alias("verdict"))
