"""Report, histogram, statistics, comparison and assistant queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom.functions import scoring as S
from talentloom.operators import jobs
from talentloom.operators.ocr import cer, summarize, wer
from talentloom.plans.registry import PROFILES_SQL, profiles, query, table
from talentloom.plans.scores import SCORED_SQL, scored

C = F.col


@query("skill_counters", "SELECT p_brand AS skill, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, skill LIMIT 15")
def skill_counters(spark, d):
    return table(spark, d, "part").groupBy(C("p_brand").alias("skill")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "skill").limit(15)


@query("word_counters", r"SELECT w AS word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda x: x <> '')) AS w FROM documents) GROUP BY w ORDER BY n DESC, word LIMIT 50")
def word_counters(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), "[ \t\n\r]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)


@query("run_quality_report", f"WITH {PROFILES_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE profile_kind = 'complete_profile') AS complete, count(*) FILTER (WHERE profile_kind = 'partial_profile') AS partial, count(*) FILTER (WHERE risk = 'low') AS low_risk, count(*) FILTER (WHERE risk = 'high') AS high_risk, CAST(sum(nullified) AS BIGINT) AS fields_nullified, round(avg(reliability), 4) AS mean_reliability, CASE WHEN avg(reliability) >= 0.8 THEN 'ready' WHEN avg(reliability) >= 0.6 THEN 'usable_with_review' ELSE 'not_ready' END AS readiness FROM profiles")
def run_quality_report(spark, d):
    mean = F.avg("reliability")
    return profiles(spark, d).agg(
        F.count("*").alias("total"), F.count_if(C("profile_kind") == "complete_profile").alias("complete"), F.count_if(C("profile_kind") == "partial_profile").alias("partial"),
        F.count_if(C("risk") == "low").alias("low_risk"), F.count_if(C("risk") == "high").alias("high_risk"), F.sum("nullified").alias("fields_nullified"),
        F.round(mean, 4).alias("mean_reliability"), F.when(mean >= 0.8, "ready").when(mean >= 0.6, "usable_with_review").otherwise("not_ready").alias("readiness"),
    )


@query("field_status_long", f"WITH {PROFILES_SQL}, l AS (SELECT profile_id, 'skills' AS field, CASE WHEN matched > 0 THEN 'supported' ELSE 'missing' END AS status FROM profiles UNION ALL SELECT profile_id, 'experience', CASE WHEN has_experience THEN 'supported' ELSE 'missing' END FROM profiles UNION ALL SELECT profile_id, 'name', CASE WHEN weak_name THEN 'weak' ELSE 'supported' END FROM profiles) SELECT field, status, count(*) AS n FROM l GROUP BY 1, 2")
def field_status_long(spark, d):
    state = F.array(
        F.struct(F.lit("skills").alias("field"), F.when(C("matched") > 0, "supported").otherwise("missing").alias("status")),
        F.struct(F.lit("experience").alias("field"), F.when(C("has_experience"), "supported").otherwise("missing").alias("status")),
        F.struct(F.lit("name").alias("field"), F.when(C("weak_name"), "weak").otherwise("supported").alias("status")),
    )
    return profiles(spark, d).select(F.inline(state)).groupBy("field", "status").agg(F.count("*").alias("n"))


@query("failure_taxonomy", f"WITH {PROFILES_SQL}, c AS (SELECT CASE WHEN nullified >= 5 THEN 'validation' WHEN flags >= 4 THEN 'quality' WHEN NOT has_experience THEN 'too_short' END AS cause FROM profiles) SELECT cause, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM c WHERE cause IS NOT NULL), 4) AS share FROM c WHERE cause IS NOT NULL GROUP BY cause")
def failure_taxonomy(spark, d):
    cause = F.when(C("nullified") >= 5, "validation").when(C("flags") >= 4, "quality").when(~C("has_experience"), "too_short")
    n = profiles(spark, d).select(cause.alias("cause")).where("cause is not null").groupBy("cause").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_t"))
    return n.crossJoin(F.broadcast(total)).select("cause", "n", F.round(C("n") / C("_t"), 4).alias("share"))


@query("union_by_job_counts", f"WITH {PROFILES_SQL}, u AS (SELECT job_id, profile_id, 'all' AS part FROM profiles UNION ALL SELECT job_id, profile_id, 'labelled' FROM profiles WHERE profile_id IN (SELECT doc_id FROM labels)) SELECT job_id, part, count(*) AS n FROM u GROUP BY 1, 2")
def union_by_job_counts(spark, d):
    p = profiles(spark, d).select("job_id", "profile_id")
    labelled = p.join(table(spark, d, "labels").select(C("doc_id").alias("_l")), C("profile_id") == C("_l"), "left_semi")
    u = p.withColumn("part", F.lit("all")).unionByName(labelled.withColumn("part", F.lit("labelled")))
    return u.groupBy("job_id", "part").agg(F.count("*").alias("n"))


@query("reliability_statistics", f"WITH {PROFILES_SQL} SELECT job_id, round(avg(reliability), 6) AS mean, round(median(reliability), 6) AS median, round(stddev_pop(reliability), 6) AS spread, min(reliability) AS low, max(reliability) AS high FROM profiles GROUP BY job_id")
def reliability_statistics(spark, d):
    return profiles(spark, d).groupBy("job_id").agg(F.round(F.avg("reliability"), 6).alias("mean"), F.round(F.median("reliability"), 6).alias("median"), F.round(F.stddev_pop("reliability"), 6).alias("spread"), F.min("reliability").alias("low"), F.max("reliability").alias("high"))


@query("taxonomy_induction", "WITH r AS (SELECT trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS k, p_type, count(*) AS n FROM part GROUP BY 1, 2) SELECT k, arg_max(p_type, n * 1000 - length(p_type)) AS canonical, count(*) AS variants FROM r GROUP BY k")
def taxonomy_induction(spark, d):
    k = F.trim(F.regexp_replace(F.lower("p_type"), "[^a-z0-9]+", " "))
    r = table(spark, d, "part").groupBy(k.alias("k"), "p_type").agg(F.count("*").alias("n"))
    return r.groupBy("k").agg(F.max_by("p_type", F.struct("n", -F.length("p_type"))).alias("canonical"), F.count("*").alias("variants"))


@query("demo_summary", f"WITH {SCORED_SQL} SELECT count(*) AS candidates, count(*) FILTER (WHERE final_score >= 0.6) AS strong, round(avg(final_score), 4) AS mean_score, round(max(final_score), 4) AS best_score FROM final")
def demo_summary(spark, d):
    return scored(spark, d).agg(F.count("*").alias("candidates"), F.count_if(C("final_score") >= 0.6).alias("strong"), F.round(F.avg("final_score"), 4).alias("mean_score"), F.round(F.max("final_score"), 4).alias("best_score"))


@query("executive_order", f"WITH {SCORED_SQL} SELECT profile_id, final_score, required - matched AS gaps FROM final ORDER BY final_score DESC, gaps, reliability DESC, profile_id LIMIT 10")
def executive_order(spark, d):
    x = scored(spark, d).withColumn("gaps", C("required") - C("matched"))
    return x.orderBy(F.desc("final_score"), "gaps", F.desc("reliability"), "profile_id").limit(10).select("profile_id", "final_score", "gaps")


@query("contribution_extremes", f"WITH {SCORED_SQL}, c AS (SELECT profile_id, job_id, final_score - base_score AS delta FROM final), r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY delta DESC, profile_id) AS up, row_number() OVER (PARTITION BY job_id ORDER BY delta, profile_id) AS down FROM c) SELECT job_id, profile_id, round(delta, 6) AS delta, up <= 3 AS is_top FROM r WHERE up <= 3 OR down <= 3")
def contribution_extremes(spark, d):
    from talentloom.operators.windows import rank_by

    c = scored(spark, d).select("profile_id", "job_id", (C("final_score") - C("base_score")).alias("delta"))
    r = c.withColumn("up", rank_by("job_id", [F.desc("delta"), C("profile_id")])).withColumn("down", rank_by("job_id", [C("delta"), C("profile_id")]))
    return r.where("up <= 3 or down <= 3").select("job_id", "profile_id", F.round("delta", 6).alias("delta"), (C("up") <= 3).alias("is_top"))


@query("readiness_checks", "SELECT 'documents' AS name, count(*) > 0 AS ok FROM documents UNION ALL SELECT 'labels_known', count(*) = 0 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'unique_ids', count(*) = count(DISTINCT doc_id) FROM documents")
def readiness_checks(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    one = lambda df, name, ok: df.agg(F.lit(name).alias("name"), ok.alias("ok"))
    strays = labels.join(docs, "doc_id", "left_anti")
    return one(docs, "documents", F.count("*") > 0).unionByName(one(strays, "labels_known", F.count("*") == 0)).unionByName(one(docs, "unique_ids", F.count("*") == F.count_distinct("doc_id")))


def engine_samples(spark, d):
    """Two made-up engines over whole texts; a text that is missing is a failure."""
    engines = spark.createDataFrame([("a",), ("b",)], "engine string")  # two rows
    said = F.when(C("engine") == "a", F.replace("text", F.lit("e"), F.lit("c"))).otherwise(F.replace("text", F.lit("h"), F.lit("")))
    s = table(spark, d, "benchmark").join(F.broadcast(engines)).select("engine", F.when(C("text").isNull(), "failed").otherwise("success").alias("status"), "text", said.alias("said"))
    return summarize(s.select("engine", "status", cer(C("text"), C("said")).alias("cer"), wer(C("text"), C("said")).alias("wer")))


@query("ocr_engine_summary", "WITH s AS (SELECT item_id, text AS t, e.engine, CASE e.engine WHEN 'a' THEN replace(text, 'e', 'c') ELSE replace(text, 'h', '') END AS said FROM benchmark, (VALUES ('a'), ('b')) e(engine)) SELECT engine, count(t) AS ok, count(*) - count(t) AS failed, round(avg(CAST(levenshtein(t, said) AS DOUBLE) / greatest(length(t), 1)), 6) AS mean_cer FROM s GROUP BY engine")
def ocr_engine_summary(spark, d):
    return engine_samples(spark, d).select("engine", "ok", "failed", F.round("mean_cer", 6).alias("mean_cer"))


@query("ocr_engine_summary_whole")
def ocr_engine_summary_whole(spark, d):
    """With word error rates (SQL has no edits on words)."""
    return engine_samples(spark, d).select("engine", "ok", F.round("mean_cer", 6).alias("mean_cer"), F.round("mean_wer", 6).alias("mean_wer"))


@query("ocr_best_variant", f"WITH {PROFILES_SQL} SELECT candidate_id, arg_max(profile_id, reliability * 1000000 + CAST(profile_id AS DOUBLE) / 1000000) AS variant FROM profiles GROUP BY candidate_id")
def ocr_best_variant(spark, d):
    return profiles(spark, d).groupBy("candidate_id").agg(F.max_by("profile_id", F.struct("reliability", "profile_id")).alias("variant"))


@query("assistant_answers", f"WITH {SCORED_SQL}, t AS (SELECT job_id, string_agg(CAST(profile_id AS VARCHAR), ', ' ORDER BY rn) AS best FROM (SELECT job_id, profile_id, row_number() OVER (PARTITION BY job_id ORDER BY final_score DESC, profile_id) AS rn FROM final) WHERE rn <= 3 GROUP BY job_id) SELECT job_id, 'Best for ' || job_id || ': ' || best AS answer FROM t")
def assistant_answers(spark, d):
    from talentloom.operators.windows import rank_by

    r = scored(spark, d).withColumn("rn", rank_by("job_id", [F.desc("final_score"), C("profile_id")])).where("rn <= 3")
    best = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "profile_id"))), lambda s: s["profile_id"].cast("string")), ", ")
    return r.groupBy("job_id").agg(best.alias("best")).select("job_id", F.concat(F.lit("Best for "), "job_id", F.lit(": "), "best").alias("answer"))


@query("assistant_scenario_score", "SELECT conv_id, turn, round(0.75 * (CASE WHEN length(text) > 0 THEN 1.0 ELSE 0.0 END) + 0.25 * (CASE WHEN contains(lower(text), 'the') THEN 0.5 ELSE 0.0 END + CASE WHEN contains(lower(text), 'and') THEN 0.5 ELSE 0.0 END), 4) AS score FROM conversations WHERE role = 'assistant'")
def assistant_scenario_score(spark, d):
    from talentloom.operators.assistant import scenario_score

    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.round(scenario_score(C("text"), ["the", "and"], [F.length("text") > 0]), 4).alias("score"))


@query("display_names", f"WITH {PROFILES_SQL} SELECT profile_id, CASE profile_id % 4 WHEN 0 THEN 'Ada Byron' ELSE 'Candidate (ID: ' || CAST(candidate_id AS VARCHAR) || ')' END AS name, CASE profile_id % 4 WHEN 0 THEN 'ok' ELSE 'weak' END AS quality FROM profiles")
def display_names(spark, d):
    from talentloom.functions.names import display_name

    raw = F.element_at(F.array(F.lit("Ada  Byron"), F.lit("RESUME OBJECTIVE"), F.lit("Data Scientist"), F.lit("  ")), (C("profile_id") % 4 + 1).cast("int"))
    n = display_name(raw, C("candidate_id"))
    return profiles(spark, d).select("profile_id", n.getField("name").alias("name"), n.getField("quality").alias("quality"))


@query("identity_keys", f"WITH {PROFILES_SQL} SELECT profile_id, CASE WHEN profile_id % 4 = 0 THEN 1.0 WHEN profile_id % 5 = 0 THEN 0.9 WHEN profile_id % 7 = 0 THEN 0.7 ELSE 0.3 END AS confidence, NOT (profile_id % 4 = 0 OR profile_id % 5 = 0 OR profile_id % 7 = 0) AS ambiguous FROM profiles")
def identity_keys(spark, d):
    from talentloom.functions.names import identity

    i = C("profile_id")
    key = identity(F.when(i % 4 == 0, F.concat(i.cast("string"), F.lit("@x.org"))), F.lit("ann"), F.when(i % 5 == 0, F.lit("5551234567")), F.when(i % 7 == 0, F.lit("tunis")), i.cast("string"))
    return profiles(spark, d).select("profile_id", key.getField("confidence").alias("confidence"), key.getField("ambiguous").alias("ambiguous"))


@query("job_confidence", f"WITH {PROFILES_SQL} SELECT profile_id, round(least(greatest(0.35 + CASE WHEN NOT weak_name THEN 0.15 ELSE 0.0 END + least(0.2, required * 0.03) + CASE WHEN has_experience THEN 0.1 ELSE 0.0 END + CASE WHEN seniority <> 'unknown' THEN 0.05 ELSE 0.0 END + CASE WHEN required_years IS NOT NULL THEN 0.05 ELSE 0.0 END + CASE WHEN lang IS NOT NULL THEN 0.03 ELSE 0.0 END + CASE WHEN route <> 'other' THEN 0.03 ELSE 0.0 END - least(0.2, flags * 0.04), 0.0), 0.99) + 1e-9, 4) AS confidence FROM profiles")
def job_confidence(spark, d):
    score = jobs.confidence(~C("weak_name"), C("required"), C("has_experience"), C("seniority") != "unknown", C("required_years").isNotNull(), C("lang").isNotNull(), C("route") != "other", C("flags"))
    return profiles(spark, d).select("profile_id", score.alias("confidence"))
