"""Table-wide and learned queries: star-schema reports, model training, streaming, file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom.operators import learning
from talentloom.plans.registry import query, table
from talentloom.plans.scores import FEATURES, labelled
from talentloom.sources.io import round_trip, written
from talentloom.streaming.incremental import processed_in_batches

C = F.col


@query("lineitem_report", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def lineitem_report(spark, d):
    rows = table(spark, d, "lineitem").where(C("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(C("l_extendedprice") * (1 - C("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))


@query("customer_activity", "SELECT c_mktsegment, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def customer_activity(spark, d):
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"))
    j = table(spark, d, "customer").join(per, C("c_custkey") == C("o_custkey"), "left")
    return j.groupBy("c_mktsegment").agg(F.count_distinct("c_custkey").alias("customers"), F.coalesce(F.sum("k"), F.lit(0)).alias("orders"))


@query("events_by_type", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def events_by_type(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("incremental_handoff", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def incremental_handoff(spark, d):
    """Events read as a file stream, all available at once, into a table with a checkpoint, then counted."""
    return processed_in_batches(spark, f"{d}/events.parquet", "event_type")


@query("model_cross_validation")
def model_cross_validation(spark, d):
    """Leaves out one job at a time, a job being the documents of one language; three models of few trees."""
    langs = table(spark, d, "documents").select(C("doc_id").alias("_d"), C("lang").alias("job"))
    rows = labelled(spark, d).join(langs, C("profile_id") == C("_d")).drop("_d")
    return learning.mean_metrics(learning.leave_one_group_out(written(rows), FEATURES, "label_binary", "job", trees=10, rounds=5))


@query("feature_importance")
def feature_importance(spark, d):
    return learning.importances(written(labelled(spark, d)), FEATURES, "label_binary")


@query("file_round_trip", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def file_round_trip(spark, d):
    return round_trip(table(spark, d, "documents").select("doc_id", "source")).groupBy("source").agg(F.count("*").alias("n"))


@query("model_rank_agreement")
def model_rank_agreement(spark, d):
    """Ranks by rules and by two models that did not see the job they rank, with shifts and agreement."""
    langs = table(spark, d, "documents").select(C("doc_id").alias("_d"), C("lang").alias("job"))
    rows = written(labelled(spark, d).join(langs, C("profile_id") == C("_d")).drop("_d"))
    scored = written(learning.out_of_fold(rows, FEATURES, "label_binary", "job", names=("forest", "boosted"), trees=10, rounds=5))
    return learning.model_ranks(scored, "left_out", "profile_id", "final_score_v3").withColumnRenamed("left_out", "job")
