"""Ranking and classification metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(rows: DataFrame, group: str, score: str, relevant: str, tie: str, k: int) -> DataFrame:
    """Precision@k (over min(k, n)), nDCG@k and reciprocal rank of each group."""
    w = Window.partitionBy(group)
    ranked = rows.select(
        group,
        F.col(relevant).cast("double").alias("_rel"),
        F.row_number().over(w.orderBy(F.desc(score), tie)).alias("_r"),
        F.row_number().over(w.orderBy(F.desc(relevant), tie)).alias("_ideal"),
    )
    gain = lambda r: F.sum(F.when(F.col(r) <= k, F.col("_rel") / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    out = ranked.groupBy(group).agg(
        (F.sum(F.when(F.col("_r") <= k, F.col("_rel")).otherwise(0.0)) / F.least(F.lit(k), F.count(F.lit(1)))).alias("precision_at_k"),
        gain("_r").alias("_dcg"),
        gain("_ideal").alias("_best"),
        F.min(F.when(F.col("_rel") > 0, F.col("_r"))).alias("_first"),
    )
    return out.select(group, "precision_at_k", F.when(F.col("_best") > 0, F.col("_dcg") / F.col("_best")).otherwise(0.0).alias("ndcg_at_k"), F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("mrr"))


def binary_metrics(rows: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall and macro F1 from one confusion matrix, or one for each group of `by`; an empty denominator gives 0."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    m = rows.groupBy(*by or []).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return m.select(
        *by or [],
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ((ratio(2 * tp, 2 * tp + fp + fn) + ratio(2 * tn, 2 * tn + fp + fn)) / 2).alias("macro_f1"),
    )


def roc_auc(rows: DataFrame, truth: str, score: str) -> DataFrame:
    """Rank-sum AUC with average ranks for ties; null if only one class occurs.

    Equal scores are counted together first, so the running count runs over distinct scores; it is
    taken per range of scores with the ranges' totals added, so no task holds all scores.
    """
    by = rows.groupBy(F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(truth).cast("long")).alias("_pos"))
    binned = by.withColumn("_bin", F.floor(F.col("_s") * 1024).cast("long"))
    held = binned.groupBy("_bin").agg(F.sum("_n").alias("_k"))
    base = held.withColumn("_base", F.coalesce(F.sum("_k").over(Window.partitionBy(F.lit(0)).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_bin").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = binned.withColumn("_in", inside).join(F.broadcast(base.select("_bin", "_base")), "_bin")  # as many rows as score bins
    rank = F.col("_base") + F.col("_in") + (F.col("_n") + 1) / 2
    total = ranked.agg(F.sum(rank * F.col("_pos")).alias("_r"), F.sum("_pos").alias("_p"), F.sum(F.col("_n") - F.col("_pos")).alias("_q"))
    return total.select(F.when((F.col("_p") > 0) & (F.col("_q") > 0), (F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * F.col("_q"))).alias("roc_auc"))
