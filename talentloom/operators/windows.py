"""Ranking windows: ranks, shifts, agreement, normalisation, strata, interval unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_by(group: str, order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(group).orderBy(*order))


def min_max(value: Column, group: str) -> Column:
    """0 to 1 within the group; 0.5 where all are equal."""
    w = Window.partitionBy(group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, 0.5).otherwise((value - low) / (high - low))


def agreement(a: Column, b: Column, c: Column, near: int = 3, far: int = 10) -> Column:
    """How the rank by rules and those of two models agree: both models must gain, or lose, at least `far` ranks to promote or demote."""
    gap = F.greatest(a, b, c) - F.least(a, b, c)
    gain, loss = F.least(a - b, a - c), F.greatest(a - b, a - c)
    return F.when(gap <= near, "agreement_high").when(gain >= far, "ml_promoted").when(loss <= -far, "ml_demoted").otherwise("review_needed")


def movement(old: Column, new: Column) -> Column:
    return F.when(old.isNull(), "entered").when(new.isNull(), "exited").when(new < old, "up").when(new > old, "down").otherwise("unchanged")


def strata_sample(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The top, middle and low n rows of each group (each row once, under its first stratum)."""
    w = Window.partitionBy(group)
    ranked = rows.withColumn("position", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w))
    middle = F.floor(F.col("_n") / 2) - F.floor(F.lit(n) / 2)
    stratum = F.when(F.col("position") <= n, "top").when((F.col("position") > middle) & (F.col("position") <= middle + n), "middle").when(F.col("position") > F.col("_n") - n, "low")
    return ranked.withColumn("stratum", stratum).where("stratum is not null").drop("_n")


def union_length(rows: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Total length of the union of closed integer intervals by group; neighbours touch (gaps and islands).

    Intervals without a start or an end stand last, so that they open no island before known ones.
    """
    w = Window.partitionBy(group).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(before.isNull() | (F.col(start) > before + 1), 1).otherwise(0))
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = island.groupBy(group, "_island").agg(F.min(start).alias("_s"), F.max(end).alias("_e"))
    return spans.groupBy(group).agg(F.sum(F.col("_e") - F.col("_s") + 1).alias("total"), F.count(F.lit(1)).alias("islands"))


def carry_forward(value: Column, group: str, order: list[Column]) -> Column:
    """The last value that isn't null at or before this row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def order_coherence(positions: Column) -> Column:
    """1 - inversions / pairs of an array of positions; 1 for one, 0 for none."""
    n = F.size(positions)
    inversions = F.aggregate(
        F.transform(positions, lambda x, i: F.size(F.filter(F.slice(positions, i + 2, F.greatest(n, F.lit(1))), lambda y: y < x))),
        F.lit(0),
        lambda s, x: s + x,
    )
    return F.when(n == 0, 0.0).when(n == 1, 1.0).otherwise(1 - inversions / (n * (n - 1) / 2))
