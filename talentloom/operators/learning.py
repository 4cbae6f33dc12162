"""Rankers on the feature rows: three classifiers, leave-one-group-out, importances."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentloom.operators.metrics import binary_metrics
from talentloom.operators.windows import agreement, rank_by
from talentloom.sources.io import written

#: One model is fitted for each group left out, several at a time: a fit is many short jobs, which leave most cores idle.
MAX_FOLDS, FITS_AT_ONCE = 64, 4

FORBIDDEN = {"job_id", "query_group", "candidate_id", "profile_id", "rank", "label", "label_binary", "label_type", "labeling_strategy", "split"}


def check_features(features: list[str]) -> None:
    if bad := sorted(set(features) & FORBIDDEN):
        raise ValueError(f"identifiers and labels are no features: {bad}")


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """rows with a weight that gives both classes the same total."""
    n = rows.groupBy(label).agg(F.count("*").alias("_n"))  # two rows
    total = rows.count()
    return rows.join(F.broadcast(n), label).withColumn("weight", F.lit(total / 2.0) / F.col("_n")).drop("_n")


def models(features: list[str], label: str, trees: int = 200, rounds: int = 120) -> dict[str, Pipeline]:
    check_features(features)
    assemble = VectorAssembler(inputCols=features, outputCol="_raw")
    scale = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True)
    common = {"labelCol": label, "weightCol": "weight"}
    return {
        "logistic": Pipeline(stages=[assemble, scale, LogisticRegression(featuresCol="_scaled", **common)]),
        "forest": Pipeline(stages=[assemble, RandomForestClassifier(featuresCol="_raw", numTrees=trees, seed=42, **common)]),
        "boosted": Pipeline(stages=[assemble, GBTClassifier(featuresCol="_raw", maxIter=rounds, maxDepth=3, stepSize=0.05, subsamplingRate=0.9, seed=42, **common)]),
    }


def positive_score(scored: DataFrame) -> DataFrame:
    return scored.withColumn("ml_score", vector_to_array("probability")[1])


def folds_of(rows: DataFrame, group: str) -> list[str]:
    """The groups to leave out, one model each: annotated jobs, few by nature; null is one. Their number is checked."""
    found = [r[0] for r in rows.select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g")).distinct().limit(MAX_FOLDS + 1).collect()]
    if len(found) > MAX_FOLDS:
        raise ValueError(f"more than {MAX_FOLDS} groups: a model for each would be too many")
    return sorted(found)


def out_of_fold(rows: DataFrame, features: list[str], label: str, group: str, names: tuple[str, ...] = ("logistic", "forest", "boosted"), trees: int = 200, rounds: int = 120) -> DataFrame:
    """rows once for each model with model, left_out and ml_score, the score by a model that was trained on all other groups.

    Rows of groups whose training rows have one class only are left out.
    """
    rows = rows.withColumn("left_out", F.coalesce(F.col(group).cast("string"), F.lit("")))
    todo = []
    for held in folds_of(rows, group):
        train = balanced(rows.where(F.col("left_out") != held), label)
        if train.select(label).distinct().count() >= 2:
            todo += [(held, name, train) for name in names]

    def scored(fit):
        held, name, train = fit
        test = rows.where(F.col("left_out") == held).withColumn("weight", F.lit(1.0))
        found = positive_score(models(features, label, trees, rounds)[name].fit(train).transform(test))
        return found.select(*rows.columns, F.lit(name).alias("model"), "ml_score")

    with ThreadPool(FITS_AT_ONCE) as pool:
        parts = pool.map(inheritable_thread_target(rows.sparkSession)(scored), todo, chunksize=1)
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.limit(0).withColumn("model", F.lit("")).withColumn("ml_score", F.lit(0.0))


def leave_one_group_out(rows: DataFrame, features: list[str], label: str, group: str, names: tuple[str, ...] = ("logistic", "forest", "boosted"), trees: int = 200, rounds: int = 120) -> DataFrame:
    """Metrics of each model and left-out group: trained on all other groups, tried on that one."""
    scored = written(out_of_fold(rows, features, label, group, names, trees, rounds).select(F.col(label), "model", "left_out", (F.col("ml_score") >= 0.5).cast("int").alias("_p")))
    return binary_metrics(scored, label, "_p", ["model", "left_out"]).select("accuracy", "precision", "recall", "macro_f1", "model", "left_out")


def model_ranks(scored: DataFrame, group: str, ident: str, base: str) -> DataFrame:
    """out_of_fold's rows of the forest and the boosted trees as one row each: base_rank, forest_rank, boosted_rank in the group, rank_shift and agreement.

    Ranks are by falling score, ties by the smaller id. A row that a model lacks is an error.
    """
    wide = scored.groupBy(group, ident).agg(F.max(base).alias("base_score"), *[F.max(F.when(F.col("model") == m, F.col("ml_score"))).alias(f"{m}_score") for m in ("forest", "boosted")])
    missing = F.col("forest_score").isNull() | F.col("boosted_score").isNull()
    wide = wide.withColumn("boosted_score", F.when(missing, F.raise_error(F.lit("a row without a model's score")).cast("double")).otherwise(F.col("boosted_score")))
    for name in ("base", "forest", "boosted"):
        wide = wide.withColumn(f"{name}_rank", rank_by(group, [F.desc(f"{name}_score"), F.col(ident)]))
    ranks = [F.col(f"{n}_rank") for n in ("base", "forest", "boosted")]
    return wide.withColumn("rank_shift", ranks[0] - ranks[1]).withColumn("agreement", agreement(*ranks))


def mean_metrics(folds: DataFrame) -> DataFrame:
    """Each model's mean over the folds."""
    return folds.groupBy("model").agg(F.count("*").alias("folds"), *[F.avg(c).alias(c) for c in ("accuracy", "precision", "recall", "macro_f1")])


def importances(rows: DataFrame, features: list[str], label: str, trees: int = 50) -> DataFrame:
    fitted = models(features, label, trees=trees)["forest"].fit(balanced(rows, label))
    values = fitted.stages[-1].featureImportances.toArray().tolist()
    return rows.sparkSession.createDataFrame(list(zip(features, values, strict=True)), "feature string, importance double")
