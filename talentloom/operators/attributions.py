"""Exact Shapley values of tree ensembles, by the weights of root-to-leaf paths.

What a tree is expected to say when only the features S are known follows x at splits on S and both children by their training rows elsewhere. A
leaf then counts with the product, over the features of its path, of "x takes the path's turns" (known) or of the path's share of
rows (unknown). The Shapley value of such a product game is a sum over subset sizes only, so each path is worked off once
for a whole batch of rows, without going through subsets.

Values add up: base + sum of attributions = score. The paths of all trees go to the tasks; their number is checked.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentloom.sources.io import fresh_path

# small helpers travel with the tasks, so that workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
MAX_LEAVES = 1 << 18
#: Rounding errors of sums that cancel out are no contributions.
NOTHING = 1e-12


@dataclass
class LeafPath:
    """One leaf: its value and, for each feature on its path, the interval (low, high] that leads there and the share of rows that take these turns."""

    value: float
    features: list[int]
    low: list[float]
    high: list[float]
    share: list[float]


def leaf_paths(nodes: list[dict], scale: float = 1.0) -> list[LeafPath]:
    """nodes of one tree: id, feature (-1 in a leaf), threshold (x <= threshold goes left), left, right, cover (rows), value."""
    by_id, out = {n["id"]: n for n in nodes}, []
    stack: list[tuple[int, dict]] = [(0, {})]
    while stack:
        at, turns = stack.pop()
        node = by_id[at]
        if node["feature"] < 0:
            names = sorted(turns)
            out.append(LeafPath(scale * node["value"], names, *([turns[f][k] for f in names] for k in range(3))))
            continue
        low, high, share = turns.get(node["feature"], (-math.inf, math.inf, 1.0))
        left, right = by_id[node["left"]]["cover"], by_id[node["right"]]["cover"]
        all_rows = left + right
        for child, cover, bounds in ((node["left"], left, (low, min(high, node["threshold"]))), (node["right"], right, (max(low, node["threshold"]), high))):
            stack.append((child, turns | {node["feature"]: (*bounds, share * cover / all_rows if all_rows else 0.0)}))
    return out


def ensemble_paths(model: GBTClassificationModel | RandomForestClassificationModel, spark) -> list[LeafPath]:
    """Paths of a fitted forest (score: probability of class 1) or of boosted trees (score: the margin, half the log odds)."""
    path = fresh_path(spark, "model")
    model.save(path)
    saved = spark.read.parquet(path + "/data")
    if (n := saved.where("nodeData.leftChild < 0").limit(MAX_LEAVES + 1).count()) > MAX_LEAVES:
        raise ValueError(f"{n} leaves or more: too many to send to every task")
    forest = isinstance(model, RandomForestClassificationModel)
    trees: dict[int, list[dict]] = {}
    for r in saved.select("treeID", "nodeData.*").collect():
        split = r["split"]
        if split["featureIndex"] >= 0 and split["numCategories"] != -1:
            raise ValueError("splits on categories are not explained")
        votes = r["impurityStats"]
        value = (votes[1] / sum(votes) if sum(votes) else 0.0) if forest else r["prediction"]
        threshold = split["leftCategoriesOrThreshold"][0] if split["featureIndex"] >= 0 else math.nan
        trees.setdefault(r["treeID"], []).append({"id": r["id"], "feature": split["featureIndex"], "threshold": threshold, "left": r["leftChild"], "right": r["rightChild"], "cover": r["rawCount"], "value": value})
    weights = [1.0 / len(trees)] * len(trees) if forest else list(model.treeWeights)
    return [p for i, nodes in sorted(trees.items()) for p in leaf_paths(nodes, weights[i])]


def base_value(paths: list[LeafPath]) -> float:
    return float(sum(p.value * math.prod(p.share) for p in paths))


def shapley_values(paths: list[LeafPath], x: np.ndarray) -> np.ndarray:
    """Attributions of each row of x (rows, features). Not-a-numbers go right, as in the trees."""
    out = np.zeros(x.shape)
    for p in paths:
        d = len(p.features)
        takes = [(~(x[:, f] <= lo) & ((x[:, f] <= hi) if hi < math.inf else True)).astype(float) for f, lo, hi in zip(p.features, p.low, p.high, strict=True)]
        for i in range(d):
            known = [np.ones(len(x))]  # known[k]: sum over k-subsets of the other features of their products
            for j in range(d):
                if j != i:
                    grown = [c * p.share[j] for c in known] + [np.zeros(len(x))]
                    for k, c in enumerate(known):
                        grown[k + 1] = grown[k + 1] + c * takes[j]
                    known = grown
            total = sum(c * (math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)) for k, c in enumerate(known))
            out[:, p.features[i]] += p.value * (takes[i] - p.share[i]) * total
    return out


def explain(rows: DataFrame, paths: list[LeafPath], features: list[str]) -> DataFrame:
    """rows with _base and _attributions (array of doubles, in the order of features)."""
    shared = rows.sparkSession.sparkContext.broadcast(paths)
    schema = T.StructType([*rows.schema, T.StructField("_base", T.DoubleType()), T.StructField("_attributions", T.ArrayType(T.DoubleType()))])

    def run(batches):
        paths = shared.value
        base = base_value(paths)
        for batch in batches:
            x = np.stack([np.asarray(batch.column(f).to_numpy(zero_copy_only=False), float) for f in features], axis=1)
            values = shapley_values(paths, x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, len(features), dtype=np.int32)), pa.array(values.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(x), base)), lists], names=[*batch.schema.names, "_base", "_attributions"])

    return rows.mapInArrow(run, schema)


def long_form(explained: DataFrame, ident: list[str], features: list[str]) -> DataFrame:
    """One row for each row and feature: (ident, feature, feature_value, attribution)."""
    each = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.array(*[F.col(f).cast("double") for f in features]).alias("feature_value"), F.col("_attributions").alias("attribution"))
    return explained.select(*ident, F.inline(each)).toDF(*ident, "feature", "feature_value", "attribution")


def global_importance(contributions: DataFrame) -> DataFrame:
    """Mean absolute and mean attribution of each feature, ranked."""
    per = contributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"), F.avg("attribution").alias("mean"))
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs"), "feature")))  # one row a feature


def top_contributions(attributions: Column, features: list[str], n: int, positive: bool) -> Column:
    """The n features that raise (or lower) the score most: array of (feature, attribution)."""
    pairs = F.arrays_zip(F.transform(attributions, lambda a: -a if positive else a).alias("order"), F.array(*[F.lit(f) for f in features]).alias("feature"))
    pairs = F.transform(pairs, lambda p: F.struct(p["order"].alias("order"), p["feature"].alias("feature")))
    first = F.slice(F.array_sort(F.filter(pairs, lambda p: p["order"] < -NOTHING)), 1, n)
    return F.transform(first, lambda p: F.struct(p["feature"].alias("feature"), (-p["order"] if positive else p["order"]).alias("attribution")))


def with_covers(rows: DataFrame, nodes: list[dict], features: list[str]) -> list[dict]:
    """nodes of a stated tree with cover: how many rows reach each of them, counted in one pass."""
    by_id, reach, stack = {n["id"]: n for n in nodes}, {0: F.lit(True)}, [0]
    while stack:
        node = by_id[stack.pop()]
        if node["feature"] >= 0:
            left = F.coalesce(F.col(features[node["feature"]]) <= node["threshold"], F.lit(False))
            reach[node["left"]], reach[node["right"]] = reach[node["id"]] & left, reach[node["id"]] & ~left
            stack += [node["left"], node["right"]]
    counts = rows.agg(*[F.count_if(c).alias(str(i)) for i, c in reach.items()]).first()
    return [n | {"cover": counts[str(n["id"])]} for n in nodes]
