"""Additive attribution of tree ensembles and the views on it.

The attribution is the path-dependent Shapley value of a tree model (Lundberg et al. 2020). Each leaf is a product of
per-feature conditions, so its contribution has a closed form over the few features on its path. The ensemble is
small and travels with the task; rows stay distributed and are handled in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def leaves_of(model) -> list[tuple[float, float, dict[int, tuple[float, float, float]]]]:
    """Leaves of a fitted ensemble: (weighted value, reach, {feature: (low, high, share of training rows)})."""
    found = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        root = tree._java_obj.rootNode()
        stack = [(root, 1.0, {})]
        while stack:
            node, reach, path = stack.pop()
            if node.subtreeDepth() == 0:
                found.append((weight * node.prediction(), reach, path))
                continue
            j, cut = node.split().featureIndex(), node.split().threshold()
            n = node.impurityStats().count()
            for child, is_left in ((node.leftChild(), True), (node.rightChild(), False)):
                share = child.impurityStats().count() / n
                low, high, z = path.get(j, (-np.inf, np.inf, 1.0))
                span = (low, min(high, cut), z * share) if is_left else (max(low, cut), high, z * share)
                stack.append((child, reach * share, {**path, j: span}))
    return found


def base_value(leaves, weight_sum: float = 1.0) -> float:
    """Expected prediction over the training rows."""
    return sum(value * reach for value, reach, _ in leaves) / weight_sum


def shapley(x: np.ndarray, leaves, weight_sum: float = 1.0) -> np.ndarray:
    """Attribution matrix (rows x features) of one batch."""
    out = np.zeros_like(x)
    for value, _, path in leaves:
        d = len(path)
        if d == 0:
            continue
        features = list(path)
        share = [path[j][2] for j in features]
        inside = [((x[:, j] > path[j][0]) & (x[:, j] <= path[j][1])).astype(float) for j in features]
        weight = [factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)]
        for i, j in enumerate(features):
            # coefficient k: subsets of the other features of size k, each weighted by its reach
            terms = np.zeros((len(x), d))
            terms[:, 0] = 1.0
            for o in range(d):
                if o != i:
                    shifted = terms[:, :-1] * inside[o][:, None]
                    terms = terms * share[o]
                    terms[:, 1:] += shifted
            out[:, j] += value * (inside[i] - share[i]) * (terms @ weight)
    return out / weight_sum


def attribute(df: DataFrame, model, features: Sequence[str], vector: str = "features", average: bool = False) -> DataFrame:
    """Adds `attributions` (feature -> contribution) and `base_value`; their sum is the prediction.

    `average` is for forests, whose prediction is the mean of the trees.
    """
    spark = df.sparkSession
    leaves = leaves_of(model)
    total = float(sum(model.treeWeights)) if average else 1.0
    shared = spark.sparkContext.broadcast(leaves)
    base = base_value(leaves, total)
    columns = list(df.columns)
    arrays = df.withColumn("_x", vector_to_array(vector)).drop(vector)
    kept = [c for c in columns if c != vector]
    schema = arrays.select(*kept).schema.add("_shap", T.ArrayType(T.DoubleType()))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.vstack(frame["_x"].to_numpy()).astype(float)
                yield frame[kept].assign(_shap=list(shapley(x, shared.value, total)))

    scored = arrays.mapInPandas(batches, schema)
    names = F.array(*[F.lit(c) for c in features])
    return scored.withColumn("attributions", F.map_from_arrays(names, "_shap")).drop("_shap").withColumn(
        "base_value", F.lit(base)
    )


def top_factors(attributions="attributions", k: int = 5) -> Column:
    """The k largest contributions by absolute value, inside the row."""
    m = F.col(attributions) if isinstance(attributions, str) else attributions
    known = F.filter(F.map_entries(m), lambda e: e["value"].isNotNull())
    # struct order: larger magnitude first, then feature name
    keyed = F.transform(known, lambda e: F.struct((-F.abs(e["value"])).alias("m"), e["key"].alias("f"), e["value"].alias("v")))
    best = F.slice(F.array_sort(keyed), 1, k)
    return F.transform(best, lambda e: F.struct(e["f"].alias("feature"), F.bround(e["v"], 2).alias("value")))


def long_form(df: DataFrame, ids: Sequence[str], attributions: str = "attributions") -> DataFrame:
    return df.select(*ids, F.explode(attributions).alias("feature", "value"))
