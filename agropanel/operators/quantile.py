"""Interval models: linear quantile regression by reweighted least squares, and a conformal correction by group.

The check loss of a residual r at quantile q is q r above and (q - 1) r below. It lies under a parabola that touches it at
the present residual, so a weighted least squares fit with weights 1 / (|r| + eps) never raises the loss. One pass over
the rows makes the weighted products of all wanted quantiles at once; the driver solves a system as wide as the features, and
each step's coefficients are written to a table, from which an interrupted fit goes on. The constant is then set to the exact
quantile of what the slopes leave, so a share q of the training rows lies below the fitted line whatever the number of steps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agropanel.lineage import cut
from agropanel.operators import metrics as m
from agropanel.operators.models import LOWER_Q, UPPER_Q
from agropanel.operators.panel import TARGET, impute, median_map
from agropanel.operators.partials import summed, symmetric, upper
from agropanel.operators.ranks import narrow_quantiles
from agropanel.sources.readers import exists

STEPS = 60
TOLERANCE = 1e-5  # largest change of a standardised coefficient, as a share of the label's deviation, that ends the steps
RIDGE = 1e-6  # of the mean weight: keeps the system solvable where columns repeat each other


@dataclass(frozen=True)
class QuantileModel:
    """Linear quantile models that share one preparation."""

    features: tuple[str, ...]
    medians: Mapping[str, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: Mapping[float, np.ndarray]  # by quantile; the constant comes last
    steps: int

    def predicted(self, q: float, slopes_only: bool = False) -> Column:
        out = F.lit(0.0 if slopes_only else float(self.weights[q][-1]))
        for c, mean, scale, weight in zip(self.features, self.mean, self.scale, self.weights[q], strict=False):
            out = out + F.lit(float(weight)) * (F.col(c) - F.lit(float(mean))) / F.lit(float(scale))
        return out

    def transform(self, df: DataFrame, names: Mapping[float, str]) -> DataFrame:
        """`df` with a column for each named quantile; its own columns stay as they are, nulls included."""
        spare = {c: f"_m_{c}" for c in self.features}
        kept = df.withColumns({s: F.col(c) for c, s in spare.items()}) if spare else df
        out = impute(kept, self.medians)
        out = out.withColumns({name: self.predicted(q) for q, name in names.items()})
        return out.drop(*self.features).withColumnsRenamed({s: c for c, s in spare.items()}).select(*df.columns, *names.values())


def _step(rows: DataFrame, width: int, weights: Mapping[float, np.ndarray], eps: float) -> dict[float, np.ndarray]:
    """The minimum of the touching parabola's sum for each quantile, from one pass; `rows` holds x0 … and y."""
    now = list(weights.items())

    def partial(matrix: np.ndarray) -> dict[int, np.ndarray]:
        x, y = np.column_stack([matrix[:, :-1], np.ones(len(matrix))]), matrix[:, -1]
        out = {}
        for i, (q, w) in enumerate(now):
            near = 1 / (np.abs(y - x @ w) + eps)
            weighted = x * near[:, None]
            out[i] = np.concatenate([upper(x.T @ weighted), weighted.T @ y + (2 * q - 1) * x.sum(axis=0)])
        return out

    found, out = summed(rows, partial), {}
    for i, (q, _) in enumerate(now):
        left = symmetric(found[i][: -width - 1], width + 1)
        left += RIDGE * np.trace(left) / (width + 1) * np.eye(width + 1)
        out[q] = np.linalg.solve(left, found[i][-width - 1 :])
    return out


def fit(
    train: DataFrame, features: Sequence[str], quantiles: Sequence[float] = (LOWER_Q, UPPER_Q), steps: int = STEPS,
    target: str = TARGET, state: str | None = None,
) -> QuantileModel | None:
    """Quantile models of the rows with a known label; None if there are none. Missing values become training medians.

    `state` names a folder: the coefficients of each step are written there, and a fit that finds some goes on from the last.
    """
    rows = train.where(F.col(target).isNotNull()).select(*dict.fromkeys([*features, target]))
    if features:
        rows = cut(rows)
    spark = train.sparkSession
    known = median_map(rows, features) if features else {}
    medians = {c: float(known.get(c, 0.0)) for c in features}
    filled = impute(rows, medians)
    y = F.col(target).cast("double")
    stats = filled.agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("y"), F.stddev_pop(y).alias("s"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)]).first()
    if not stats["n"]:
        return None
    k = len(features)
    mean = np.array([stats[f"m{i}"] for i in range(k)], float)
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(k)], float)
    unit = stats["s"] or 1.0
    z = [((F.col(c) - F.lit(float(mean[i]))) / F.lit(float(scale[i]))).alias(f"x{i}") for i, c in enumerate(features)]
    # label in deviations from its mean: one tolerance and one eps suit every table
    unitless = filled.select(*z, ((y - F.lit(stats["y"])) / F.lit(unit)).alias("y"))
    if k:
        unitless = cut(unitless)  # every step reads these columns
    weights, done = {q: np.zeros(k + 1) for q in quantiles}, 0
    if state and exists(spark, state):
        rows_ = spark.read.parquet(state).where(F.col("step") == spark.read.parquet(state).agg(F.max("step")).scalar()).collect()
        if {r["q"] for r in rows_} == set(quantiles) and all(len(r["weights"]) == k + 1 for r in rows_):
            weights, done = {r["q"]: np.array(r["weights"]) for r in rows_}, rows_[0]["step"]
    while k and done < steps:
        after = _step(unitless, k, weights, eps=max(1e-4, 0.1 * 0.8**done))
        moved = max(float(np.abs(after[q] - weights[q]).max()) for q in quantiles)
        weights, done = after, done + 1
        if state:
            table = [(done, float(q), [float(x) for x in w]) for q, w in weights.items()]
            spark.createDataFrame(table, "step int, q double, weights array<double>").coalesce(1).write.mode("append").parquet(state)
        if moved < TOLERANCE and done > 25:
            break
    model = QuantileModel(tuple(features), medians, mean, scale, {q: np.append(w[:-1] * unit, 0.0) for q, w in weights.items()}, done)
    left = filled.select(*[(y - model.predicted(q, True)).alias(f"r{i}") for i, q in enumerate(quantiles)])
    constants = {q: narrow_quantiles(left, f"r{i}", {"c": float(q)}).first()["c"] for i, q in enumerate(quantiles)}
    return QuantileModel(model.features, medians, mean, scale, {q: np.append(w[:-1], constants[q]) for q, w in model.weights.items()}, done)


def check_loss(df: DataFrame, predicted: str, q: float, target: str = TARGET, by: Sequence[str] = ()) -> DataFrame:
    """Mean check loss of a quantile's predictions."""
    r = F.col(target) - F.col(predicted)
    return df.groupBy(*by).agg(F.avg(F.when(r >= 0, r * q).otherwise(r * (q - 1))).alias("loss"))


def band(model: QuantileModel, df: DataFrame, lower_q: float = LOWER_Q, upper_q: float = UPPER_Q) -> DataFrame:
    """`df` with lower and upper; lines that cross change places."""
    out = model.transform(df, {lower_q: "_lower", upper_q: "_upper"})
    return out.withColumns({"lower": F.least("_lower", "_upper"), "upper": F.greatest("_lower", "_upper")}).drop("_lower", "_upper")


def corrected(banded: DataFrame, held_out: DataFrame, by: Sequence[str] = (), coverage: float = UPPER_Q - LOWER_Q, target: str = TARGET) -> DataFrame:
    """The band widened (or narrowed) on both sides so that a share `coverage` of the held-out rows of a group lies inside.

    The correction is the exact quantile of how far held-out labels lie outside their band, negative inside. A group without
    held-out rows keeps its band. Null group keys match each other.
    """
    outside = held_out.select(*by, F.greatest(F.col("lower") - F.col(target), F.col(target) - F.col("upper")).alias("_e"))
    offsets = narrow_quantiles(outside, "_e", {"_shift": coverage}, list(by))
    if by:
        renamed = offsets.select(*[F.col(c).alias(f"_g_{c}") for c in by], "_shift")
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        # one row per group on the right; Spark picks the join
        joined = banded.join(renamed, same, "left").drop(*[f"_g_{c}" for c in by])
    else:
        joined = banded.withColumn("_shift", offsets.select("_shift").scalar())
    shift = F.coalesce(F.col("_shift"), F.lit(0.0))
    middle = (F.col("lower") + F.col("upper")) / 2
    return joined.withColumns({"lower": F.least(F.col("lower") - shift, middle), "upper": F.greatest(F.col("upper") + shift, middle)}).drop("_shift")


def coverage_and_width(df: DataFrame, by: Sequence[str] = (), target: str = TARGET) -> DataFrame:
    """Share of labels inside the band and its mean width."""
    return m.interval_coverage(df, by, target)
