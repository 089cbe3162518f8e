"""Forecast models on the panel with pyspark.ml: training, search, walk-forward evaluation, bands and scoring.

Fits are distributed by MLlib; the driver only loops over a few settings or folds. Missing values are replaced by
training medians plus 0/1 indicators, because MLlib trees have no branch for missing values.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agropanel.operators import metrics as m
from agropanel.operators.panel import TARGET, impute, median_map
from agropanel.operators.ranks import narrow_quantiles

SEED = 42
# Interval quantiles, ridge strength and the tree search grid (MLlib names).
LOWER_Q, UPPER_Q = 0.02, 0.98
RIDGE_ALPHA = 10.0
GRID = {
    "maxIter": (300, 600, 1000),
    "maxDepth": (4, 6, 8),
    "stepSize": (0.01, 0.05, 0.1),
    "minInstancesPerNode": (1, 5),
    "subsamplingRate": (0.8,),
}


@dataclass(frozen=True)
class Prepared:
    """Assembled rows and the constants that made them."""

    features: tuple[str, ...]
    medians: Mapping[str, float]
    indicators: bool

    def names(self) -> list[str]:
        extra = [f"{c}_missing" for c in self.features] if self.indicators else []
        return [*self.features, *extra]

    def apply(self, df: DataFrame) -> DataFrame:
        filled = impute(df, self.medians, self.indicators)
        return VectorAssembler(inputCols=self.names(), outputCol="features", handleInvalid="keep").transform(filled)


def prepare(train: DataFrame, features: Sequence[str], indicators: bool = False) -> Prepared:
    """Constants from training rows only; a feature without any value there becomes 0."""
    known = median_map(train, features)
    return Prepared(tuple(features), {c: float(known.get(c, 0.0)) for c in features}, indicators)


def boosted(**settings):
    defaults = {"maxIter": 500, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "minInstancesPerNode": 5}
    return GBTRegressor(featuresCol="features", labelCol=TARGET, predictionCol="pred", seed=SEED, **{**defaults, **settings})


def boosted_small_leaves(**settings):
    """Second boosted configuration: larger leaves, fewer candidate features per split."""
    return boosted(**{"minInstancesPerNode": 10, "featureSubsetStrategy": "0.8", **settings})


def forest(**settings):
    defaults = {"numTrees": 300, "maxDepth": 10, "minInstancesPerNode": 5}
    return RandomForestRegressor(
        featuresCol="features", labelCol=TARGET, predictionCol="pred", seed=SEED, **{**defaults, **settings}
    )


def fit_with_validation(estimator: GBTRegressor, train: DataFrame, valid: DataFrame):
    """Boosting that stops when the validation error no longer falls."""
    both = train.withColumn("_valid", F.lit(False)).unionByName(valid.withColumn("_valid", F.lit(True)))
    return estimator.copy({estimator.validationIndicatorCol: "_valid"}).fit(both)


@dataclass(frozen=True)
class Ridge:
    """Standardised ridge regression; scaling uses the population deviation."""

    prepared: Prepared
    scale: Mapping[str, tuple[float, float]]
    model: Transformer

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(_scaled(self.prepared, self.scale, df))


def _scaled(prepared: Prepared, scale: Mapping[str, tuple[float, float]], df: DataFrame) -> DataFrame:
    filled = impute(df, prepared.medians)
    z = {f"_z_{c}": (F.col(c) - mean) / (std or 1.0) for c, (mean, std) in scale.items()}
    names = [f"_z_{c}" for c in prepared.features]
    out = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(filled.withColumns(z))
    return out.drop(*names)


def fit_ridge(train: DataFrame, features: Sequence[str], alpha: float = RIDGE_ALPHA) -> Ridge:
    prepared = prepare(train, features)
    filled = impute(train, prepared.medians)
    stats = filled.agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop(TARGET).alias("y"),
        *[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features],
    ).first()
    scale = {c: (stats[f"m_{c}"], stats[f"s_{c}"]) for c in features}
    # MLlib divides the penalty by the population deviation of the label; undo that to get the plain ridge penalty
    strength = alpha / stats["n"] * (stats["y"] or 1.0)
    solver = LinearRegression(
        featuresCol="features", labelCol=TARGET, predictionCol="pred", elasticNetParam=0.0, regParam=strength,
        standardization=False, solver="normal",
    )
    return Ridge(prepared, scale, solver.fit(_scaled(prepared, scale, train)))


def normal_equation_gaps(ridge: Ridge, train: DataFrame, alpha: float = RIDGE_ALPHA) -> DataFrame:
    """(feature, residual, n): mean of z (y - prediction) less alpha times the weight per row; 0 at the solution."""
    filled = impute(ridge.transform(train), ridge.prepared.medians)
    error = F.col(TARGET) - F.col("pred")
    sums = []
    for c, weight in zip(ridge.prepared.features, ridge.model.coefficients.toArray().tolist(), strict=True):
        mean, std = ridge.scale[c]
        gap = (F.sum((F.col(c) - mean) / (std or 1.0) * error) - alpha * weight) / F.count(F.lit(1))
        sums.append(F.struct(F.lit(c).alias("feature"), gap.alias("residual"), F.count(F.lit(1)).alias("n")))
    return filled.agg(F.array(*sums).alias("found")).select(F.explode("found").alias("f")).select("f.*")


def change_columns(scored: DataFrame, last_yield: str = TARGET) -> DataFrame:
    """Prediction and its difference to the last published yield."""
    out = scored.withColumnRenamed("pred", "pred_yield")
    return out.withColumn("change", F.col("pred_yield") - F.col(last_yield))


def error_columns(scored: DataFrame) -> DataFrame:
    """Test table: error and error in percent of the actual yield."""
    error = F.col(TARGET) - F.col("pred")
    return scored.withColumn("error", error).withColumn("error_pct", F.try_divide(error, F.col(TARGET)) * 100)


def require_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    from agropanel.operators.panel import require_columns

    return require_columns(df, features)


# ---- bands ----------------------------------------------------------------------------------------------------

def conformal_band(
    scored: DataFrame, held_out: DataFrame, by: Sequence[str] = (), lower_q: float = LOWER_Q, upper_q: float = UPPER_Q
) -> DataFrame:
    """Band from exact residual quantiles of held-out rows, optionally per group; a group without any gets none."""
    residual = held_out.select(*by, (F.col(TARGET) - F.col("pred")).alias("_e"))
    offsets = narrow_quantiles(residual, "_e", {"_lo": lower_q, "_hi": upper_q}, list(by))
    if by:
        joined = scored.join(offsets, list(by), "left")
    else:
        lo, hi = offsets.select("_lo").scalar(), offsets.select("_hi").scalar()
        joined = scored.withColumn("_lo", lo).withColumn("_hi", hi)
    return joined.withColumn("lower", F.col("pred") + F.col("_lo")).withColumn("upper", F.col("pred") + F.col("_hi")).drop("_lo", "_hi")


def _all(spark, tasks: Sequence[Callable[[], object]], parallelism: int) -> list:
    """Results of independent fits in order; several at a time, because one small fit leaves most executors idle."""
    if not tasks:
        return []
    wrapped = [inheritable_thread_target(spark)(task) for task in tasks]
    with ThreadPool(max(1, min(parallelism, len(wrapped)))) as pool:
        return pool.map(lambda task: task(), wrapped)


# ---- search and folds -----------------------------------------------------------------------------------------

def draw_settings(grid: Mapping[str, Sequence] = GRID, draws: int = 40, seed: int = SEED) -> list[dict]:
    """Distinct random points of a grid, always the same for the same seed."""
    points = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    return random.Random(seed).sample(points, min(draws, len(points)))


def expanding_folds(years: Sequence[int], folds: int = 5) -> list[tuple[int, int]]:
    """First and last test year of each fold: the whole history in folds + 1 blocks, each tested on all years before it.

    The first block, which only trains, takes the years that do not divide evenly. Fewer years give fewer folds.
    """
    ordered = sorted(set(years))
    folds = min(folds, len(ordered) - 1)
    if folds < 1:
        return []
    size = len(ordered) // (folds + 1)
    starts = [len(ordered) - size * (folds - i) for i in range(folds)]
    return [(ordered[i], ordered[i + size - 1]) for i in starts]


def years_of(panel: DataFrame) -> list[int]:
    """Distinct years, a few dozen at most."""
    return [r[0] for r in panel.select("year").distinct().orderBy("year").collect()]


def search(
    panel: DataFrame, features: Sequence[str], settings: Sequence[dict], folds: int = 5,
    estimator: Callable[..., object] = boosted, parallelism: int = 4,
) -> DataFrame:
    """RMSE of each setting over expanding-window folds, best first."""
    spark = panel.sparkSession
    rows = []
    for year, last in expanding_folds(years_of(panel), folds):
        train, test = panel.where(F.col("year") < year), panel.where(F.col("year").between(year, last))
        prepared = prepare(train, features)
        fit_rows, test_rows = prepared.apply(train).select("features", TARGET).persist(), prepared.apply(test)

        def error(values, fit_rows=fit_rows, test_rows=test_rows):
            scored = estimator(**values).fit(fit_rows).transform(test_rows)
            return m.metrics(scored, TARGET, "pred").first()["rmse"]

        errors = _all(spark, [lambda v=values: error(v) for values in settings], parallelism)
        for i, (values, rmse) in enumerate(zip(settings, errors, strict=True)):
            rows.append((i, str(sorted(values.items())), int(year), rmse))
        fit_rows.unpersist()
    table = spark.createDataFrame(rows, "setting int, parameters string, test_year int, rmse double")
    scores = table.groupBy("setting", "parameters").agg(F.avg("rmse").alias("rmse"), F.count(F.lit(1)).alias("n_folds"))
    return scores.orderBy("rmse", "setting")


def walk_forward(
    panel: DataFrame, features: Sequence[str], fit: Callable[[DataFrame, Sequence[str]], object],
    min_train_years: int = 10, min_rows: int = 5, parallelism: int = 4,
) -> DataFrame:
    """Fits on all years before Y, tests on Y; one metric row per test year.

    `fit` takes (training rows, features) and returns an object with `transform`.
    """
    spark = panel.sparkSession
    sizes = {r["year"]: r["count"] for r in panel.groupBy("year").count().collect()}
    first = min(sizes)
    tested = [y for y in sorted(sizes) if y >= first + min_train_years and sizes[y] >= min_rows]

    def fold(year: int):
        model = fit(panel.where(F.col("year") < year), features)
        found = m.metrics(model.transform(panel.where(F.col("year") == year)), TARGET, "pred").first()
        n_train = sum(n for y, n in sizes.items() if y < year)
        return (int(year), n_train, found["n"], found["rmse"], found["mape"], found["r2"])

    rows = _all(spark, [lambda y=year: fold(y) for year in tested], parallelism)
    return spark.createDataFrame(rows, "test_year int, n_train long, n_test long, rmse double, mape double, r2 double")


def headline(train: DataFrame, test: DataFrame, features: Sequence[str], fit, label: str) -> DataFrame:
    """One metric row of a feature set on the fixed split."""
    scored = fit(train, features).transform(test)
    return m.metrics(scored, TARGET, "pred").withColumn("label", F.lit(label)).withColumn("n_features", F.lit(len(features)))


@dataclass(frozen=True)
class Fitted:
    """A tree model together with its preparation."""

    prepared: Prepared
    model: Transformer | PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.prepared.apply(df))


def fit_trees(train: DataFrame, features: Sequence[str], estimator=None, valid: DataFrame | None = None, indicators: bool = False) -> Fitted:
    estimator = estimator or boosted()
    prepared = prepare(train, features, indicators)
    rows = prepared.apply(train).select("features", TARGET)
    if valid is None:
        return Fitted(prepared, estimator.fit(rows))
    return Fitted(prepared, fit_with_validation(estimator, rows, prepared.apply(valid).select("features", TARGET)))


def per_crop(
    train: DataFrame, test: DataFrame, features: Sequence[str], crops: Sequence[str], fit, parallelism: int = 4
) -> DataFrame:
    """One model per crop without the crop feature; metric rows per crop. Crops are a short fixed list."""
    own = [c for c in features if c != "crop_encoded"]

    def one(crop: str):
        mine = F.col("crop") == crop
        found = m.metrics(fit(train.where(mine), own).transform(test.where(mine)), TARGET, "pred").first()
        return (*(found[c] for c in ("rmse", "mae", "mape", "r2", "n")), crop)

    spark = train.sparkSession
    rows = _all(spark, [lambda c=crop: one(c) for crop in crops], parallelism)
    return spark.createDataFrame(rows, "rmse double, mae double, mape double, r2 double, n long, crop string")


def comparison(parts: Sequence[DataFrame]) -> DataFrame:
    """Metric rows of several models in one table, best first."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.orderBy("rmse")
