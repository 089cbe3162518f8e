"""Forecast quality: error metrics, residual moments, interval coverage, calibration and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agropanel.operators.ranks import exact_quantiles

QUINTILES = ("lowest", "low", "mid", "high", "highest")


def metric_columns(actual: str, predicted: str) -> list[Column]:
    """RMSE, MAE, MAPE, R² and row count as aggregates of one pass."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    n = F.count(e)
    total = F.var_pop(F.when(e.isNotNull(), y)) * n
    return [
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.abs(F.try_divide(e, y))) * 100).alias("mape"),
        F.when(n > 1, 1 - F.try_divide(F.sum(e * e), total)).alias("r2"),
        n.alias("n"),
    ]


def metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*metric_columns(actual, predicted))


def weighted_mean(df: DataFrame, columns: Sequence[str], weight: str = "n") -> DataFrame:
    """Mean of group metrics weighted by group size."""
    return df.agg(*[F.try_divide(F.sum(F.col(c) * F.col(weight)), F.sum(weight)).alias(c) for c in columns])


def fold_summary(folds: DataFrame, columns: Sequence[str] = ("rmse", "mape", "r2")) -> DataFrame:
    """Mean and sample deviation of each metric over the folds."""
    parts = [g(c).alias(f"{c}_{name}") for c in columns for name, g in (("mean", F.avg), ("std", F.stddev_samp))]
    return folds.agg(F.count(F.lit(1)).alias("n_folds"), *parts)


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.withColumn("residual", F.col(actual) - F.col(predicted))


def residual_moments(df: DataFrame, residual: str = "residual", by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, skewness, mean absolute residual and count."""
    return df.groupBy(*by).agg(
        F.avg(residual).alias("mean"), F.stddev_pop(residual).alias("std_pop"), F.skewness(residual).alias("skew"),
        F.avg(F.abs(residual)).alias("mean_abs"), F.count(residual).alias("n"),
    )


def group_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max"), F.count(value).alias("n"),
    )


def covered(actual="actual", lower="lower", upper="upper") -> Column:
    return F.col(actual).between(F.col(lower), F.col(upper))


def interval_coverage(df: DataFrame, by: Sequence[str] = (), actual="actual", lower="lower", upper="upper") -> DataFrame:
    """Share of actual values inside their band and mean band width."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(covered(actual, lower, upper).cast("int")).alias("coverage"),
        F.avg(F.col(upper) - F.col(lower)).alias("mean_width"),
    )


def quantile_bucket(df: DataFrame, value: str, labels: Sequence[str] = QUINTILES, name: str = "bucket") -> DataFrame:
    """Right-closed quantile buckets; equal values share a bucket. The edges are k - 1 numbers."""
    k = len(labels)
    edges = exact_quantiles(df, value, [i / k for i in range(1, k)])
    cuts = edges.agg(F.sort_array(F.collect_list("quantile"))).scalar()
    x = F.col(value)
    rank = F.lit(0)
    for i in range(1, k):
        rank = rank + F.when(x > F.element_at(cuts, i), 1).otherwise(0)
    text = F.element_at(F.array(*[F.lit(label) for label in labels]), rank + 1)
    return df.withColumn(name, F.when(x.isNotNull(), text))


def quintile_calibration(
    df: DataFrame, predicted: str, actual: str = "actual", lower: str = "lower", upper: str = "upper"
) -> DataFrame:
    bucketed = quantile_bucket(df, predicted)
    return bucketed.groupBy("bucket").agg(
        F.avg(covered(actual, lower, upper).cast("int")).alias("coverage"), F.count(F.lit(1)).alias("n")
    )


def worst_bucket(calibration: DataFrame, limit: float = 0.6) -> DataFrame:
    worst = calibration.agg(
        F.min_by("bucket", F.struct("coverage", "bucket")).alias("bucket"), F.min("coverage").alias("coverage")
    )
    return worst.withColumn("flagged", F.col("coverage") < limit)


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram; the greatest value falls into the last bin. Empty bins are not listed."""
    low, high = df.agg(F.min(value)).scalar(), df.agg(F.max(value)).scalar()
    x = F.col(value).cast("double")
    part = F.try_divide((x - low) * bins, F.nullif(high - low, F.lit(0.0)))
    number = F.least(F.coalesce(F.floor(part), F.lit(0)) + 1, F.lit(bins)).cast("int")
    filled = df.where(F.col(value).isNotNull()).withColumn("bin", number)
    return filled.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lowest"), F.max(value).alias("highest"))


def importance(df: DataFrame, attribution: str = "attributions") -> DataFrame:
    """Mean absolute attribution per feature and its share of the total."""
    long = df.select(F.explode(attribution).alias("feature", "value"))
    per = long.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance"))
    # a window over one row per feature
    total = F.sum("importance").over(Window.partitionBy(F.lit(0)))
    return per.withColumn("pct_of_total", F.try_divide(F.col("importance") * 100, total))


# Words that mark a weather feature.
WEATHER_WORDS = (
    "rainfall", "temp", "humidity", "solar", "gdd", "dry_streak", "water_balance", "frost_risk", "heat_stress",
    "drought_flag", "flood_flag",
)


def group_share(imp: DataFrame, words: Sequence[str] = WEATHER_WORDS) -> DataFrame:
    """Share of the importance held by features whose name contains one of the words."""
    hit = F.lower("feature").rlike("|".join(words))
    held = F.sum(F.when(hit, F.col("importance")).otherwise(0.0))
    return imp.agg((F.try_divide(held, F.sum("importance")) * 100).alias("pct"))


def persistence(df: DataFrame) -> DataFrame:
    """Naive forecast: the last known yield."""
    return df.where(F.col("lag_yield_1").isNotNull()).withColumn("pred", F.col("lag_yield_1"))


def walk_forward_persistence(panel: DataFrame, min_train_years: int = 10, min_rows: int = 5) -> DataFrame:
    """Metrics per test year of a forecast that needs no fit.

    One aggregation by year; training sizes are running counts over the few year rows.
    """
    per_year = panel.withColumn("pred", F.col("lag_yield_1")).groupBy("year").agg(
        *metric_columns("yield_kg_ha", "pred"), F.count(F.lit(1)).alias("_rows")
    )
    years = Window.partitionBy(F.lit(0))
    earlier = years.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    folds = per_year.withColumns(
        {"n_train": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)), "_first": F.min("year").over(years)}
    )
    folds = folds.where((F.col("year") >= F.col("_first") + min_train_years) & (F.col("n") >= min_rows))
    return folds.select(F.col("year").alias("test_year"), "n_train", F.col("n").alias("n_test"), "rmse", "mape", "r2")


def compare_folds(baseline: DataFrame, variant: DataFrame) -> DataFrame:
    """Fold by fold: metrics of two feature sets side by side with the gain in R²."""
    columns = ("r2", "rmse", "mape")
    a = baseline.select("test_year", *[F.col(c).alias(f"{c}_baseline") for c in columns])
    b = variant.select("test_year", *[F.col(c).alias(f"{c}_with_lag") for c in columns])
    return a.join(b, "test_year").withColumn("r2_delta", F.col("r2_with_lag") - F.col("r2_baseline"))


def mean_deviation(predictions: DataFrame, history: DataFrame, crop: str, years: int = 5, limit: float = 25.0) -> DataFrame:
    """Predicted mean against the mean of the last published years, with a warning flag."""
    newest = history.agg(F.max("year")).scalar()
    recent = (F.col("crop") == crop) & (F.col("year") >= newest - (years - 1))
    actual = history.where(recent).agg(F.avg("yield_kg_ha")).scalar()
    row = predictions.where(F.col("crop") == crop).agg(F.avg("pred_yield").alias("pred_mean"))
    row = row.withColumn("hist_mean", actual)
    row = row.withColumn("deviation_pct", F.try_divide(F.col("pred_mean") - F.col("hist_mean"), F.col("hist_mean")) * 100)
    return row.withColumn("warn", F.abs("deviation_pct") > limit)


def describe(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).summary("count", "mean", "stddev", "min", "max")
