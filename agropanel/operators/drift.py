"""Distribution baselines of training features and drift of new rows against them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agropanel.functions import classify as K
from agropanel.functions.scalars import zscore
from agropanel.operators.ranks import wide_quantiles


def long_form(df: DataFrame, features: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    typed = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in features])
    return typed.unpivot(list(ids), list(features), "feature", "value")


def baseline(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, range and exact 5 and 95 % points per feature: one row per feature."""
    long = long_form(train, features).where(F.col("value").isNotNull())
    moments = long.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return moments.join(wide_quantiles(long, "value", {"p05": 0.05, "p95": 0.95}, ["feature"]), "feature")


def as_dict(base: DataFrame) -> dict[str, dict[str, float]]:
    """The baseline on the driver: a handful of numbers per feature."""
    return {r["feature"]: {k: r[k] for k in base.columns if k != "feature"} for r in base.collect()}


def severity(column: str, stats: dict[str, float]) -> Column:
    return K.drift_severity(column, *[F.lit(stats[k]) for k in ("mean", "std", "p05", "p95")])


def row_severity(df: DataFrame, stats: dict[str, dict[str, float]]) -> DataFrame:
    """Greatest severity over all known features of a row; a narrow expression, no shuffle."""
    known = [c for c in stats if c in df.columns]
    grades = [severity(c, stats[c]) for c in known]
    worst = F.greatest(*grades) if len(grades) > 1 else grades[0] if grades else F.lit(0)
    return df.withColumn("drift_severity", worst).withColumn("drift_level", K.drift_status("drift_severity"))


def vote(df: DataFrame, stats: dict[str, dict[str, float]], features: Sequence[str], threshold: int = 3) -> DataFrame:
    """Number of features that drift, and the row's label: several must agree."""
    votes = [
        K.is_drifted(c, F.lit(stats[c]["mean"]), F.lit(stats[c]["std"])).cast("int")
        for c in features if c in stats and c in df.columns
    ]
    total = F.lit(0)
    for v in votes:
        total = total + v
    return df.withColumn("n_drifted", total).withColumn("drift_status", K.vote_label("n_drifted", threshold))


def extreme_share(history: DataFrame, live: DataFrame, features: Sequence[str], sigmas: float = 3.0) -> DataFrame:
    """Share of live rows far outside the pooled history, per feature; features without spread are left out."""
    present = [c for c in features if c in history.columns and c in live.columns]
    past = long_form(history, present).groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )
    past = past.where(F.col("std") > 0)
    far = F.coalesce(F.abs(zscore("value", "mean", "std")) > sigmas, F.lit(False)).cast("int")
    # `past` has one row per feature
    joined = long_form(live, present).join(F.broadcast(past), "feature")
    return joined.groupBy("feature").agg(F.avg(far).alias("extreme_share"), F.count(F.lit(1)).alias("n"))
