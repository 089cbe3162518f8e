"""Snapshots of forecasts, their differences, and the alert feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agropanel.functions import classify as K
from agropanel.functions.scalars import zscore
from agropanel.operators.anomaly import site_baseline


def snapshot(predictions: DataFrame, seasonal: DataFrame, keys: Sequence[str] = ("state", "district")) -> DataFrame:
    """Predictions with the size of their rainfall anomaly relative to the site's own variability."""
    spread = site_baseline(seasonal, "rainfall_anomaly_index", keys, "_m", "_s")
    joined = predictions.join(spread, list(keys), "left")
    severity = F.abs(zscore("rai", "_m", "_s"))
    return joined.withColumn("severity", severity).drop("_m", "_s")


def diff(
    current: DataFrame,
    previous: DataFrame | None,
    keys: Sequence[str] = ("state", "district", "crop"),
    limits: K.ChangeThresholds = K.ChangeThresholds(),
) -> DataFrame:
    """Changes since the previous snapshot with a level and a note; without one every row is baseline.

    A key that the previous snapshot holds twice is an error, raised when the row is computed.
    """
    null = F.lit(None).cast("double")
    if previous is None:
        out = current.withColumns({"yield_change": null, "rai_change": null, "severity_change": null})
        out = out.withColumn("previous_severity", null).withColumn("alert_level", F.lit("baseline"))
    else:
        before = previous.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"), F.max("pred_yield").alias("_pred"), F.max("rai").alias("_rai"),
            F.max("severity").alias("previous_severity"),
        )
        twice = F.raise_error(F.lit("a key occurs twice in the previous snapshot")).cast("double")
        before = before.withColumn("_pred", F.when(F.col("_n") > 1, twice).otherwise(F.col("_pred"))).drop("_n")
        out = current.join(before, list(keys), "left")
        out = out.withColumns(
            {
                "yield_change": F.col("pred_yield") - F.col("_pred"),
                "rai_change": F.col("rai") - F.col("_rai"),
                "severity_change": F.col("severity") - F.col("previous_severity"),
            }
        ).drop("_pred", "_rai")
        out = out.withColumn("alert_level", K.change_level(limits=limits))
    return out.withColumn("change_note", K.change_note(limits=limits))


def feed_order(df: DataFrame) -> DataFrame:
    """Script order of the feed: listed levels first, the unlisted last, severe first inside a level."""
    rank = K.rank_of("alert_level", K.FEED_LEVELS)
    return df.withColumn("feed_rank", rank).orderBy(
        F.col("feed_rank").asc_nulls_last(), F.col("severity").desc_nulls_last(), "state", "district", "crop"
    )


def alert_counts(df: DataFrame, level: str = "alert_level") -> DataFrame:
    """Absolute and relative frequency per level."""
    counts = df.where(F.col(level).isNotNull()).groupBy(level).agg(F.count(F.lit(1)).alias("n"))
    # a window over one row per level
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))
